"""Vector search, score fusion, hybrid retrieval and reranking over query and candidate tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from granary.functions import numeric as n
from granary.functions import text as t
from granary.operators import lexical
from granary.operators.lexical import ranked
from granary.operators.vectors import blocks, centres, in_cells, products
from granary.runtime import cut_lineage, sized


def where(df: DataFrame, filters: dict[str, object] | None = None, contains: str | None = None, text_col: str = "text") -> DataFrame:
    """Equality filters and a substring, applied before anything is scored."""
    for name, value in (filters or {}).items():
        df = df.filter(F.col(name) == value)
    return df if contains is None else df.filter(F.col(text_col).contains(contains))


def knn(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, cos, score, rank): exact nearest by cosine of each query (query_id, qvec). score = 1 - distance / 2.

    Both sides are gathered into blocks of vectors where they lie, those of the queries are written out and, if few, broadcast, blocks are crossed, and each pair of blocks is one
    matrix product that gives at most the k best of every query (more on ties), so the shuffle has k rows for each query and
    corpus block, whatever the block's size. A vector that is null or 0 is near nothing."""
    asked = sized(blocks(queries, "query_id", "qvec", "query_id", "q"), 2 << 20)
    crossed = blocks(corpus, id_col, vector_col, "id", "v").crossJoin(asked)
    types = {"query_id": queries.schema["query_id"].dataType, "id": corpus.schema[id_col].dataType}

    def best(i: np.ndarray, cos: np.ndarray) -> np.ndarray:
        if cos.shape[1] <= k:
            return np.ones(cos.shape, bool)
        edge = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
        return cos >= edge[:, None] - 1e-9

    near = products(crossed, best, types)
    return ranked(near.withColumn("score", n.distance_score(1 - F.col("cos"))), k, id_col="id")


def store_vectors(corpus: DataFrame, path: str, cells: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, piece: int = 20_000) -> np.ndarray:
    """Writes every vector (id, v, cell, piece) by cell, and returns the cells' centres. They are fitted on at most ``sample`` vectors; all are indexed. A cell is
    written by as many tasks as it has pieces of about ``piece`` vectors, so a cell that holds most of them is no task's burden."""
    c = centres(corpus, vector_col, cells, sample)
    rows = in_cells(corpus, id_col, vector_col, c)
    pieces = max(1, -(-corpus.count() // piece))
    placed = rows.withColumn("piece", F.expr(f"pmod(xxhash64(id), {pieces})").cast("int"))
    placed.repartition("cell", "piece").write.mode("overwrite").partitionBy("cell").parquet(path)
    return c


def search_vectors(index: DataFrame, c: np.ndarray, queries: DataFrame, k: int, probes: int = 16) -> DataFrame:
    """(query_id, id, cos, score, rank): nearest of each query (query_id, qvec) among the vectors of its ``probes`` nearest cells. Only those cells are read;
    cosines are exact, but a neighbour in another cell is missed. With as many probes as cells it is :func:`knn`."""
    asked = in_cells(queries, "query_id", "qvec", c, probes).toDF("query_id", "q", "at")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", index.schema["id"].dataType), T.StructField("cos", T.DoubleType())])

    def run(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            q, v = (np.frombuffer(b"".join(t.column(n).to_pylist())).reshape(t.num_rows, -1) for t, n in ((left, "q"), (right, "v")))
        for lo in range(0, left.num_rows if right.num_rows else 0, 256):
            cos = q[lo : lo + 256] @ v.T
            edge = np.partition(cos, max(cos.shape[1] - k, 0), axis=1)[:, max(cos.shape[1] - k, 0)]
            a, b = np.nonzero(cos >= edge[:, None] - 1e-9)
            out.append(pa.table([left.column("query_id").take(pa.array(lo + a)), right.column("id").take(pa.array(b)), pa.array(cos[a, b])], schema.names))
        return pa.concat_tables(out) if out else pa.table([left.column("query_id").slice(0, 0), right.column("id").slice(0, 0), pa.array([], pa.float64())], schema.names)

    # A row for each piece of a cell: their number is the corpus over a constant.
    spread = index.select(F.col("piece").alias("part")).distinct()
    wanted = asked.crossJoin(F.broadcast(spread))
    near = wanted.groupBy("at", "part").cogroup(index.groupBy("cell", "piece")).applyInArrow(run, schema)
    return ranked(near.withColumn("score", n.distance_score(1 - F.col("cos"))), k, id_col="id")


def min_max(score: str, *by: str) -> Column:
    """Scores of a list to 0..1; 1 if all are equal."""
    w = W.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo))


def min_max_eps(score: str, *by: str) -> Column:
    """As a cross-encoder's scores are scaled: 1e-6 in the denominator, a single one is 1, several equal ones 0."""
    w = W.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(F.count(F.lit(1)).over(w) == 1, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo + F.lit(1e-6)))


def z_sigmoid(score: str, *by: str) -> Column:
    """Sigmoid of the z-score with the population deviation; 0.5 if that is 0."""
    w = W.partitionBy(*by)
    sd = F.stddev_pop(score).over(w)
    return F.when(sd == 0, F.lit(0.5)).otherwise(n.sigmoid((F.col(score) - F.avg(score).over(w)) / sd))


def normalize(score: str, method: str, *by: str) -> Column:
    if method == "minmax":
        return min_max(score, *by)
    if method == "zscore":
        return z_sigmoid(score, *by)
    raise ValueError(f"unknown normalisation: {method}")


def fuse(scores: DataFrame, method: str = "weighted_sum", vector_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
    """(query_id, id, vector_score, lexical_score, fused_score, rank) from rows (query_id, id, system, score), system vector or lexical.

    One pass: both lists are scaled or ranked by a window over (query, system) and put side by side by a
    grouped maximum, which is the full outer join without a join."""
    key = ["query_id", "system"]
    if method == "weighted_sum":
        part = scores.withColumn("x", min_max("score", *key))
    elif method == "rrf":
        part = scores.withColumn("x", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.round("score", 9)), "id")))
    else:
        raise ValueError(f"fusion by {method} isn't defined")
    side = part.groupBy("query_id", "id").agg(
        *[F.max(F.when(F.col("system") == s, F.col(c))).alias(f"{s}_{c}") for s in ("vector", "lexical") for c in ("score", "x")]
    )
    if method == "weighted_sum":
        fused = n.weighted(F.coalesce("vector_x", F.lit(0.0)), F.coalesce("lexical_x", F.lit(0.0)), vector_weight, lexical_weight)
    else:
        fused = n.reciprocal_rank("vector_x", vector_weight) + n.reciprocal_rank("lexical_x", lexical_weight)
    out = side.select("query_id", "id", *[F.coalesce(f"{s}_score", F.lit(0.0)).alias(f"{s}_score") for s in ("vector", "lexical")], fused.alias("fused_score"))
    return ranked(out, None, "fused_score", "id")


def boost(results: DataFrame, metadata: DataFrame, field: str, boosts: dict[str, float], id_col: str = "id", score: str = "fused_score") -> DataFrame:
    """Scores times the boost of the row's metadata value (1 without one), ranked anew."""
    name = "__field"
    while name in results.columns:
        name += "_"
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])[F.col(name)], F.lit(1.0)) if boosts else F.lit(1.0)
    meta = metadata.select(F.col(id_col), F.col(field).alias(name))
    out = results.drop("rank").join(meta, id_col, "left").withColumn(score, F.col(score) * factor).drop(name)
    return ranked(out, None, score, id_col)


def hybrid(corpus: DataFrame, queries: DataFrame, top_k: int = 10, bm25_weights: bool = True, use_classifier: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, query_type, vector_score, lexical_score, combined_score, rank).

    ``corpus`` (doc_id, text, embedding) and ``queries`` (query_id, text, qvec); ``texts`` (doc_id, text) where they lie apart from the vectors. The 2k nearest of
    each query are scored lexically and weighed by its type; a document that isn't among them can't enter. Lexical scores come from an
    index of the queries' terms over the texts of these nearest documents, which are picked out where they lie if they are few."""
    near = knn(corpus, queries, 2 * top_k, "doc_id").select("query_id", F.col("id").alias("doc_id"), F.col("score").alias("vector_score"))
    typed = queries.select("query_id", (t.query_type("text") if use_classifier else F.lit("general")).alias("query_type"))
    terms = lexical.asked(queries)
    near = cut_lineage(near)
    close = (corpus if texts is None else texts).join(sized(near.select("doc_id").distinct(), 16), "doc_id", "left_semi")
    hits = lexical.entries(close, lexical.terms_of(queries)).filter("term is not null")
    met = near.join(terms, "query_id").join(hits, ["doc_id", "term"])
    if bm25_weights:
        part = F.sum(F.col("qtf") * n.tf_part("tf", "len", F.lit(500.0), 1.5, 0.75))
        score = n.lexical_clamp(F.coalesce("part", F.lit(0.0)))
    else:
        part = F.count(F.lit(1))
        score = F.coalesce(F.col("part") / (F.col("size") + F.lit(1e-6)), F.lit(0.0))
        typed = typed.join(terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("size")), "query_id", "left")
    parts = met.groupBy("query_id", "doc_id").agg(part.alias("part"))
    scored = near.join(parts, ["query_id", "doc_id"], "left").join(typed, "query_id").withColumn("lexical_score", score).withColumn("w", t.query_weights("query_type"))
    out = scored.withColumn("combined_score", n.weighted("vector_score", "lexical_score", "w.vector_weight", "w.lexical_weight"))
    return ranked(out.select("query_id", "doc_id", "query_type", "vector_score", "lexical_score", "combined_score"), top_k, "combined_score")


def expanded(queries: DataFrame) -> DataFrame:
    """Queries without filler words, for any of the retrievers."""
    return queries.withColumn("text", t.expand_query("text"))


def rerank(candidates: DataFrame, score: Column, scaling: str, old_weight: float, new_weight: float, top_k: int | None = None, by: str = "query_id", id_col: str = "id") -> DataFrame:
    """Candidates (query_id, id, combined_score) with rerank_score scaled per query, final_score and rank. scaling: cross, batch or raw."""
    rows = candidates.withColumn("rerank_score", score)
    scaled = {"cross": lambda: min_max_eps("rerank_score", by), "batch": lambda: min_max("rerank_score", by), "raw": lambda: F.col("rerank_score")}[scaling]()
    return ranked(rows.withColumn("final_score", n.weighted("combined_score", scaled, old_weight, new_weight)), top_k, "final_score", id_col, (by,))


def cross_encoder(candidates: DataFrame, top_k: int | None = None, scorer: Column | None = None) -> DataFrame:
    """Weights .3 and .7. ``scorer`` may be a pandas UDF over query and text; without a model it is word overlap."""
    return rerank(candidates, t.lexical_overlap("query", "text") if scorer is None else scorer, "cross", 0.3, 0.7, top_k)


def lightweight(candidates: DataFrame, top_k: int | None = None) -> DataFrame:
    """Cosine of qvec and embedding as it is, weights .4 and .6."""
    return rerank(candidates, n.cosine("qvec", "embedding", 0.0), "raw", 0.4, 0.6, top_k)


def batch(candidates: DataFrame, top_k: int | None = None, scorer: Column | None = None) -> DataFrame:
    """Many requests at once, scaled within each, weights .3 and .7."""
    return rerank(candidates, t.lexical_overlap("query", "text") if scorer is None else scorer, "batch", 0.3, 0.7, top_k)


def drop_similar(results: DataFrame, threshold: float = 0.85, by: str = "query_id", rank: str = "rank", id_col: str = "id") -> DataFrame:
    """(query_id, id, rank): in rank order, a result goes if its words' Jaccard with one already kept is over the threshold.

    Results of a query are few, so the fold runs over one array per query inside the JVM."""
    rows = results.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(id_col).alias("id"), F.array_distinct(t.tokens("text")).alias("ws")))).alias("rs"))
    empty = F.filter("rs", lambda r: F.lit(False))
    kept = F.aggregate("rs", empty, lambda acc, r: F.when(F.exists(acc, lambda x: t.jaccard(x["ws"], r["ws"]) > threshold), acc).otherwise(F.concat(acc, F.array(r))))
    return rows.select(by, F.explode(kept).alias("r")).select(by, F.col("r.id").alias("id"), F.col("r.rank").alias("rank"))
