"""Queries over the lexical index and the vectors: search, fusion, reranking, context and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.functions import numeric as n
from granary.functions import text as t
from granary.operators import context, corpus, drift, embedding, evaluate, lexical, retrieval, service
from granary.plans import sql
from granary.plans.registry import query
from granary.runtime import checkpoint_dir, cut_lineage, sized, table

WORDS = "the orantion of und the hehely system"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries (query_id, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the vector of the same number as theirs: (query_id, text, qvec)."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return items(spark, sf_dir).join(v, "query_id")


def all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


# --- lexical

@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY ALL")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(documents(spark, sf_dir))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(postings_tf(spark, sf_dir))


@query(f"WITH k AS (SELECT {sql.tokens('text')} AS ts FROM documents) SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len, (SELECT count(DISTINCT w) FROM (SELECT unnest(ts) AS w FROM k)) AS n_terms FROM k")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(documents(spark, sf_dir))


@query(f"WITH {sql.bm25(f'''SELECT 0 AS query_id, '{WORDS}' AS text''', 10)} SELECT * FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(documents(spark, sf_dir), spark.createDataFrame([(0, WORDS)], "query_id int, text string"), 10)


@query(f"WITH {sql.bm25(sql.BENCHMARK, 10)} SELECT * FROM bm")
def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(documents(spark, sf_dir), items(spark, sf_dir), 10)


@query(f"WITH {sql.bm25(sql.BENCHMARK, 10, where='''lang = 'en' ''')} SELECT * FROM bm")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata filter reaches the scan before anything is scored."""
    return lexical.bm25(retrieval.where(documents(spark, sf_dir), {"lang": "en"}), items(spark, sf_dir), 10)


@query(f"""WITH q AS (SELECT '{WORDS}' AS q), k AS (SELECT doc_id, {sql.tokens('text')} AS ts FROM documents)
SELECT doc_id, list_sum(list_transform({sql.tokens('q')}, lambda w: CASE WHEN len(list_filter(ts, lambda x: x = w)) = 0 THEN 0::DOUBLE ELSE
 len(list_filter(ts, lambda x: x = w)) * 2.5::DOUBLE / (len(list_filter(ts, lambda x: x = w)) + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / 500)) END)) AS score FROM k CROSS JOIN q""")
def bm25_noidf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.bm25_without_idf(F.lit(WORDS), "text").alias("score"))


@query(f"SELECT doc_id, {sql.overlap('q', 'text')} AS overlap FROM documents CROSS JOIN (SELECT '{WORDS}' AS q)")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.lexical_overlap(F.lit(WORDS), "text").alias("overlap"))


@query(f"""WITH q AS ({sql.BENCHMARK}), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY ALL),
a AS (SELECT DISTINCT query_id, unnest({sql.tokens('text')}) AS term FROM q)
SELECT query_id, doc_id, string_agg(term || '=' || tf, '|' ORDER BY term) AS matches FROM p JOIN a USING (term) GROUP BY ALL""")
def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.term_matches(documents(spark, sf_dir), items(spark, sf_dir), joined=True)
    return rows.withColumnRenamed("term_matches", "matches")


# --- queries as text

def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query(f"WITH k AS (SELECT conv_id, turn, {sql.query_type('text')} AS query_type FROM conversations) SELECT *, {sql.weight('query_type', 0)} AS vector_weight, {sql.weight('query_type', 1)} AS lexical_weight FROM k")
def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("conv_id", "turn", t.query_type("text").alias("query_type"))
    return rows.withColumn("w", t.query_weights("query_type")).select("conv_id", "turn", "query_type", "w.*")


_FILLERS = ", ".join(f"'{w}'" for w in t.FILLERS)


@query(f"""WITH k AS (SELECT conv_id, turn, text, list_filter({sql.words('text')}, lambda w: lower(w) NOT IN ({_FILLERS})) AS kept FROM conversations)
SELECT conv_id, turn, CASE WHEN len(kept) < 2 THEN text ELSE array_to_string(kept, ' ') END AS expanded FROM k""")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.expanded(_turns(spark, sf_dir)).select("conv_id", "turn", F.col("text").alias("expanded"))


@query(f"""WITH k AS (SELECT conv_id, turn, CASE WHEN length(text) < 40 THEN 'small' WHEN {sql.contains_any('lower(text)', t.COMPLEX)} OR length(text) - length(replace(text, '?', '')) > 1 OR contains(lower(text), ' and ') THEN 'large' ELSE 'medium' END AS size FROM conversations)
SELECT *, CASE size WHEN 'large' THEN 'gpt-4.1' ELSE 'gpt-4.1-mini' END AS model FROM k""")
def model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", t.route_model("text").alias("size")).withColumn("model", t.model_name("size"))


# --- vectors

@query(f"WITH {sql.knn(sql.ALL_VECTORS, 10)} SELECT query_id, id, cos, score, rank FROM nn")
def vector_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn(vectors(spark, sf_dir), all_vectors(spark, sf_dir), 10)


@query(f"WITH {sql.knn('SELECT vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 20 = 0', 10)} SELECT query_id, id, score, rank FROM nn")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of all vectors, asked for every twentieth one's neighbours. All cells are probed, so that the answer is exact."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    c = retrieval.store_vectors(vectors(spark, sf_dir), path, cells=16)
    return retrieval.search_vectors(spark.read.parquet(path), c, all_vectors(spark, sf_dir).filter("query_id % 20 = 0"), 10, probes=16).select("query_id", "id", "score", "rank")


CENTRES = """cm AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
cc AS (SELECT label, list(m ORDER BY i) AS c FROM cm GROUP BY label),
ce AS (SELECT label, CASE WHEN list_dot_product(c, c) > 0 THEN list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) ELSE c END AS centroid FROM cc)"""


@query(f"WITH {CENTRES}, {sql.knn('SELECT label AS query_id, centroid AS qvec FROM ce', 10)} SELECT query_id, id, score, rank FROM nn")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every label's centroid."""
    centres = drift.centroids(vectors(spark, sf_dir), "label").select(F.col("label").alias("query_id"), F.col("centroid").alias("qvec"))
    return retrieval.knn(vectors(spark, sf_dir), centres, 10).select("query_id", "id", "score", "rank")


@query("""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: CASE WHEN i <= 8 THEN x::DOUBLE + 0.02::DOUBLE ELSE x::DOUBLE END) FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS near_id, list_cosine_similarity(a.v, b.v) AS similarity FROM m a JOIN m b ON b.vec_id < a.vec_id)
SELECT id, near_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, near_id) AS r FROM p WHERE similarity >= 0.95::DOUBLE) WHERE r = 1""")
def semantic_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector and a copy of it moved a little."""
    v = vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    moved = v.select(F.col("vec_id") + 1_000_000, F.transform("embedding", lambda x, i: F.when(i < 8, x + 0.02).otherwise(x)))
    return corpus.near_vectors(v.unionAll(moved))


def hashed_corpus(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """(doc_id, embedding) of every document by the hashing encoder, as counts: searches scale vectors themselves. Written out, as an index is."""
    rows = embedding.embed(documents(spark, sf_dir), normalize=False, now="2025-01-01T00:00:00Z", keep=keep)
    return cut_lineage(rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "embedding", *keep))


def hashed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item with its vector: (query_id, text, qvec)."""
    rows = embedding.embed(items(spark, sf_dir), normalize=False, now="2025-01-01T00:00:00Z", id_col="query_id", keep=("text",))
    return rows.select(F.col("doc_id").cast("bigint").alias("query_id"), "text", F.col("embedding").alias("qvec"))


def _hybrid(queries: str, k: int = 10) -> str:
    """CTEs up to hy(query_id, doc_id, query_type, vector_score, lexical_score, combined_score, rank); ``queries`` gives (query_id, text)."""
    return f"""hq AS ({queries}), hw AS (SELECT 'd' AS side, doc_id AS id, unnest({sql.tokens(f"left({sql.collapse('text')}, 2048)")}) AS w FROM documents
  UNION ALL SELECT 'q', query_id, unnest({sql.tokens(f"left({sql.collapse('text')}, 2048)")}) FROM hq),
hh AS (SELECT side, id, ('0x' || left(md5(w), 15))::BIGINT AS h FROM hw),
hv AS (SELECT side, id, h % 384 AS at, sum(1 - 2 * (h // 384 % 2))::DOUBLE AS x FROM hh GROUP BY ALL),
hn AS (SELECT side, id, sqrt(sum(x * x)) AS n FROM hv GROUP BY ALL HAVING sum(x * x) > 0),
dots AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS dot FROM hv q JOIN hv d ON q.at = d.at AND q.side = 'q' AND d.side = 'd' GROUP BY ALL),
pairs AS (SELECT q.query_id, d.doc_id FROM hq q CROSS JOIN documents d),
sim AS (SELECT p.query_id, p.doc_id, (1 + coalesce(dot / (a.n * b.n), 0)) / 2 AS vector_score FROM pairs p LEFT JOIN dots USING (query_id, doc_id) LEFT JOIN hn a ON a.side = 'q' AND a.id = p.query_id LEFT JOIN hn b ON b.side = 'd' AND b.id = p.doc_id),
nn AS (SELECT query_id, doc_id, vector_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, doc_id) AS r FROM sim) WHERE r <= {2 * k}),
k AS (SELECT nn.query_id, d.doc_id, vector_score, {sql.query_type('q.text')} AS query_type, {sql.tokens('q.text')} AS qs, {sql.tokens('d.text')} AS ts
  FROM nn JOIN documents d USING (doc_id) JOIN hq q USING (query_id)),
x AS (SELECT query_id, doc_id, query_type, vector_score, least(list_sum(list_transform(qs, lambda w: CASE WHEN len(list_filter(ts, lambda y: y = w)) = 0 THEN 0::DOUBLE ELSE
 len(list_filter(ts, lambda y: y = w)) * 2.5::DOUBLE / (len(list_filter(ts, lambda y: y = w)) + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / 500)) END)) / 5, 1) AS lexical_score FROM k),
y AS (SELECT *, vector_score * {sql.weight('query_type', 0)} + lexical_score * {sql.weight('query_type', 1)} AS combined_score FROM x),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined_score, 9) DESC, doc_id) AS rank FROM y) WHERE rank <= {k})"""


@query(f"WITH {_hybrid(sql.BENCHMARK)} SELECT * FROM hy")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item over all documents, both with computed vectors."""
    return retrieval.hybrid(hashed_corpus(spark, sf_dir), hashed_items(spark, sf_dir), 10, texts=documents(spark, sf_dir))


@query(f"""WITH hy0 AS (SELECT item_id AS query_id, text, list_filter({sql.words('text')}, lambda w: lower(w) NOT IN ({', '.join(f"'{w}'" for w in t.FILLERS)})) AS kept FROM benchmark),
{_hybrid("SELECT query_id, CASE WHEN len(kept) < 2 THEN text ELSE array_to_string(kept, ' ') END AS text FROM hy0", 5)} SELECT query_id, doc_id, query_type, combined_score, rank FROM hy""")
def hybrid_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval with expansion, end to end: filler words go before the query is embedded and scored."""
    queries = embedding.embed(retrieval.expanded(items(spark, sf_dir)), normalize=False, now="2025-01-01T00:00:00Z", id_col="query_id", keep=("text",))
    ready = queries.select(F.col("doc_id").cast("bigint").alias("query_id"), "text", F.col("embedding").alias("qvec"))
    return retrieval.hybrid(hashed_corpus(spark, sf_dir), ready, 5, texts=documents(spark, sf_dir)).select("query_id", "doc_id", "query_type", "combined_score", "rank")


@query(f"WITH {sql.bm25(sql.BENCHMARK, 10)} SELECT * FROM bm")
def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written once, sorted by term, then searched: no text is read by the search."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    lexical.store(lexical.entries(documents(spark, sf_dir)), path)
    return lexical.search(spark.read.parquet(path), items(spark, sf_dir), 10)


# --- fusion

def best_by_bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """BM25's ``k`` best of every item, hinted for broadcast where they are few, so that texts that are joined to them stay where they lie."""
    return sized(lexical.bm25(documents(spark, sf_dir), items(spark, sf_dir), k), 64)


def lists(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """(query_id, id, system, score): the 50 best of both systems for every item; ``found``: BM25's, if known."""
    near = retrieval.knn(vectors(spark, sf_dir), item_vectors(spark, sf_dir).select("query_id", "qvec"), 50)
    found = lexical.bm25(documents(spark, sf_dir), items(spark, sf_dir), 50) if found is None else found
    return near.select("query_id", "id", F.lit("vector").alias("system"), "score").unionAll(found.select("query_id", F.col("doc_id").alias("id"), F.lit("lexical").alias("system"), "score"))


LISTS = f"""{sql.knn(sql.ITEM_VECTORS, 50)}, {sql.bm25(sql.BENCHMARK, 50)},
ls AS (SELECT query_id, id, 'vector' AS system, score, rank FROM nn UNION ALL SELECT query_id, doc_id, 'lexical', score, rank FROM bm)"""
SIDES = """sd AS (SELECT query_id, id, coalesce(max(score) FILTER (system = 'vector'), 0) AS vector_score, coalesce(max(score) FILTER (system = 'lexical'), 0) AS lexical_score,
max(x) FILTER (system = 'vector') AS vx, max(x) FILTER (system = 'lexical') AS lx FROM sc GROUP BY query_id, id)"""
WEIGHTED = f"""{LISTS}, mm AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM ls WINDOW w AS (PARTITION BY query_id, system)),
sc AS (SELECT *, CASE WHEN hi = lo THEN 1::DOUBLE ELSE (score - lo) / (hi - lo) END AS x FROM mm), {SIDES},
fu AS (SELECT query_id, id, vector_score, lexical_score, coalesce(vx, 0) * 0.7::DOUBLE + coalesce(lx, 0) * 0.3::DOUBLE AS fused_score FROM sd)"""
RRF = f"""{LISTS}, sc AS (SELECT *, rank AS x FROM ls), {SIDES},
fu AS (SELECT query_id, id, vector_score, lexical_score, 0.7::DOUBLE / (60 + coalesce(vx, 1000)) + 0.3::DOUBLE / (60 + coalesce(lx, 1000)) AS fused_score FROM sd)"""
RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 9) DESC, id) AS rank FROM "


@query(f"WITH {WEIGHTED} {RANKED} fu")
def fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(lists(spark, sf_dir))


@query(f"WITH {RRF} {RANKED} fu")
def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(lists(spark, sf_dir), "rrf")


@query(f"""WITH {LISTS}, z AS (SELECT *, stddev_pop(score) OVER w AS sd, avg(score) OVER w AS mean FROM ls WINDOW w AS (PARTITION BY query_id, system))
SELECT query_id, id, system, CASE WHEN sd = 0 THEN 0.5::DOUBLE ELSE 1 / (1 + exp(-(score - mean) / sd)) END AS x FROM z""")
def zscore_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select("query_id", "id", "system", retrieval.normalize("score", "zscore", "query_id", "system").alias("x"))


@query(f"""WITH {WEIGHTED}, bo AS (SELECT query_id, fu.id, fused_score * CASE d.lang WHEN 'en' THEN 1.2::DOUBLE WHEN 'fr' THEN 0.8::DOUBLE ELSE 1 END AS fused_score FROM fu LEFT JOIN documents d ON d.doc_id = fu.id) {RANKED} bo""")
def metadata_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang")
    return retrieval.boost(fuse_weighted(spark, sf_dir), meta, "lang", {"en": 1.2, "fr": 0.8}).select("query_id", "id", "fused_score", "rank")


# --- reranking

@query(f"""WITH {sql.knn(sql.ALL_VECTORS, 20)}, r AS (SELECT query_id, id, 0.4::DOUBLE * score + 0.6::DOUBLE * cos AS final_score FROM nn)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, id) AS rank FROM r) WHERE rank <= 5""")
def rerank_lightweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.knn(vectors(spark, sf_dir), all_vectors(spark, sf_dir), 20).select("query_id", "id", F.col("score").alias("combined_score"))
    rows = near.join(all_vectors(spark, sf_dir), "query_id").join(vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding"), "id")
    return retrieval.lightweight(rows, 5).select("query_id", "id", "final_score", "rank")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id, query, text, source, combined_score): BM25's 20 best of each item, with texts."""
    best = best_by_bm25(spark, sf_dir, 20).select("query_id", F.col("doc_id").alias("id"), F.col("score").alias("combined_score"))
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source").join(best, "id")
    return texts.join(items(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")


CANDIDATES = f"""{sql.bm25(sql.BENCHMARK, 20)}, ca AS (SELECT bm.query_id, bm.doc_id AS id, bm.score AS combined_score, {sql.overlap('b.text', 'd.text')} AS o
FROM bm JOIN benchmark b ON b.item_id = bm.query_id JOIN documents d ON d.doc_id = bm.doc_id),
cm AS (SELECT *, min(o) OVER w AS lo, max(o) OVER w AS hi, count(*) OVER w AS c FROM ca WINDOW w AS (PARTITION BY query_id))"""
_CUT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, id) AS rank FROM r) WHERE rank <= 10"


@query(f"WITH {CANDIDATES}, r AS (SELECT query_id, id, o AS rerank_score, combined_score * 0.3::DOUBLE + CASE WHEN c = 1 THEN 1 ELSE (o - lo) / (hi - lo + 1e-6::DOUBLE) END * 0.7::DOUBLE AS final_score FROM cm) {_CUT}")
def rerank_cross_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cross_encoder(candidates(spark, sf_dir), 10).select("query_id", "id", "rerank_score", "final_score", "rank")


@query(f"WITH {CANDIDATES}, r AS (SELECT query_id, id, o AS rerank_score, combined_score * 0.3::DOUBLE + CASE WHEN hi = lo THEN 1 ELSE (o - lo) / (hi - lo) END * 0.7::DOUBLE AS final_score FROM cm) {_CUT}")
def rerank_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.batch(candidates(spark, sf_dir), 10).select("query_id", "id", "rerank_score", "final_score", "rank")


@query(f"""WITH RECURSIVE {CANDIDATES}, r AS (SELECT query_id, id, combined_score * 0.3::DOUBLE + CASE WHEN hi = lo THEN 1 ELSE (o - lo) / (hi - lo) END * 0.7::DOUBLE AS final_score FROM cm),
rr AS MATERIALIZED (SELECT query_id, id, rank, list_distinct({sql.tokens('text')}) AS ws FROM ({_CUT}) k JOIN documents ON doc_id = id),
f(query_id, rank, id, ok, kept) AS (SELECT query_id, rank, id, true, [ws] FROM rr WHERE rank = 1 UNION ALL
  SELECT query_id, rank, id, fresh, CASE WHEN fresh THEN list_append(kept, ws) ELSE kept END FROM (SELECT n.query_id, n.rank, n.id, n.ws, f.kept, len(list_filter(f.kept, lambda k: {sql.jaccard('k', 'n.ws')} > 0.85)) = 0 AS fresh FROM f JOIN rr n ON n.query_id = f.query_id AND n.rank = f.rank + 1))
SELECT query_id, id, rank FROM f WHERE ok""")
def rerank_and_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked to ten, then results too like an earlier one go."""
    return retrieval.drop_similar(retrieval.batch(candidates(spark, sf_dir), 10))


# --- context

def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.batch(candidates(spark, sf_dir), 10)
    return rows.select("query_id", "rank", "id", F.col("id").alias("doc_id"), F.col("source").alias("title"), "text", F.col("final_score").alias("score"))


def _filled(budget: int) -> str:
    """CTEs up to cx: the chunks rr(query_id, rank, id, source, text, final_score) filled in by rank, one more a step."""
    head = "'[Source ' || n.rank || '] doc=' || n.id || ' chunk=' || n.id || ' | score: ' || format('{:.2f}', n.final_score) || CASE WHEN coalesce(n.source, '') <> '' THEN chr(10) || 'Title: ' || n.source ELSE '' END"
    gap, cut = "chr(10) || chr(10)", "list_slice(ws, 1, greatest(room - hc - 20, 0))"
    return f"""rr AS MATERIALIZED (SELECT query_id, k.rank, k.id, source, text, final_score, {sql.words('text')} AS ws FROM ({_CUT}) k JOIN documents ON doc_id = k.id),
fl(query_id, rank, used, included, truncated, context, sources, stop) AS (SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, 0, 0, '', '', false FROM rr UNION ALL
  SELECT query_id, rank, CASE WHEN halt THEN used ELSE used + lead + len({sql.words('body')}) END, CASE WHEN halt THEN included ELSE included + 1 END, CASE WHEN over AND NOT halt THEN truncated + 1 ELSE truncated END,
    CASE WHEN halt THEN context ELSE context || CASE WHEN included > 0 THEN {gap} || '---' || {gap} ELSE '' END || body END, CASE WHEN halt THEN sources ELSE concat_ws(',', nullif(sources, ''), id::VARCHAR) END, halt
  FROM (SELECT *, over AND room <= 200 AS halt, head || {gap} || CASE WHEN over THEN array_to_string({cut}, ' ') || '...' ELSE text END AS body
    FROM (SELECT *, {budget} - used - lead AS room, used + lead + hc + len(ws) > {budget} AS over
      FROM (SELECT f.query_id, n.rank, f.used, f.included, f.truncated, f.context, f.sources, n.id, n.text, n.ws, CASE WHEN f.included > 0 THEN 1 ELSE 0 END AS lead, {head} AS head, len({sql.words(head)}) AS hc
        FROM fl f JOIN rr n ON n.query_id = f.query_id AND n.rank = f.rank + 1 WHERE NOT f.stop)))),
cx AS (SELECT query_id::VARCHAR AS query_id, context, used::INTEGER AS token_count, included::INTEGER AS chunks_included, truncated::INTEGER AS chunks_truncated, sources FROM fl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1)"""


@query(f"""WITH RECURSIVE {CANDIDATES}, r AS (SELECT query_id, id, combined_score * 0.3::DOUBLE + CASE WHEN hi = lo THEN 1 ELSE (o - lo) / (hi - lo) END * 0.7::DOUBLE AS final_score FROM cm),
{_filled(1500)} SELECT * FROM cx""")
def context_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.assemble(results(spark, sf_dir), budget=1500)
    return rows.withColumn("sources", F.array_join(F.transform("sources", lambda x: x["doc_id"]), ","))


SIMPLE = f"""{sql.bm25(sql.BENCHMARK, 3)}, sc AS (SELECT query_id, string_agg('[Chunk ' || rank || '] doc=' || doc_id || ' chunk=' || (rank - 1) || chr(10) || coalesce(d.text, ''), chr(10) || chr(10) ORDER BY rank) AS context
FROM bm JOIN documents d USING (doc_id) GROUP BY query_id)"""


@query(f"WITH {SIMPLE} SELECT * FROM sc")
def context_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text").join(best_by_bm25(spark, sf_dir, 3), "doc_id").withColumn("chunk_id", F.lit(None).cast("string"))
    return context.simple_context(rows)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_KINDS = {"general": "grounded_qa", "factual": "structured", "exploratory": "summarization", "navigational": "compliance"}


@query(f"""WITH {SIMPLE}, k AS (SELECT query_id, context, b.text AS query, {sql.query_type('b.text')} AS kind FROM sc JOIN benchmark b ON b.item_id = query_id)
SELECT query_id, replace(replace(CASE kind {' '.join(f"WHEN '{k}' THEN {_q(context.PROMPTS[v])}" for k, v in _KINDS.items())} END, '{{query}}', query), '{{context}}', context) AS prompt FROM k""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context_simple(spark, sf_dir).join(items(spark, sf_dir), "query_id").withColumn("type", t.query_type("text"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("type"))
    return rows.select("query_id", context.prompt("context", "text", kind).alias("prompt"))


@query(f"""WITH s AS (SELECT source, list(len({sql.words('text')}) ORDER BY doc_id) AS ts, count(*) AS n FROM documents GROUP BY source)
SELECT source, CASE WHEN n = 0 THEN 0 ELSE greatest(3, least(floor(3000 / (list_sum(ts[:5])::DOUBLE / len(ts[:5]) + 50))::INTEGER, 10, n)) END::BIGINT AS chunks FROM s""")
def adaptive_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source fit a context. Only the sizes of the first five of a source are gathered."""
    d = documents(spark, sf_dir).select("source", "doc_id", t.word_count("text").alias("w"))
    placed = d.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("doc_id")))
    s = placed.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "w")))), lambda x: x["w"]).alias("ts"), F.count(F.lit(1)).alias("n"))
    return s.select("source", n.chunk_count("ts", "n", 3000).cast("bigint").alias("chunks"))


@query()
def answer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item answered end to end from all documents, the first source standing in for a model."""
    return service.answer(hashed_corpus(spark, sf_dir, "text", "source"), hashed_items(spark, sf_dir), service.first_source, title_col="source")


# --- evaluation

def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, retrieved, expected, latency_ms): reciprocal rank fusion held against BM25's five best."""
    found = lexical.bm25(documents(spark, sf_dir), items(spark, sf_dir), 50)
    fused = retrieval.fuse(lists(spark, sf_dir, found), "rrf").filter("rank <= 10").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("retrieved"))
    best = found.filter("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("expected"))
    return fused.join(best, "query_id").withColumn("latency_ms", F.col("query_id").cast("double") * 1.5)


METRICS = f"""{RRF}, rk AS (SELECT * FROM ({RANKED} fu) WHERE rank <= 10), ex AS (SELECT query_id, doc_id FROM bm WHERE rank <= 5),
h AS (SELECT rk.query_id, rk.rank, ex.doc_id IS NOT NULL AS hit FROM rk LEFT JOIN ex ON ex.query_id = rk.query_id AND ex.doc_id = rk.id),
a AS (SELECT query_id, count(*) AS got, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS dcg FROM h GROUP BY query_id),
e AS (SELECT query_id, count(*) AS want FROM ex GROUP BY query_id),
i AS (SELECT a.*, want, (SELECT sum(1 / log2(r.range + 2)) FROM range(10) r WHERE r.range < least(want, got)) AS ideal FROM a JOIN e USING (query_id)),
m AS (SELECT query_id, hits / want::DOUBLE AS recall, hits / got::DOUBLE AS precision, coalesce(1 / first::DOUBLE, 0) AS mrr, dcg / ideal AS ndcg, query_id * 1.5::DOUBLE AS latency_ms FROM i),
mt AS (SELECT *, 0.6::DOUBLE * recall + 0.4::DOUBLE * precision AS score FROM m)"""


@query(f"WITH {METRICS} SELECT * FROM mt")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(runs(spark, sf_dir)).drop("retrieved", "expected")


@query(f"""WITH {METRICS} SELECT count(*) AS n_queries, {', '.join(f'avg({c}) AS mean_{c}' for c in ('score', 'recall', 'precision', 'mrr', 'ndcg'))},
quantile_cont(latency_ms, 0.5) AS p50_latency, quantile_cont(latency_ms, 0.95) AS p95_latency, quantile_cont(latency_ms, 0.99) AS p99_latency FROM mt""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(eval_metrics(spark, sf_dir))


@query(f"""WITH {METRICS} SELECT avg(recall) FILTER (query_id >= 20) - avg(recall) FILTER (query_id < 20) AS delta_recall, avg(ndcg) FILTER (query_id >= 20) - avg(ndcg) FILTER (query_id < 20) AS delta_ndcg FROM mt""")
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eval_metrics(spark, sf_dir).withColumn("run_id", F.when(F.col("query_id") < 20, "a").otherwise("b"))
    return evaluate.compare(rows.groupBy("run_id").agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg")), "a", "b")


@query(f"""WITH {METRICS} SELECT {', '.join(f'avg({c}) FILTER (query_id >= 20) - avg({c}) FILTER (query_id < 20) AS delta_mean_{c}' for c in ('score', 'recall', 'precision', 'mrr', 'ndcg'))},
count(*) FILTER (query_id >= 20) - count(*) FILTER (query_id < 20) AS delta_n_queries, quantile_cont(latency_ms, 0.5) FILTER (query_id >= 20) - quantile_cont(latency_ms, 0.5) FILTER (query_id < 20) AS delta_p50_latency FROM mt""")
def eval_stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs written to the stored tables and compared from there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    rows = cut_lineage(eval_metrics(spark, sf_dir))
    for run, part in (("a", rows.filter("query_id < 20")), ("b", rows.filter("query_id >= 20"))):
        evaluate.save_run(part, path, run, "1", "2025-01-01 00:00:00")
    return evaluate.compare_stored(spark, path, "a", "b").drop("delta_p95_latency", "delta_p99_latency")


# --- drift

@query(f"WITH {CENTRES} SELECT label, unnest(centroid) AS x, generate_subscripts(centroid, 1)::INTEGER AS i FROM ce")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.centroids(vectors(spark, sf_dir), "label").select("label", F.posexplode("centroid").alias("i", "x")).withColumn("i", F.col("i") + 1)


DRIFT = f"{CENTRES}, dr AS (SELECT label, avg(list_cosine_similarity(embedding::DOUBLE[], centroid)) AS drift_score FROM embeddings JOIN ce USING (label) GROUP BY label)"


@query(f"WITH {DRIFT} SELECT * FROM dr")
def drift_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_scores(vectors(spark, sf_dir), drift.centroids(vectors(spark, sf_dir), "label"), "label")


@query(f"WITH {DRIFT} SELECT label, drift_score, CASE WHEN drift_score < 0.7 THEN 'high' WHEN drift_score < 0.85 THEN 'medium' ELSE 'low' END AS severity, 0.9::DOUBLE AS threshold FROM dr WHERE drift_score < 0.9")
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.alerts(drift_by_label(spark, sf_dir))


@query(f"""WITH {DRIFT} SELECT label, drift_score, count(*) OVER u AS checks, (sum((drift_score < 0.9)::INTEGER) OVER u)::BIGINT AS alerts, max(1 - drift_score) OVER u AS max_drift, avg(drift_score) OVER r AS recent_mean, min(drift_score) OVER r AS recent_min FROM dr
WINDOW u AS (ORDER BY label ROWS UNBOUNDED PRECEDING), r AS (ORDER BY label ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def drift_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_stats(drift_by_label(spark, sf_dir), "label")


@query(f"""WITH {CENTRES}, p AS (SELECT label, centroid AS a, lead(centroid) OVER (ORDER BY label) AS b FROM ce), m AS (SELECT label, list_transform(range(1, len(a) + 1), lambda i: 0.9::DOUBLE * a[i] + 0.1::DOUBLE * b[i]) AS v FROM p WHERE b IS NOT NULL),
u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM m)
SELECT label, unnest(v) AS x, generate_subscripts(v, 1)::INTEGER AS i FROM u""")
def drift_reference_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's centroid moved towards the next one's."""
    c = drift.centroids(vectors(spark, sf_dir), "label").withColumn("b", F.lead("centroid").over(W.orderBy("label"))).filter("b is not null")
    return c.select("label", F.posexplode(drift.moved("centroid", "b")).alias("i", "x")).withColumn("i", F.col("i") + 1)
