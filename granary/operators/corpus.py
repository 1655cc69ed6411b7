"""Ingestion: file tables to normalised documents, deduplication, statistics and the stored index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from granary.functions import text as t
from granary.operators import buckets
from granary.operators.vectors import sign_bands
from granary.runtime import cut_lineage, frugal


def normalize(files: DataFrame, tenant: str = "default", patterns: list[str] | None = None, now: str | None = None, quotes: bool = False) -> DataFrame:
    """(doc_id, text, success, errors, warnings, metadata) from rows (path, content, length, modificationTime).

    A failure is a row with success false. ``now`` fixes the time of ingestion."""
    decoded = F.call_function("make_valid_utf8", F.col("content").cast("string"))
    clean = t.strip_boilerplate(t.clean_ocr(decoded, quotes), patterns)
    rows = files.withColumn("text", clean).withColumn("name", F.element_at(F.split("path", "/"), -1))
    errors = F.array_compact(F.array(F.when(F.col("length") > MAX_BYTES, "file too large"), F.when(F.coalesce(F.col("text"), F.lit("")) == "", "no text")))
    meta = F.map_from_arrays(
        F.array(*map(F.lit, ("source_path", "filename", "file_extension", "filesize_bytes", "modified_at", "tenant_id", "ingested_at", "content_hash", "char_count", "word_count"))),
        F.array(
            F.col("path"), F.col("name"), F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)), F.col("length").cast("string"),
            F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(tenant),
            F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            t.content_hash("text"), F.length("text").cast("string"), t.word_count("text").cast("string"),
        ),
    )
    warnings = F.array_compact(F.array(F.when(F.contains(decoded, F.lit("�")), "invalid bytes replaced")))
    return rows.select(t.content_hash("text").alias("doc_id"), "text", (F.size(errors) == 0).alias("success"), errors.alias("errors"), warnings.alias("warnings"), meta.alias("metadata"))


MAX_BYTES = 50 * 1024 * 1024


def override_metadata(df: DataFrame, extra: dict[str, str], column: str = "metadata") -> DataFrame:
    """Metadata with ``extra`` over it: the later value of a key wins."""
    if not extra:
        return df
    more = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv])
    return df.withColumn(column, F.map_concat(F.map_filter(column, lambda k, _: ~k.isin(*extra)), more))


def first_of_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's hash, the first id with it, and whether it is a duplicate of that. Only ids and hashes are shuffled."""
    hashed = docs.select(F.col(id_col).alias("doc_id"), t.content_hash(text_col).alias("content_hash"))
    first = F.min("doc_id").over(W.partitionBy("content_hash"))
    return hashed.withColumn("existing_doc_id", first).withColumn("is_duplicate", F.col("doc_id") != F.col("existing_doc_id"))


def against_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New documents whose content is neither stored nor earlier among themselves."""
    fresh = first_of_content(new).filter("not is_duplicate").select("doc_id", "content_hash")
    known = stored.select(t.content_hash("text").alias("content_hash")).distinct()
    return new.join(fresh.join(known, "content_hash", "left_anti").select("doc_id"), "doc_id", "left_semi")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", bands: int = 24, bits: int = 14, seed: int = 3, block: int = 2048) -> DataFrame:
    """(id, near_id, similarity) of each vector with the most similar earlier one at or over the threshold.

    Vectors meet if all signs of ``bits`` random projections agree in one of ``bands`` bands, and are then compared exactly. At a cosine of .95
    a pair meets with probability 1 - (1 - .899 ** 14) ** 24 = .997; unlike vectors share a key with probability 2 ** -14 a band. Equal
    vectors are one class, named by its least id, which is what the others are nearest to. Pairs aren't emitted: a cell gives each of its vectors the nearest earlier one in it,
    and a key that many share is cut into blocks."""
    signed = cut_lineage(sign_bands(vectors, id_col, vector_col, bands, bits, seed))
    classes = cut_lineage(signed.groupBy("v").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("size")).withColumn("class", F.monotonically_increasing_id()))
    several = classes.filter("size > 1").select("v", F.col("id").alias("near_id"))
    same = signed.select("id", "v").join(several, "v").filter("id <> near_id").select("id", "near_id", F.lit(1.0).alias("similarity"))
    keyed = classes.select(F.explode("keys").alias("key"), F.col("class").alias("id"))
    entries = buckets.cells(keyed, block).withColumnRenamed("id", "class").join(classes.select("class", "id", "v"), "class")
    ordered = buckets.gathered(entries).select("key", "x", "y", "side", "id", "v")
    kind = classes.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("near_id", kind), T.StructField("similarity", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in buckets.whole(batches):
            of = buckets.numbered(cells)
            side, ids = cells.column("side").to_numpy(), cells.column("id").combine_chunks()
            v = cells.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(cells.num_rows, -1)
            order = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
            found = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                for at in range(lo, hi, 256):
                    end = min(at + 256, hi)
                    cos, met = v[at:end] @ v[lo:hi].T, side[at:end, None] + side[None, lo:hi]
                    fits = ((met == 0) | (met == 3)) & (order[None, lo:hi] < order[at:end, None]) & (cos >= threshold)
                    cos = np.where(fits, np.round(cos, 9), -np.inf)
                    top = cos.max(1)
                    least = np.argmin(np.where(cos == top[:, None], order[None, lo:hi], np.iinfo(np.int64).max), axis=1)
                    hit = np.flatnonzero(top > -np.inf)
                    found.append((at + hit, lo + least[hit], np.einsum("ij,ij->i", v[at + hit], v[lo + least[hit]])))
            a, b, s = (np.concatenate([f[i] for f in found]) for i in range(3))
            if len(a):
                yield pa.record_batch([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s)], schema.names)

    hits = ordered.mapInArrow(frugal(nearest), schema)
    best = hits.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "near_id"))).filter("r = 1")
    return best.select("id", "near_id", "similarity").unionAll(same)


def ingestion_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of counters over documents (doc_id, text): total, processed, failed, duplicates, characters and words of the processed."""
    rows = docs.select("doc_id", F.length(text_col).alias("chars"), t.word_count(text_col).alias("words"), t.content_hash(text_col).alias("h"), (F.coalesce(t.collapse(text_col), F.lit("")) != "").alias("ok"))
    first = rows.filter("ok").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "chars", "words")).alias("d"))
    kept = first.agg(F.count(F.lit(1)).alias("successful"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.sum("d.chars").alias("total_chars"), F.sum("d.words").alias("total_words"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("failed")).crossJoin(kept)


def add_to_index(chunks: DataFrame, path: str, tenant_col: str = "tenant_id", model: str | None = None, version: str | None = None) -> None:
    """Append rows to a vector table, stamped with model and version and laid out by tenant for pruning."""
    out = chunks
    if model:
        out = out.withColumn("embedding_model", F.lit(model)).withColumn("embedding_version", F.lit(version))
    out.write.partitionBy(tenant_col).mode("append").parquet(path)


def by_ids(index: DataFrame, ids: list[str], id_col: str = "id") -> DataFrame:
    return index.filter(F.col(id_col).isin(ids))


def without_documents(index: DataFrame, doc_ids: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """The index without all chunks of some documents, however many they have. Write it to a new version's path."""
    return index.join(doc_ids.select(doc_col).distinct(), doc_col, "left_anti")
