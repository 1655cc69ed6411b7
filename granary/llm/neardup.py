"""Near duplicates: b-bit MinHash signatures joined by a multi-index Hamming search.

A signature has ``k`` positions of ``bits`` bits, cut into k / r chunks of ``r`` positions. If
two signatures differ in at most D = chunks * (errors + 1) - 1 positions, then by the pigeonhole
principle some chunk differs in at most ``errors`` of them, so the chunks agree once those positions
are left out. Each signature is therefore indexed under every chunk with every choice of
``errors`` positions masked; pairs that meet under a key are verified on the whole signature, and count
under the first key that they share only. Every pair within D is found: nothing is capped.

Equal signatures are one class, with a size. Pairs are never emitted: what a bucket gives
is, for each class in it, how many documents it is near to and one link of a spanning forest. So the output has a row for each
document and grows with them, whatever the groups. A key that more than ``block`` classes share is cut into blocks by hash,
and each two of its blocks meet in a task of their own; no bucket is ever held in one row.

Defined results: texts are compared by their lower-cased words, in shingles of ``width`` words
(a shorter text is one shingle). Null texts and texts without a word have no signature: they
are near nothing and stay. A row without a doc_id is linked to nothing, has no row in :func:`groups` and stays. Rows that repeat a
doc_id count once, with the least signature. Ids may be of any type that can be ordered. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernel
from granary.llm.common import fresh, map_batches, sized
from granary.operators import buckets
from granary.runtime import cut_lineage, frugal, ship


@dataclass(frozen=True)
class Index:
    """Parameters; with the defaults a pair counts as near if at most 29 of 60 positions differ (Jaccard of about 0.52): copies with a few
    words changed lie above 0.6, documents that share no more than a passage below 0.35."""

    k: int = 60
    r: int = 4
    errors: int = 1
    bits: int = 16
    width: int = 2
    seed: int = 7

    def __post_init__(self) -> None:
        if self.k % self.r or not 0 <= self.errors < self.r or not 1 <= self.bits <= 16:
            raise ValueError("k must be a multiple of r, errors less than r, bits 1 to 16")
        if self.chunks * len(self.masks) > 256:
            raise ValueError("at most 256 combinations of chunk and mask")

    @property
    def chunks(self) -> int:
        return self.k // self.r

    @property
    def distance(self) -> int:
        return self.chunks * (self.errors + 1) - 1

    @property
    def masks(self) -> list[tuple[int, ...]]:
        """The positions of a chunk that each mask keeps; the first mask leaves out the last positions."""
        return list(combinations(range(self.r), self.r - self.errors))


def shingles(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of a slice and their rows, in row order."""
    h, rows = kernel.word_hashes(buf, offs)
    if not len(h):
        return h, rows
    counts = np.bincount(rows, minlength=len(offs) - 1)
    out = h.copy()
    span = np.minimum(counts[rows], width)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(len(h)) - first[rows]
    for j in range(1, width):
        ok = span > j
        idx = np.minimum(np.arange(len(h)) + j, len(h) - 1)
        out = np.where(ok, kernel.mix(out) + h[idx], out)
    keep = at <= counts[rows] - span
    return kernel.mix(out[keep]), rows[keep]


def signatures(texts: pa.Array, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """uint16 signatures, k by row, and which rows have a word and so a signature."""
    rng = np.random.default_rng(index.seed)
    a = rng.integers(1, 2**63, index.k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, index.k, dtype=np.uint64)
    out = np.zeros((len(texts), index.k), np.uint16)
    some = np.zeros(len(texts), bool)
    low = np.uint64((1 << index.bits) - 1)
    for at, buf, offs in kernel.slices(texts):
        g, rows = shingles(buf, offs, index.width)
        if not len(g):
            continue
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        where = at + rows[starts]
        some[where] = True
        for p in range(index.k):
            least = np.minimum.reduceat((g * a[p] + b[p]) >> np.uint64(1), starts)
            out[where, p] = (kernel.mix(least) & low).astype(np.uint16)
    return out, some


def index_keys(sig: np.ndarray, index: Index) -> np.ndarray:
    """64-bit keys of each signature: 56 bits of hash above 8 that name the chunk and mask."""
    keys = np.empty((len(sig), index.chunks * len(index.masks)), np.uint64)
    wide = sig.astype(np.uint64)
    at = 0
    for c in range(index.chunks):
        for m, kept in enumerate(index.masks):
            h = np.full(len(sig), index.seed, np.uint64)
            for p in kept:
                h = kernel.mix(h) ^ wide[:, c * index.r + p]
            keys[:, at] = (kernel.mix(h) << np.uint64(8)) | np.uint64(c * len(index.masks) + m)
            at += 1
    return keys


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(values.reshape(-1), kind))


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = len(rows), rows.shape[1] * rows.itemsize
    offsets = np.arange(0, n * width + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def sign(docs: DataFrame, id_col: str, text_col: str, index: Index) -> DataFrame:
    """(id, sig) of the rows that have a doc_id; sig is null without a word."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig, some = signatures(batch.column(1), index)
        return pa.record_batch([batch.column(0), pc.if_else(pa.array(some), _binary(sig), None)], ["id", "sig"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_col)
    return map_batches(rows, run, f"id {rows.schema[0].dataType.simpleString()}, sig binary")


PAIRS_AT_ONCE = 1 << 16


def paired(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) with low[i] <= j < high[i], some at a time."""
    count = np.maximum(high - low, 0)
    upto = np.cumsum(count)
    at = 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = count[at:end]
        i = np.repeat(np.arange(at, end), n)
        yield i, low[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = end


def within(i: np.ndarray, j: np.ndarray, sig: np.ndarray, place: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of signatures those within the distance whose first shared key is the one they are listed under; place: its chunk and mask."""
    differ = sig[i] != sig[j]
    near = np.flatnonzero(differ.sum(1, dtype=np.int16) <= index.distance)
    if not len(near):
        return i[:0], j[:0]
    wrong = differ[near].reshape(len(near), index.chunks, index.r)
    chunk = np.argmax(wrong.sum(2) <= index.errors, axis=1)
    bad = wrong[np.arange(len(near)), chunk]
    shared = np.stack([~bad[:, list(kept)].any(1) for kept in index.masks], 1)
    near = near[chunk * len(index.masks) + np.argmax(shared, axis=1) == place[i[near]]]
    return i[near], j[near]


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j in place; a label is the least row of a component, once all pointers are followed."""
    while len(i):
        x, y = label[i], label[j]
        go = x != y
        i, j, x, y = i[go], j[go], x[go], y[go]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            onward = label[label]
            if (onward == label).all():
                break
            label[:] = onward


def bucket_links(bucket: np.ndarray, side: np.ndarray, place: np.ndarray, size: np.ndarray, sig: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """By row: documents of its bucket that it is near to, and the row that its component is named by. Rows are sorted by bucket and side; rows of side 0 meet each
    other and those of side 2, rows of side 1 only those of side 2."""
    n, label = np.zeros(len(bucket), np.int64), np.arange(len(bucket))
    cut = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    first = np.flatnonzero(cut)
    of = np.cumsum(cut) - 1
    end = np.append(first[1:], len(bucket))
    twos = first + np.add.reduceat((side < 2).astype(np.int64), first)  # where side 2 begins
    low = np.where(side == 0, np.arange(len(bucket)) + 1, twos[of])
    high = np.where(side == 2, 0, end[of])
    for i, j in paired(low, high):
        i, j = within(i, j, sig, place, index)
        np.add.at(n, i, size[j])
        np.add.at(n, j, size[i])
        united(label, i, j)
    return n, label


def class_links(classes: DataFrame, index: Index, block: int = 2048) -> DataFrame:
    """(id, peer, n): of distinct signatures the documents near to them, and links that span each group. ``classes``: (id bigint, size, sig). Several rows an id."""
    ship(classes.sparkSession)

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, index.k)
        return pa.record_batch([batch.column(0), _lists(index_keys(sig, index).view(np.int64), pa.int64())], ["id", "keys"])

    keyed = map_batches(classes.select("id", "sig"), keys, "id bigint, keys array<bigint>").select("id", F.explode("keys").alias("key"))
    ordered = buckets.gathered(buckets.cells(keyed, block).join(classes, "id")).select("key", "x", "y", "side", "id", "size", "sig")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in buckets.whole(batches):
            key, side, ids, size = (cells.column(c).to_numpy() for c in ("key", "side", "id", "size"))
            sig = np.frombuffer(b"".join(cells.column("sig").to_pylist()), np.uint16).reshape(-1, index.k)
            n, label = bucket_links(buckets.numbered(cells), side, key & 255, size, sig, index)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.record_batch([pa.array(ids[some]), pa.array(ids[label[some]], mask=label[some] == some), pa.array(n[some])], ["id", "peer", "n"])

    return ordered.mapInArrow(frugal(match), "id bigint, peer bigint, n bigint")


def components(edges: DataFrame, a: str = "doc_id", b: str = "near_id") -> DataFrame:
    """(id, root): the least id of each connected component, by alternating large and small stars until nothing changes."""
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # Large star: every larger neighbour of u goes to the least of u and its neighbours.
        both = e.select("u", "v").unionAll(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut_lineage(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


HEAVY = 1024  # classes, the largest, whose members are found by broadcast; any other holds less than a thousandth of the rows


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None, block: int = 2048) -> DataFrame:
    """(doc_id, class_id, n_links): for each document the least doc_id of its group of near duplicates, linked one to the next, and how many other documents are
    within the distance of it. Every link counts, those between copies too."""
    index = index or Index()
    signed = cut_lineage(sign(docs, id_col, text_col, index).groupBy("id").agg(F.min("sig").alias("sig")))
    classes = signed.filter("sig is not null").groupBy("sig").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))
    links = cut_lineage(class_links(classes.select(F.col("class").alias("id"), "size", "sig"), index, block))
    roots = components(links.filter("peer is not null"), "id", "peer").toDF("class", "root")
    near = links.groupBy(F.col("id").alias("class")).agg(F.sum("n").alias("n"))
    linked = near.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")).join(classes.select("class", "least"), "class")
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    named = linked.join(names, "root").select("class", "n", "name")
    both = classes.join(named, "class", "left").filter("size > 1 or n is not null")
    full = cut_lineage(both.select("sig", F.coalesce("name", "least").alias("name"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), "size"))
    heavy = full.orderBy(F.desc("size"), "sig").limit(HEAVY)
    heavy = cut_lineage(heavy.select("sig", F.col("name").alias("hot_name"), F.col("n").alias("hot_n")))
    split = signed.filter("sig is not null").join(F.broadcast(heavy), "sig", "left")
    columns = lambda name, n: [F.col("id").alias("doc_id"), F.coalesce(name, "id").alias("class_id"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_links")]
    hot = split.filter("hot_n is not null").select(*columns("hot_name", "hot_n"))
    rest = split.filter("hot_n is null").select("id", "sig").join(full.select("sig", "name", "n"), "sig", "left").select(*columns("name", "n"))
    none = signed.filter("sig is null").select(*columns("id", F.lit(0)))
    return hot.unionAll(rest).unionAll(none)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None, block: int = 2048) -> DataFrame:
    """The rows of ``docs`` but for those whose group of near duplicates has a smaller doc_id."""
    (lose,) = fresh(docs, "loser")
    losers, _ = sized(groups(docs, id_col, text_col, index, block).filter("class_id <> doc_id").select(F.col("doc_id").alias(lose)), 24)
    return docs.join(losers, F.col(id_col) == F.col(lose), "left_anti")
