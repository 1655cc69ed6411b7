"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts each token from ``window`` tokens on either side: their embeddings, end to end, go through one
tanh layer; the output is factored into the token's class and the token within it, so a
prediction costs two short softmaxes instead of one over the vocabulary. A document's score is the
sum of its tokens' conditional log-probabilities.

Vocabulary: words are counted over all documents. The most frequent have ids of their own, the more of them the larger the
corpus (:func:`fitting`); the others share hashed ids. A word that shares an id is predicted as that id by the network and, given the id, by its share of
the id's occurrences in the corpus: n(word) / n(id). So every word of the corpus has a probability of its own and they add up to 1, however many
there are. Counts of the ``known`` most frequent are sent to the tasks, those of rarer words are joined, by shuffle. Contexts see the shared id only.

Training: a document belongs by the hash of its id and text to one of ``rounds`` rounds and, within it, to a shard of about ``shard_tokens``
words. In each round every shard goes through its documents in order of hash with Adam, from the parameters that the round before left; then the
shards' parameters are averaged by words, in a tree of sums of one binary row each. All documents are trained on, once. Shards and their order depend
on the documents alone, so scores don't depend on how the table is partitioned or in what order it is read, and a shard sees as many words whatever the size of
the corpus; there are only more of them.

Defined results: a null text, or one without a word, has 0 tokens, score 0 and a null mean. Every row gives one row;
repeated rows train and score each by itself, null doc_ids too, and equal texts have equal scores. An empty table gives an empty table. Words are compared in lower case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernel
from granary.llm.common import map_batches
from granary.runtime import cut_lineage, frugal, ship


@dataclass(frozen=True)
class Shape:
    """Id 0 is the edge of a document; then own words; the last ``shared`` ids are shared."""

    classes: int = 32
    per_class: int = 32
    shared: int = 64
    embed: int = 8
    window: int = 2
    hidden: int = 32
    batch: int = 4096
    rate: float = 0.01
    seed: int = 5
    rounds: int = 4
    shard_tokens: int = 1 << 21
    known: int = 1 << 18

    @property
    def size(self) -> int:
        return self.classes * self.per_class

    @property
    def own(self) -> int:
        return self.size - self.shared - 1

    def layout(self) -> dict[str, tuple[int, ...]]:
        c, p, h = self.classes, self.per_class, self.hidden
        return {"E": (self.size, self.embed), "W": (2 * self.window * self.embed, h), "b": (h,), "C": (h, c), "cb": (c,), "K": (c, h, p), "kb": (c, p)}

    @property
    def parameters(self) -> int:
        return sum(int(np.prod(d)) for d in self.layout().values())


def fitting(tokens: int) -> Shape:
    """The shape for a corpus of so many words: ids grow with the power 2/5 of it, from 1,024 to 16,384 (the parameters must fit a task and a row), a sixteenth of them shared."""
    side = min(128, max(32, round(tokens**0.2)))
    return Shape(classes=side, per_class=side, shared=side * side // 16)


class Network:
    def __init__(self, shape: Shape, flat: np.ndarray) -> None:
        self.shape, self.flat = shape, np.ascontiguousarray(flat, np.float32)
        self.p = self.views(self.flat)
        self.m, self.v, self.steps = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, dims in self.shape.layout().items():
            n = int(np.prod(dims))
            out[name] = flat[at : at + n].reshape(dims)
            at += n
        return out

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings end to end, and what the tanh layer makes of them."""
        x = self.p["E"][context].reshape(len(context), -1)
        h = x @ self.p["W"]
        h += self.p["b"]
        return x, np.tanh(h, h)

    def logits(self, h: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of the classes and of the words within each target's class, less the greatest of each row, and the classes' cuts. Rows are sorted by class."""
        p, s = self.p, self.shape
        a = h @ p["C"]
        a += p["cb"]
        cuts = np.searchsorted(klass, np.arange(s.classes + 1))
        q = np.empty((len(klass), s.per_class), np.float32)
        for k in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[k], cuts[k + 1]
            np.matmul(h[lo:hi], p["K"][k], out=q[lo:hi])
            q[lo:hi] += p["kb"][k]
        a -= a.max(1, keepdims=True)
        q -= q.max(1, keepdims=True)
        return a, q, cuts

    def forward(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target. Rows must be sorted by target class."""
        klass, word = target // self.shape.per_class, target % self.shape.per_class
        a, q, _ = self.logits(self.hidden(context)[1], klass)
        row = np.arange(len(target))
        logp = a[row, klass] + q[row, word]
        return logp - np.log(np.exp(a, a).sum(1)) - np.log(np.exp(q, q).sum(1))

    def train(self, context: np.ndarray, target: np.ndarray) -> None:
        """One Adam step on the mean log-loss."""
        p, s, n = self.p, self.shape, np.float32(len(target))
        order = np.argsort(target // s.per_class, kind="stable")
        context, target = context[order], target[order]
        klass, word = target // s.per_class, target % s.per_class
        x, h = self.hidden(context)
        a, q, cuts = self.logits(h, klass)
        np.exp(a, a)
        np.exp(q, q)
        a *= 1 / (n * a.sum(1, keepdims=True))
        q *= 1 / (n * q.sum(1, keepdims=True))
        flat = np.zeros_like(self.flat)
        g = self.views(flat)
        row = np.arange(len(target))
        a[row, klass] -= 1 / n
        q[row, word] -= 1 / n
        g["C"][:] = h.T @ a
        g["cb"][:] = a.sum(0)
        dh = a @ p["C"].T
        for k in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[k], cuts[k + 1]
            np.matmul(h[lo:hi].T, q[lo:hi], out=g["K"][k])
            g["kb"][k] = q[lo:hi].sum(0)
            dh[lo:hi] += q[lo:hi] @ p["K"][k].T
        dh *= 1 - h * h
        g["W"][:] = x.T @ dh
        g["b"][:] = dh.sum(0)
        dx = (dh @ p["W"].T).reshape(-1, s.embed)
        ids = context.reshape(-1)
        for j in range(s.embed):
            g["E"][:, j] = np.bincount(ids, dx[:, j], s.size)
        self.steps += 1
        self.m += (flat - self.m) * np.float32(0.1)
        self.v += (flat * flat - self.v) * np.float32(0.001)
        scale = self.shape.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        self.flat -= np.float32(scale) * self.m / (np.sqrt(self.v) + np.float32(1e-8))


def token_ids(h: np.ndarray, words: np.ndarray, shape: Shape) -> np.ndarray:
    """Ids of word hashes; ``words``: the hashes that have ids of their own, by frequency."""
    order = np.argsort(words)
    by = words[order]
    shared = (shape.own + 1 + (h >> np.uint64(8)) % np.uint64(shape.shared)).astype(np.int32)
    if not len(by):
        return shared
    at = np.minimum(np.searchsorted(by, h), len(by) - 1)
    return np.where(by[at] == h, order[at].astype(np.int32) + 1, shared)


def windows(ids: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """The tokens around each token, 0 beyond its document."""
    n, out = len(ids), np.zeros((len(ids), 2 * window), np.int32)
    for j in range(1, window + 1):
        if n > j:
            same = rows[j:] == rows[:-j]
            out[j:, window - j] = np.where(same, ids[:-j], 0)
            out[:-j, window + j - 1] = np.where(same, ids[j:], 0)
    return out


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) by word hash over all documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(kernel.word_hashes(buf, offs)[0], return_counts=True) for _, buf, offs in kernel.slices(batch.column(0), 1 << 21)]
        h = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.uint64)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64))], ["word", "n"])

    return map_batches(docs.select(text_col), run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Counts:
    """known: hashes of the most frequent words, sorted; n: how often each occurs; least: a word that isn't known occurs less often; ids: occurrences of each shared id;
    words: those with ids of their own, by frequency."""

    known: np.ndarray
    n: np.ndarray
    least: int
    ids: np.ndarray
    words: np.ndarray
    total: int

    def within(self, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """Of the known words that share an id: sorted hashes, log-probability given the id."""
        rest = ~np.isin(self.known, self.words)
        h = self.known[rest]
        at = token_ids(h, self.words, shape) - shape.own - 1
        return h, np.log(self.n[rest] / self.ids[at])


#: Grid of counts: 8 steps a doubling.
_GRID = 8


def gather(counted: DataFrame, shape: Shape | None) -> tuple[Shape, Counts]:
    """What the tasks need of the word counts (word, n): at most ``shape.known`` words with their counts, and sums of bounded number."""
    rows = counted.groupBy(F.floor(F.log2("n") * _GRID).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    shape = shape or fitting(total)
    step, upto = math.inf, 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        upto += r["words"]
        if upto > max(shape.known, shape.own):
            break
        step = r["step"]
    least = 0 if not rows else 1 << 62 if step == math.inf else max(1, math.ceil(2 ** (step / _GRID) - 1e-9))
    top = counted.filter(F.col("n") >= least)
    found = top.toPandas() if least < 1 << 62 else counted.orderBy(F.desc("n"), "word").limit(shape.own).toPandas()
    h, n = found["word"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    words = h[np.lexsort((h.view(np.int64), -n))][: shape.own]
    sums = counted.groupBy((F.shiftrightunsigned("word", 8) % shape.shared).cast("int").alias("shared")).agg(F.sum("n").alias("n")).collect()
    ids = np.zeros(shape.shared)
    for r in sums:
        ids[r["shared"]] = r["n"]
    order = np.argsort(h)
    h, n = h[order], n[order]
    own = np.isin(h, words)
    ids -= np.bincount(((h[own] >> np.uint64(8)) % np.uint64(shape.shared)).astype(np.int64), n[own], shape.shared)
    return shape, Counts(h, n, least, ids, words, total)


def start(shape: Shape, counts: Counts) -> np.ndarray:
    """Small random weights, output biases of the corpus frequencies."""
    rng = np.random.default_rng(shape.seed)
    flat = rng.normal(0, 0.1, shape.parameters).astype(np.float32)
    net = Network(shape, flat)
    freq = np.full(shape.size, 1.0)
    freq[1 : len(counts.words) + 1] += counts.n[np.searchsorted(counts.known, counts.words)]
    freq[shape.own + 1 :] += counts.ids
    by = freq.reshape(shape.classes, shape.per_class)
    net.p["cb"][:] = np.log(by.sum(1) / by.sum())
    net.p["kb"][:] = np.log(by / by.sum(1, keepdims=True))
    net.p["b"][:] = 0
    return net.flat


class Trainer:
    """Steps of ``batch`` windows each, whatever the pieces in which texts come."""

    def __init__(self, shape: Shape, words: np.ndarray, flat: np.ndarray) -> None:
        self.net, self.words, self.seen = Network(shape, flat.copy()), words, 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, texts: pa.Array) -> None:
        shape = self.net.shape
        for _, buf, offs in kernel.slices(texts):
            h, rows = kernel.word_hashes(buf, offs)
            ids = token_ids(h, self.words, shape)
            self.waiting.append((windows(ids, rows, shape.window), ids))
            self.held += len(ids)
            if self.held >= shape.batch:
                self.steps(shape.batch)

    def steps(self, size: int) -> None:
        around, ids = (np.concatenate([w[i] for w in self.waiting]) for i in (0, 1))
        end = len(ids) // size * size if size == self.net.shape.batch else len(ids)
        for lo in range(0, end, size):
            self.net.train(around[lo : lo + size], ids[lo : lo + size])
        self.seen += end
        self.waiting, self.held = [(around[end:], ids[end:])], len(ids) - end

    def finished(self) -> tuple[int, np.ndarray]:
        """Words seen and the parameters times their number."""
        if self.held:
            self.steps(self.held)
        return self.seen, self.net.flat.astype(np.float64) * self.seen


def _row(shard: int, seen: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["shard", "seen", "flat"])


ROW = "shard bigint, seen bigint, flat binary"
FAN = 16


def summed(rows: DataFrame, n: int) -> DataFrame:
    """One row from at most ``n`` rows (shard, seen, flat), ``FAN`` by ``FAN`` in order of shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, flat, group = 0, None, None
        for batch in batches:
            for g, s, f in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
                x = np.frombuffer(f)
                if g // FAN != group and group is not None:
                    yield _row(group, seen, flat)
                    seen, flat = 0, None
                group, seen, flat = g // FAN, seen + s, x.copy() if flat is None else flat + x
        if group is not None:
            yield _row(group, seen, flat)

    while True:
        n = -(-n // FAN)
        rows = rows.repartitionById(n, F.expr(f"cast(shard div {FAN} as int)")).sortWithinPartitions("shard").mapInArrow(frugal(run), ROW)
        if n <= 1:
            return rows


def train_round(docs: DataFrame, id_col: str, text_col: str, shape: Shape, words: np.ndarray, flat: np.ndarray, turn: int, shards: int) -> np.ndarray:
    """Parameters after the shards of one round have gone through their documents, averaged by words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trainer = None, None
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if of[lo] != shard:
                    if trainer is not None and trainer.seen + trainer.held:
                        yield _row(int(shard), *trainer.finished())
                    shard, trainer = of[lo], Trainer(shape, words, flat)
                trainer.add(batch.column(1).slice(lo, hi - lo))
        if trainer is not None and trainer.seen + trainer.held:
            yield _row(int(shard), *trainer.finished())

    h = F.xxhash64(F.col(id_col), F.col(text_col))
    mine = docs.select(F.col(text_col).alias("text"), h.alias("h")).filter(f"text is not null and pmod(h, {shape.rounds}) = {turn}")
    placed = mine.select(F.expr(f"pmod(shiftrightunsigned(h, 8), {shards})").cast("int").alias("shard"), "text", "h")
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h").select("shard", "text")
    got = summed(ordered.mapInArrow(frugal(run), ROW), shards).collect()
    if not got:
        return flat
    return (np.frombuffer(got[0]["flat"]) / got[0]["seen"]).astype(np.float32)


def fit(docs: DataFrame, text_col: str = "text", shape: Shape | None = None, counted: DataFrame | None = None, id_col: str = "doc_id") -> tuple[Shape, Counts, np.ndarray]:
    """(shape, counts, parameters), trained on all documents. ``counted``: their word counts, if known."""
    shape, counts = gather(word_counts(docs, text_col) if counted is None else counted, shape)
    flat = start(shape, counts)
    shards = max(1, round(counts.total / (shape.rounds * shape.shard_tokens)))
    for turn in range(shape.rounds if counts.total else 0):
        flat = train_round(docs, id_col, text_col, shape, counts.words, flat, turn, shards)
    return shape, counts, flat


class Scorer:
    """Scores by slice; words that are known are done with at once, the others are given back."""

    def __init__(self, shape: Shape, counts: Counts, flat: np.ndarray) -> None:
        self.net, self.words = Network(shape, flat), counts.words
        self.known, self.within = counts.within(shape)

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By slice: its first row; by row the summed log-probability but for unknown words given their ids, and tokens; row, hash and times of each row's unknown words."""
        shape = self.net.shape
        for at, buf, offs in kernel.slices(texts):
            h, rows = kernel.word_hashes(buf, offs)
            ids = token_ids(h, self.words, shape)
            around = windows(ids, rows, shape.window)
            logp = np.empty(len(ids))
            for lo in range(0, len(ids), shape.batch):
                t = ids[lo : lo + shape.batch]
                order = np.argsort(t // shape.per_class, kind="stable")
                logp[lo + order] = self.net.forward(around[lo : lo + shape.batch][order], t[order])
            rare = np.flatnonzero(ids > shape.own)
            if len(self.known):
                place = np.minimum(np.searchsorted(self.known, h[rare]), len(self.known) - 1)
                hit = self.known[place] == h[rare]
                logp[rare[hit]] += self.within[place[hit]]
                rare = rare[~hit]
            g, r = h[rare], rows[rare]
            order = np.lexsort((g, r))
            g, r = g[order], r[order]
            new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])) if len(g) else np.zeros(0, np.int64)
            yield at, np.bincount(rows, logp, len(offs) - 1), np.bincount(rows, minlength=len(offs) - 1), r[new], g[new], np.diff(np.append(new, len(g)))


def score_texts(texts: pa.Array, shape: Shape, counts: Counts, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: summed log-probability, of words that aren't known only that of their ids, and tokens."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for at, logp, n, *_ in Scorer(shape, counts, flat).slices(texts):
        total[at : at + len(n)], count[at : at + len(n)] = logp, n
    return total, count


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None) -> DataFrame:
    """(doc_id, log_likelihood, n_tokens, mean_log_likelihood), by a network fitted on the same documents."""
    counted = cut_lineage(word_counts(docs, text_col))
    shape, counts, flat = fit(docs, text_col, shape, counted, id_col)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each word of a document whose count has to be joined; the first, or one without such a word, has what else there is of the document."""
        scorer = Scorer(shape, counts, flat)
        for batch in batches:
            for at, logp, n, r, h, times in scorer.slices(batch.column(1)):
                none = np.setdiff1d(np.arange(len(n)), r)
                rows, blank = np.concatenate([r, none]), np.zeros(len(none), np.int64)
                first = np.concatenate([[True], rows[1:] != rows[:-1]])
                rare = np.arange(len(rows)) < len(r)
                doc = batch.column(0).take(pa.array(at + rows, mask=~first))
                word = pa.array(np.concatenate([h.view(np.int64), blank]), mask=~rare)
                shared = pa.array(np.concatenate([(h >> np.uint64(8)) % np.uint64(shape.shared), blank]).astype(np.int32), mask=~rare)
                yield pa.record_batch(
                    [doc, batch.column(2).take(pa.array(at + rows)), word, shared, pa.array(np.concatenate([times, blank])), pa.array(np.where(first, logp[rows], 0.0)), pa.array(np.where(first, n[rows], 0))],
                    ["doc_id", "row", "word", "shared", "times", "logp", "n_tokens"],
                )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    columns = f"doc_id {kind}, row bigint, word bigint, shared int, times bigint, logp double, n_tokens bigint"
    found = docs.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("row")).mapInArrow(frugal(run), columns)
    rare = counted.filter(F.col("n") < counts.least)
    ids = F.element_at(F.array(*[F.lit(float(max(x, 1.0))) for x in counts.ids]), F.col("shared") + 1)
    value = F.col("logp") + F.coalesce(F.col("times") * F.log(F.col("n") / ids), F.lit(0.0))
    each = found.join(rare, "word", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum(value).alias("log_likelihood"), F.sum("n_tokens").alias("n_tokens"))
    return each.select("doc_id", "log_likelihood", "n_tokens", F.expr("log_likelihood / nullif(n_tokens, 0)").alias("mean_log_likelihood"))
