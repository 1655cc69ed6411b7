"""Quality rules whose limits come from quantile sketches of each language and source.

Four integer measures a document: symbols and ASCII capitals in thousandths, words of
repeated 4-grams in thousandths, and mean word length in hundredths. A sketch counts documents
by measure on a log-linear grid: values below 128 exactly, larger ones to 7 leading bits, so a
quantile is off by less than 1/64. Sketches of the same grid merge by adding counts: that is one
grouped sum, and its size depends on groups and grid, not on documents.

A group's sketch is merged with ``prior`` documents' weight of its language's, which steadies
small groups. The upper limit of a measure is q50 + reach * max(q75 - q50, floor), the lower
one, for word length alone, q50 - reach * max(q50 - q25, floor). Short documents get
``slack`` / words on top, since their measures are noisy, repeats most. The limits are joined back and
documents beyond one of them go.

Defined results: null language and source are groups like any other. A null text, or one without
a word, has nothing to judge: it enters no sketch and stays. Repeated rows count and stay each
by itself. An empty table gives an empty table. Words are runs of bytes other than ASCII
white space, compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from granary.llm import kernel
from granary.llm.common import extended, fresh, map_batches, sized
from granary.runtime import cut_lineage

MEASURES = ("symbols", "capitals", "repeats", "length")


@dataclass(frozen=True)
class Rules:
    prior: int = 50
    reach: int = 6
    floors: tuple[int, ...] = (10, 10, 15, 40)
    slack: tuple[int, ...] = (3000, 3000, 9000, 3000)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_WORD = ~_SPACE
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[*b"#$%&*|<>{}[]=~^\\_+!"]] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_CHAR = ((np.arange(256) & 0xC0) != 0x80) & ~_SPACE


def measures(texts: pa.Array) -> np.ndarray:
    """int64 by row: words, then the four measures."""
    out = np.zeros((len(texts), 5), np.int64)
    for at, buf, offs in kernel.slices(texts):
        n = len(offs) - 1
        starts, ends, rows = kernel.spans(buf, offs, _WORD)
        if not len(starts):
            continue
        words = np.bincount(rows, minlength=n)

        def total(member: np.ndarray) -> np.ndarray:
            s = np.concatenate([[0], np.cumsum(member[buf], dtype=np.int64)])
            return s[offs[1:]] - s[offs[:-1]]

        chars, letters = total(_CHAR.astype(np.uint8)), total(_LETTER)
        h = kernel.span_hashes(buf, starts, ends)
        grams = np.zeros(n, np.int64)
        if len(h) > 3:
            g = h[:-3]
            for j in (1, 2, 3):
                g = kernel.mix(g) + h[j : len(h) - 3 + j]
            whole = rows[:-3] == rows[3:]
            g, r = g[whole], rows[:-3][whole]
            _, first = np.unique(kernel.mix(g) ^ kernel.mix(r.astype(np.uint64)), return_index=True)
            grams = np.bincount(r, minlength=n) - np.bincount(r[first], minlength=n)
        out[at : at + n] = np.stack([
            words,
            1000 * total(_SYMBOL) // np.maximum(chars, 1),
            1000 * total(_UPPER) // np.maximum(letters, 1),
            1000 * grams // np.maximum(words - 3, 1),
            100 * chars // np.maximum(words, 1),
        ], 1)
    return out


def measured(docs: DataFrame, text_col: str, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with five measure columns under ``names``."""
    at = docs.columns.index(text_col)
    keep = docs.columns if keep is None else keep
    columns = [docs.columns.index(c) for c in keep]
    schema = extended(docs.select(*keep), dict.fromkeys(names, T.LongType()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measures(batch.column(at))
        return pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(m[:, i].copy()) for i in range(5)], names=[f.name for f in schema])

    return map_batches(docs, run, schema)


def grid(value: Column) -> Column:
    """The grid point at or below a measure: its 7 leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def limits(rows: DataFrame, rules: Rules) -> DataFrame:
    """(lang, source, high_0..high_3, low) from rows of (lang, source, words, m0..m3)."""
    tall = rows.filter("words > 0").select("lang", "source", F.posexplode(F.array(*[grid(F.col(f"m{i}")) for i in range(4)])).alias("m", "at"))
    # Written once: it is read four times below, and each reading would go through all texts.
    sketch = cut_lineage(tall.groupBy("lang", "source", "m", "at").agg(F.count(F.lit(1)).alias("n")))
    by_lang = sketch.groupBy("lang", "m", "at").agg(F.sum("n").alias("n"))
    size = by_lang.filter("m = 0").groupBy("lang").agg(F.sum("n").alias("size"))
    groups = sketch.filter("m = 0").select("lang", "source").distinct()

    def same(a: DataFrame, b: DataFrame) -> DataFrame:
        renamed = b.withColumnRenamed("lang", "lang2")
        return a.join(renamed, a["lang"].eqNullSafe(renamed["lang2"])).drop("lang2")

    own = same(sketch, size).select("lang", "source", "m", "at", (F.col("n").cast("double") * F.col("size")).alias("w"))
    shared = same(groups, by_lang).select("lang", "source", "m", "at", (F.col("n").cast("double") * rules.prior).alias("w"))
    merged = own.unionAll(shared).groupBy("lang", "source", "m", "at").agg(F.sum("w").alias("w"))
    over = W.partitionBy("lang", "source", "m")
    run = merged.withColumn("upto", F.sum("w").over(over.orderBy("at"))).withColumn("all", F.sum("w").over(over))
    q = run.groupBy("lang", "source", "m").agg(*[F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("at"))).alias(f"q{i}") for i, p in enumerate((0.25, 0.5, 0.75))])
    floor = F.element_at(F.array(*map(F.lit, rules.floors)), F.col("m") + 1)
    high = q.withColumn("high", F.col("q1") + rules.reach * F.greatest(F.col("q2") - F.col("q1"), floor)).withColumn("low", F.col("q1") - rules.reach * F.greatest(F.col("q1") - F.col("q0"), floor))
    return high.groupBy("lang", "source").agg(*[F.max(F.when(F.col("m") == i, F.col("high"))).alias(f"high_{i}") for i in range(4)], F.max(F.when(F.col("m") == 3, F.col("low"))).alias("low"))


def accept(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` within the limits of their language and source, columns as they were."""
    rules = rules or Rules()
    plain = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    bounds, _ = sized(limits(measured(plain, "text", ["words", "m0", "m1", "m2", "m3"], ["lang", "source"]), rules), 256)
    names = fresh(docs, "words", "m0", "m1", "m2", "m3", "blang", "bsource", "h0", "h1", "h2", "h3", "low")
    words, ms, blang, bsource, hs, low = names[0], names[1:5], names[5], names[6], names[7:11], names[11]
    bounds = bounds.toDF(blang, bsource, *hs, low)
    rows = measured(docs, text_col, names[:5])
    joined = rows.join(bounds, F.col(lang_col).eqNullSafe(F.col(blang)) & F.col(source_col).eqNullSafe(F.col(bsource)), "left")
    slack = [F.expr(f"{s} div greatest({words}, 1)") for s in rules.slack]
    bad = F.col(ms[3]) < F.col(low) - slack[3]
    for m, h, s in zip(ms, hs, slack, strict=True):
        bad = bad | (F.col(m) > F.col(h) + s)
    return joined.filter((F.col(words) == 0) | ~F.coalesce(bad, F.lit(False))).select(*docs.columns)


_CHARS = r"regexp_replace(t, '[ \t\n\r\f]', '', 'g')"
KEPT_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \t\n\r\f]+') AS ws, length({_CHARS}) AS chars,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
    length(regexp_replace(t, '[^#$%&*|<>{{}}\[\]=~^\\_+!]', '', 'g')) AS sym FROM d),
m AS (SELECT doc_id, lang, source, len(ws) AS words, 1000 * sym // greatest(chars, 1) AS m0, 1000 * up // greatest(letters, 1) AS m1,
    1000 * (greatest(len(ws) - 3, 0) - len(list_distinct(list_transform(range(1, greatest(len(ws) - 2, 1)), lambda i: ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2] || chr(31) || ws[i + 3])))) // greatest(len(ws) - 3, 1) AS m2,
    100 * chars // greatest(len(ws), 1) AS m3 FROM w),
tall AS (SELECT lang, source, unnest([0, 1, 2, 3]) AS m, unnest([m0, m1, m2, m3]) AS v FROM m WHERE words > 0),
g AS (SELECT lang, source, m, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS pt FROM tall),
sketch AS (SELECT lang, source, m, pt, count(*) AS n FROM g GROUP BY ALL),
by_lang AS (SELECT lang, m, pt, sum(n) AS n FROM sketch GROUP BY ALL),
size AS (SELECT lang, sum(n) AS size FROM by_lang WHERE m = 0 GROUP BY lang),
merged AS (SELECT lang, source, m, pt, sum(w) AS w FROM (
    SELECT k.lang, k.source, m, pt, n::DOUBLE * size AS w FROM sketch k JOIN size z ON k.lang IS NOT DISTINCT FROM z.lang
    UNION ALL SELECT k.lang, k.source, b.m, b.pt, b.n::DOUBLE * 50 FROM (SELECT DISTINCT lang, source FROM sketch) k JOIN by_lang b ON k.lang IS NOT DISTINCT FROM b.lang) GROUP BY ALL),
run AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, m ORDER BY pt) AS upto, sum(w) OVER (PARTITION BY lang, source, m) AS total FROM merged),
q AS (SELECT lang, source, m, min(pt) FILTER (upto >= total * 0.25::DOUBLE) AS q0, min(pt) FILTER (upto >= total * 0.5::DOUBLE) AS q1, min(pt) FILTER (upto >= total * 0.75::DOUBLE) AS q2 FROM run GROUP BY ALL),
b AS (SELECT lang, source, m, q1 + 6 * greatest(q2 - q1, [10, 10, 15, 40][m + 1]) AS high, q1 - 6 * greatest(q1 - q0, [10, 10, 15, 40][m + 1]) AS low FROM q),
bounds AS (SELECT lang, source, max(high) FILTER (m = 0) AS h0, max(high) FILTER (m = 1) AS h1, max(high) FILTER (m = 2) AS h2, max(high) FILTER (m = 3) AS h3, max(low) FILTER (m = 3) AS low FROM b GROUP BY ALL)
SELECT m.doc_id, m.lang, m.source FROM m LEFT JOIN bounds b ON m.lang IS NOT DISTINCT FROM b.lang AND m.source IS NOT DISTINCT FROM b.source
WHERE words = 0 OR NOT coalesce(m0 > h0 + 3000 // greatest(words, 1) OR m1 > h1 + 3000 // greatest(words, 1) OR m2 > h2 + 9000 // greatest(words, 1)
    OR m3 > h3 + 3000 // greatest(words, 1) OR m3 < low - 3000 // greatest(words, 1), false)
"""
