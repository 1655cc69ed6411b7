"""Vector, score and metric functions: Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import ColumnOrName, col


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Dot product in double precision."""
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: ColumnOrName) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: ColumnOrName, epsilon: float = 1e-10) -> Column:
    """The vector by its length plus ``epsilon``."""
    return F.transform(col(v), lambda x: x.cast("double") / (norm(v) + F.lit(epsilon)))


def cosine(a: ColumnOrName, b: ColumnOrName, epsilon: float = 1e-10) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def distance_score(distance: ColumnOrName) -> Column:
    """Score of a cosine distance: 1 - d / 2."""
    return 1 - col(distance) / 2


def lexical_clamp(score: ColumnOrName, top: float = 5.0) -> Column:
    return F.least(col(score) / F.lit(top), F.lit(1.0))


def weighted(a: ColumnOrName, b: ColumnOrName, wa: ColumnOrName | float, wb: ColumnOrName | float) -> Column:
    return col(a) * (F.lit(wa) if isinstance(wa, float) else col(wa)) + col(b) * (F.lit(wb) if isinstance(wb, float) else col(wb))


def reciprocal_rank(rank: ColumnOrName, weight: float = 1.0, k: int = 60, absent: int = 1000) -> Column:
    """A list's part in reciprocal rank fusion; an absent id has rank ``absent``."""
    return F.lit(weight) / (k + F.coalesce(col(rank), F.lit(absent)))


def idf(df: ColumnOrName, n: ColumnOrName) -> Column:
    return F.log((col(n) - col(df) + 0.5) / (col(df) + 0.5) + 1)


def tf_part(tf: ColumnOrName, length: ColumnOrName, average: ColumnOrName, k1: float = 1.5, b: float = 0.75) -> Column:
    return col(tf) * (k1 + 1) / (col(tf) + k1 * (1 - b + b * col(length) / col(average)))


def cut(ids: ColumnOrName, k: int | None) -> Column:
    """The first ``k`` of a list; all for None or 0."""
    return F.slice(col(ids), 1, k) if k else col(ids)


def recall(retrieved: ColumnOrName, relevant: ColumnOrName, k: int | None = None) -> Column:
    """Share of the relevant that was retrieved; 1 if nothing is relevant."""
    want = F.array_distinct(col(relevant))
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, cut(retrieved, k))) / F.size(want))


def precision(retrieved: ColumnOrName, relevant: ColumnOrName, k: int | None = None) -> Column:
    """Share of the retrieved, as a set, that is relevant; 0 if nothing was retrieved."""
    got = F.array_distinct(cut(retrieved, k))
    return F.when(F.size(got) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(got, col(relevant))) / F.size(got))


def reciprocal_hit(retrieved: ColumnOrName, relevant: ColumnOrName) -> Column:
    """1 / position of the first relevant id, 0 without one."""
    hits = F.filter(F.transform(col(retrieved), lambda x, i: F.when(F.array_contains(col(relevant), x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1.0 / F.try_element_at(hits, F.lit(1)), F.lit(0.0))


def ndcg(retrieved: ColumnOrName, relevant: ColumnOrName, k: int | None = None) -> Column:
    """Binary gain; the ideal list is as long as the shorter of both."""
    got = cut(retrieved, k)
    gain = total(F.transform(got, lambda x, i: F.when(F.array_contains(col(relevant), x), 1 / F.log2(i + F.lit(2.0))).otherwise(F.lit(0.0))))
    size = F.least(F.size(F.array_distinct(col(relevant))), F.size(got))
    ideal = total(F.transform(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), lambda i: 1 / F.log2(i + F.lit(2.0))))
    return F.when(ideal > 0, gain / ideal).otherwise(F.lit(0.0))


def eval_score(recall_: ColumnOrName, precision_: ColumnOrName) -> Column:
    return weighted(recall_, precision_, 0.6, 0.4)


def budget(total_tokens: ColumnOrName, system: ColumnOrName, query: ColumnOrName, response: ColumnOrName) -> Column:
    """struct(remaining, available_for_context): 0.6 of what the system prompt, query and response leave."""
    left = F.greatest(col(total_tokens) - col(system) - col(query) - col(response), F.lit(0))
    return F.struct(left.alias("remaining"), F.floor(left * F.lit(0.6)).cast("int").alias("available_for_context"))


def chunk_count(first_tokens: ColumnOrName, available: ColumnOrName, max_tokens: int, least: int = 3, most: int = 10) -> Column:
    """How many chunks to take, from the mean size of the first five and 50 tokens for a header; ``least`` may exceed what is there."""
    head = F.slice(col(first_tokens), 1, 5)
    each = total(F.transform(head, lambda x: x.cast("double"))) / F.size(head) + 50
    optimal = F.floor(F.lit(max_tokens) / each).cast("int")
    return F.when(F.size(col(first_tokens)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(least), F.least(optimal, F.lit(most), col(available))))


PRICES = {"gpt-4": (0.03, 0.06), "gpt-4-turbo": (0.01, 0.03), "gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006), "gpt-3.5-turbo": (0.0015, 0.002)}
OTHER_PRICE = (0.01, 0.03)


def request_cost(prompt: ColumnOrName, completion: ColumnOrName, model: ColumnOrName) -> Column:
    """struct(input, output, total) in dollars; a model is priced by its name, else by the longest known prefix."""
    name = F.lower(col(model))
    rates = [None, None]
    for key in sorted(PRICES, key=len, reverse=True):
        for i in (0, 1):
            rates[i] = F.when(name.startswith(key), PRICES[key][i]) if rates[i] is None else rates[i].when(name.startswith(key), PRICES[key][i])
    cin, cout = (col(t) / 1000 * r.otherwise(o) for t, r, o in zip((prompt, completion), rates, OTHER_PRICE, strict=True))
    return F.struct(cin.alias("input"), cout.alias("output"), (cin + cout).alias("total"))


FLAT = {"gpt4": 0.03 / 1000, "gpt4_mini": 0.001 / 1000}


def query_cost(used: ColumnOrName, model: ColumnOrName, cache_hit: ColumnOrName) -> Column:
    """Flat price of a query's tokens; nothing for a cache hit or an unknown model."""
    rate = F.when(col(model) == "gpt4", FLAT["gpt4"]).when(col(model) == "gpt4_mini", FLAT["gpt4_mini"]).otherwise(0.0)
    return F.when(col(cache_hit), F.lit(0.0)).otherwise(col(used) * rate)


def drift_severity(score: ColumnOrName, threshold: float = 0.90) -> Column:
    """Severity of a drift below the threshold, else null."""
    return F.when(col(score) >= threshold, F.lit(None)).when(col(score) < 0.7, "high").when(col(score) < 0.85, "medium").otherwise("low")


def confidence(status: ColumnOrName) -> Column:
    return F.when(col(status) == "valid", "high").when(col(status) == "invalid", "low").otherwise("medium")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def number_supported(number: Column, candidates: ColumnOrName, tolerance: float) -> Column:
    """Whether a number, read without its percent sign, is within a relative tolerance of a candidate."""
    x = F.expr("1").cast("double") * F.translate(number, "%", "").try_cast("double")

    def near(c: Column) -> Column:
        y = F.translate(c, "%", "").try_cast("double")
        return F.when(y == 0, x == 0).otherwise(F.abs(x - y) / F.abs(y) <= tolerance)

    return F.exists(col(candidates), lambda c: F.coalesce(near(c), F.lit(False)))
