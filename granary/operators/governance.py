"""Access grants, personal data, audit lines, costs, caches and circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.functions import numeric as n
from granary.runtime import ship


def grant(grants: DataFrame, more: DataFrame) -> DataFrame:
    """Grants as a set."""
    return grants.unionByName(more).dropDuplicates()


def allowed(docs: DataFrame, grants: DataFrame, principal: str, value: str, id_col: str = "doc_id") -> DataFrame:
    """Documents granted to a tenant or user; none for an unknown one."""
    mine = grants.filter(F.col(principal) == value).select(id_col)
    return docs.join(mine, id_col, "left_semi")


def allowed_all(docs: DataFrame, grants: DataFrame, keys: list[str]) -> DataFrame:
    return docs.join(grants, keys, "left_semi")


def denied(requests: DataFrame, grants: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without a grant."""
    return requests.join(grants, keys, "left_anti")


def access_predicate(docs: DataFrame, grants: DataFrame, tenant: str | None = None, user: str | None = None) -> DataFrame:
    """Both grants applied: the tenant's column as a pushed filter, the user's by a semi join."""
    out = docs if tenant is None else docs.filter(F.col("tenant_id") == tenant)
    return out if user is None else allowed(out, grants, "user_id", user)


PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b" + r"[\s-]?".join([r"\d{4}"] * 4) + r"\b",
    "ip_address": r"\b" + r"\.".join([r"\d{1,3}"] * 4) + r"\b",
}


def pii(text: str | Column, custom: dict[str, str] | None = None) -> Column:
    """map(type, matches) in the text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.create_map(*[x for k, p in {**PII, **(custom or {})}.items() for x in (F.lit(k), F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?i)({p})"), F.lit(1)))])


def redact(text: str | Column, mark: str = "[REDACTED]", custom: dict[str, str] | None = None) -> Column:
    """The text with every match of the original text, type by type, replaced wherever it still stands. All in the JVM: a fold over the matches found."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?i)({p})"), F.lit(1)) for p in {**PII, **(custom or {})}.values()]))
    return F.aggregate(found, c, lambda acc, m: F.replace(acc, m, F.lit(mark)))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", custom: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, type, value, start, end). Places need Python; rows without a match are dropped before it."""
    import re

    ship(docs.sparkSession)
    patterns = {k: re.compile(p, re.I) for k, p in {**PII, **(custom or {})}.items()}
    any_ = "(?i)" + "|".join(f"(?:{p})" for p in {**PII, **(custom or {})}.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, m.group(), *m.span()) for d, t in zip(b["doc_id"], b["text"], strict=True) for k, p in patterns.items() for m in p.finditer(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "type", "value", "start", "end"])

    return docs.filter(F.col(text_col).rlike(any_)).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id string, type string, value string, start int, end int")


def audit_lines(rows: DataFrame, event: str, fields: list[str], at: str = "ts") -> DataFrame:
    """(value): one JSON line for each row, for an append-only text table."""
    stamp = F.date_format(F.col(at).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(F.to_json(F.struct(F.lit(event).alias("event"), stamp.alias("timestamp"), *fields)).alias("value"))


#: Fields of each kind of audit event, after its name and time.
AUDITED = {
    "query": ("user_id", "tenant_id", "query", "retrieved_doc_ids", "retrieved_count"),
    "ingestion": ("user_id", "tenant_id", "doc_id"),
    "access_violation": ("user_id", "tenant_id", "attempted_doc_id"),
}


def audit(rows: DataFrame, event: str, at: str = "ts") -> DataFrame:
    """(value): the lines of one kind of event from rows with its fields; retrieved_count is made from retrieved_doc_ids."""
    if event not in AUDITED:
        raise ValueError(f"unknown audit event: {event}")
    if event == "query":
        rows = rows.withColumn("retrieved_count", F.size("retrieved_doc_ids"))
    return audit_lines(rows, event, list(AUDITED[event]), at)


def cost_summary(queries: DataFrame) -> DataFrame:
    """One row over (tokens_used, model, cache_hit): hits are counted as queries and cost nothing; monthly is 100,000 queries."""
    rows = queries.withColumn("cost", n.query_cost("tokens_used", "model", "cache_hit"))
    s = rows.agg(F.count(F.lit(1)).alias("total_queries"), F.sum("cost").alias("total_cost"), F.sum(F.when(~F.col("cache_hit"), F.col("tokens_used")).otherwise(0)).alias("total_tokens"), F.count_if("cache_hit").alias("hits"))
    each = F.when(F.col("total_queries") > 0, F.col("total_cost") / F.col("total_queries")).otherwise(0.0)
    return s.select("total_queries", "total_cost", "total_tokens", F.when(F.col("total_queries") > 0, F.col("hits") / F.col("total_queries")).otherwise(0.0).alias("cache_hit_rate"), each.alias("avg_cost_per_query"), (each * 100_000).alias("estimated_monthly_cost"))


def cache_lookup(requests: DataFrame, cache: DataFrame, ttl: float = 3600.0) -> DataFrame:
    """Requests (key, ts, ...) with hit and value: the latest entry (key, ts, value) at or before each is a hit if it is no older than the time to live; 0 means 3600.

    An as-of join by one sort: entries and requests of a key go in order of time, entries first, and each request sees the last entry."""
    names = requests.columns
    entry = F.struct(F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("value").alias("value"))
    kind = cache.select(entry.alias("e")).schema[0].dataType
    asked = requests.select(F.col("key").alias("__key"), F.col("ts").cast("timestamp").alias("__ts"), F.lit(1).alias("__asks"), F.lit(None).cast(kind).alias("__e"), F.struct(*names).alias("__r"))
    held = cache.select(F.col("key"), F.col("ts").cast("timestamp"), F.lit(0), entry, F.lit(None).cast(asked.schema["__r"].dataType))
    last = F.last("__e", True).over(W.partitionBy("__key").orderBy("__ts", "__asks").rowsBetween(W.unboundedPreceding, 0))
    seen = asked.unionAll(held).withColumn("__last", last).filter("__asks = 1")
    hit = F.coalesce(F.col("__ts").cast("double") - F.col("__last.at") <= (ttl or 3600.0), F.lit(False))
    return seen.select("__r.*", hit.alias("hit"), F.when(hit, F.col("__last.value")).alias("value"))


def cache_stats(cache: DataFrame, now: Column, ttl: float = 3600.0) -> DataFrame:
    age = now.cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    return cache.agg(F.count(F.lit(1)).alias("total"), F.count_if(age <= ttl).alias("valid"), F.count_if(age > ttl).alias("expired"))


BREAKERS = {"llm": (3, 30.0, 2), "reranker": (5, 60.0, 3)}


class Breaker:
    """Closed until ``failures`` in a row; then open for ``reset`` seconds; then half open until ``trials`` successes."""

    def __init__(self, failures: int, reset: float, trials: int) -> None:
        self.limits, self.state, self.count, self.last, self.good = (failures, reset, trials), "closed", 0, 0.0, 0

    def lets(self, at: float) -> bool:
        """Whether a call may go; an open breaker becomes half open when its time is over."""
        if self.state == "open":
            if at - self.last < self.limits[1]:
                return False
            self.state, self.good = "half_open", 0
        return True

    def call(self, at: float, ok: bool) -> bool:
        """Whether the call is let through; its outcome counts only then."""
        failures, _, trials = self.limits
        if not self.lets(at):
            return False
        if ok:
            self.count = 0
            if self.state == "half_open":
                self.good += 1
                if self.good >= trials:
                    self.state = "closed"
        else:
            self.count, self.last = self.count + 1, at
            if self.state == "half_open" or self.count >= failures:
                self.state = "open"
        return True


def replay_breakers(events: DataFrame, limits: dict[str, tuple[int, float, int]] | None = None) -> DataFrame:
    """(service, ts, ok, allowed, state) of calls (service, ts, ok) in order of time; services without limits have the llm's."""
    ship(events.sparkSession)
    known = limits or BREAKERS
    schema = "service string, ts timestamp, ok boolean, allowed boolean, state string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Calls come sorted by service and time, so a task holds one breaker and one batch, however long a service's history is."""
        name, b = None, None
        for rows in batches:
            out = []
            for service, ts, ok in zip(rows["service"], rows["ts"], rows["ok"], strict=True):
                if b is None or service != name:
                    name, b = service, Breaker(*known.get(service, BREAKERS["llm"]))
                out.append((b.call(ts.timestamp(), bool(ok)), b.state))
            yield rows.assign(allowed=[a for a, _ in out], state=[s for _, s in out])

    ordered = events.select("service", F.col("ts").cast("timestamp"), "ok").repartition("service").sortWithinPartitions("service", "ts", "ok")
    return ordered.mapInPandas(run, schema)
