"""Queries over events and conversations: latency, cost, cache, breakers, audit, and the same as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import numeric as n
from granary.functions import text as t
from granary.operators import evaluate, governance, service
from granary.plans import sql
from granary.plans.registry import query
from granary.runtime import table
from granary.streaming import events as streams


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# --- latency

@query(f"SELECT event_type, {', '.join(f'quantile_cont(value, {p}) AS p{round(100 * p)}' for p in (0.25, 0.5, 0.75, 0.95, 0.99))} FROM events GROUP BY event_type")
def latency_percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency_linear(events(spark, sf_dir), "event_type", "value")


@query(f"""WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, avg(value) AS mean, min(value) AS min, max(value) AS max, {', '.join(f'max(value) FILTER (i = floor(n * {p}::DOUBLE)) AS p{round(100 * p)}' for p in (0.5, 0.95, 0.99))} FROM p GROUP BY event_type""")
def latency_percentiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency_nearest(events(spark, sf_dir), "event_type", "value")


@query("""WITH c AS (SELECT event_id, event_type, ts, round(value * 100)::BIGINT AS cents FROM events)
SELECT event_id, avg(cents) OVER w AS rolling_mean, min(cents) OVER w AS rolling_min, max(cents) OVER w AS rolling_max FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""")
def rolling_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In whole hundredths, whose sums are exact."""
    e = events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return evaluate.rolling(e, "event_type", ("ts", "event_id"), "cents").select("event_id", "rolling_mean", "rolling_min", "rolling_max")


@query("""SELECT event_type, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type""")
def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.counters(events(spark, sf_dir))


@query("""WITH p AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT count(*) AS requests, avg(value) AS mean, min(value) AS min, max(value) AS max, max(value) FILTER (i = floor(n * 0.5::DOUBLE)) AS p50, max(value) FILTER (i = floor(n * 0.95::DOUBLE)) AS p95, max(value) FILTER (i = floor(n * 0.99::DOUBLE)) AS p99 FROM p""")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.metrics(events(spark, sf_dir), "value")


# --- cost

_ROUTE = f"CASE WHEN length(text) < 40 THEN 'small' WHEN {sql.contains_any('lower(text)', t.COMPLEX)} OR length(text) - length(replace(text, '?', '')) > 1 OR contains(lower(text), ' and ') THEN 'large' ELSE 'medium' END"


@query(f"""WITH k AS (SELECT len({sql.words('text')}) AS used, CASE {_ROUTE} WHEN 'large' THEN 0.03::DOUBLE / 1000 ELSE 0.001::DOUBLE / 1000 END AS rate, role = 'assistant' AS hit FROM conversations),
s AS (SELECT count(*) AS n, sum(CASE WHEN hit THEN 0 ELSE used * rate END) AS cost, sum(CASE WHEN hit THEN 0 ELSE used END)::BIGINT AS tokens, count(*) FILTER (hit) AS hits FROM k)
SELECT n AS total_queries, cost AS total_cost, tokens AS total_tokens, hits / n::DOUBLE AS cache_hit_rate, cost / n AS avg_cost_per_query, cost / n * 100000 AS estimated_monthly_cost FROM s""")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    model = F.when(t.route_model("text") == "large", "gpt4").otherwise("gpt4_mini")
    return governance.cost_summary(c.select(t.word_count("text").alias("tokens_used"), model.alias("model"), (F.col("role") == "assistant").alias("cache_hit")))


_MODELS = ("gpt-4o-mini", "gpt-4o", "gpt-4-turbo", "gpt-4", "gpt-3.5-turbo", "other")


@query(f"""WITH m AS (SELECT unnest([{', '.join(f"'{m}'" for m in _MODELS)}]) AS model, unnest([{', '.join(str(n.PRICES.get(m, n.OTHER_PRICE)[0]) for m in _MODELS)}])::DOUBLE AS i, unnest([{', '.join(str(n.PRICES.get(m, n.OTHER_PRICE)[1]) for m in _MODELS)}])::DOUBLE AS o)
SELECT conv_id, turn, model, len({sql.words('text')}) / 1000::DOUBLE * i AS input, 250 / 1000::DOUBLE * o AS output, len({sql.words('text')}) / 1000::DOUBLE * i + 250 / 1000::DOUBLE * o AS total FROM conversations CROSS JOIN m""")
def request_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.word_count("text").alias("w"), F.explode(F.array(*map(F.lit, _MODELS))).alias("model"))
    return rows.select("conv_id", "turn", "model", n.request_cost("w", F.lit(250), "model").alias("c")).select("conv_id", "turn", "model", "c.*")


@query(f"""SELECT conv_id, turn, greatest(4000 - 500 - len({sql.words('text')}) - 1000, 0)::INTEGER AS remaining, floor(greatest(4000 - 500 - len({sql.words('text')}) - 1000, 0) * 0.6::DOUBLE)::INTEGER AS available_for_context FROM conversations""")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.word_count("text").alias("w"))
    return rows.select("conv_id", "turn", n.budget(F.lit(4000), F.lit(500), "w", F.lit(1000)).alias("b")).select("conv_id", "turn", "b.*")


# --- cache, breakers, audit

@query("""WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), c AS (SELECT user_id, ts AS c_ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL),
j AS (SELECT r.*, c.c_ts, c.value FROM r ASOF LEFT JOIN c ON r.user_id = c.user_id AND r.ts >= c.c_ts)
SELECT event_id, user_id AS key, coalesce(epoch_us(ts) - epoch_us(c_ts) <= 3600000000, false) AS hit, CASE WHEN epoch_us(ts) - epoch_us(c_ts) <= 3600000000 THEN value END AS value FROM j""")
def cache_ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases fill a cache by user; every other event looks its user up."""
    e = events(spark, sf_dir).withColumnRenamed("user_id", "key")
    cache = e.filter("event_type = 'purchase'").groupBy("key", "ts").agg(F.max("value").alias("value"))
    return governance.cache_lookup(e.filter("event_type <> 'purchase'").select("key", "ts", "event_id"), cache).select("event_id", "key", "hit", "value")


@query("SELECT count(*) AS total, count(*) FILTER (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts) <= 864000000000) AS valid, count(*) FILTER (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts) > 864000000000) AS expired FROM events")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.cache_stats(events(spark, sf_dir), F.lit("2024-01-30 00:00:00"), 864_000.0)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service, ts, ok): each event type as a service whose calls over 80 fail."""
    return events(spark, sf_dir).select(F.col("event_type").alias("service"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") < 80).alias("ok"))


BREAKERS = """WITH RECURSIVE c AS MATERIALIZED (SELECT event_type AS service, ts, value < 80 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts, value < 80) AS i FROM events),
b(service, i, ts, ok, allowed, state, fails, last, good) AS (SELECT service, 1::BIGINT, ts, ok, true, 'closed', CASE WHEN ok THEN 0 ELSE 1 END, ts, 0 FROM c WHERE i = 1 UNION ALL
  SELECT service, i, ts, ok, lets, CASE WHEN NOT lets THEN 'open' WHEN ok AND now = 'half_open' AND g + 1 >= 2 THEN 'closed' WHEN NOT ok AND (now = 'half_open' OR fails + 1 >= 3) THEN 'open' ELSE now END,
    CASE WHEN NOT lets THEN fails WHEN ok THEN 0 ELSE fails + 1 END, CASE WHEN lets AND NOT ok THEN ts ELSE last END, CASE WHEN lets AND ok AND now = 'half_open' THEN g + 1 ELSE g END
  FROM (SELECT c.service, c.i, c.ts, c.ok, b.fails, b.last, b.state <> 'open' OR epoch_us(c.ts) - epoch_us(b.last) >= 30000000 AS lets,
    CASE WHEN b.state = 'open' THEN 'half_open' ELSE b.state END AS now, CASE WHEN b.state = 'open' THEN 0 ELSE b.good END AS g FROM b JOIN c ON c.service = b.service AND c.i = b.i + 1))
SELECT service, ts, ok, allowed, state FROM b"""


@query(BREAKERS)
def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(governance.replay_breakers(calls(spark, sf_dir)), "ts")


@query("""SELECT concat('{"event":"query","timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '","user_id":', user_id, ',"event_type":"', event_type, '"}') AS value FROM events""")
def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.audit_lines(events(spark, sf_dir), "query", ["user_id", "event_type"])


@query("""SELECT concat('{"event":"ingestion","timestamp":"2025-01-01T00:00:00Z","user_id":"loader","tenant_id":"', source, '","doc_id":', doc_id, '}') AS value FROM documents
UNION ALL SELECT concat('{"event":"access_violation","timestamp":"2025-01-01T00:00:00Z","user_id":"user-0","tenant_id":"', source, '","attempted_doc_id":', doc_id, '}') FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)
UNION ALL SELECT concat('{"event":"query","timestamp":"2025-01-01T00:00:00Z","user_id":"user-1","tenant_id":"all","query":"', role, '","retrieved_doc_ids":[', conv_id, ',', turn, '],"retrieved_count":2}') FROM conversations""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all three kinds: every document's ingestion, a user's attempts at documents that no grant covers, and every turn as a query."""
    at = F.lit("2025-01-01 00:00:00").alias("ts")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant_id"), at)
    grants = table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id")
    loaded = docs.withColumn("user_id", F.lit("loader"))
    refused = governance.denied(docs.withColumn("user_id", F.lit("user-0")), grants, ["doc_id"]).withColumnRenamed("doc_id", "attempted_doc_id")
    asked = table(spark, sf_dir, "conversations").select(at, F.lit("user-1").alias("user_id"), F.lit("all").alias("tenant_id"), F.col("role").alias("query"), F.array("conv_id", "turn").alias("retrieved_doc_ids"))
    return governance.audit(loaded, "ingestion").unionAll(governance.audit(refused, "access_violation")).unionAll(governance.audit(asked, "query"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), -1) AS k FROM events")
def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON within other text."""
    said = F.concat(F.lit("Here you are: "), "props", F.lit(" - done."))
    return events(spark, sf_dir).select("event_id", F.coalesce(t.json_in(said, "k int")["k"], F.lit(-1)).alias("k"))


# --- streams

@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL""")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(streams.drain(streams.tumbling(streams.read(spark, sf_dir)), "complete"))


@query("""WITH s AS (SELECT value, unnest([0, 3]) AS back, ts FROM events), w AS (SELECT value, date_trunc('day', ts) + to_hours((3 * (extract(hour FROM ts) // 3))::BIGINT) - to_hours(back::BIGINT) AS start FROM s)
SELECT start::TIMESTAMP AS start, count(*) AS n, avg(value) AS mean FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(streams.drain(streams.sliding(streams.read(spark, sf_dir)), "complete"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(streams.drain(streams.sessions(streams.read(spark, sf_dir)), "complete"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event sent twice is taken once."""
    rows = streams.read(spark, sf_dir).select("event_id", "user_id", "ts")
    return streams.drain(streams.first_seen(rows.unionAll(rows), ["event_id"], late=None), "append").select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.counters(streams.read(spark, sf_dir)), "complete")


@query(BREAKERS)
def stream_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.read(spark, sf_dir).select(F.col("event_type").alias("service"), "ts", (F.col("value") < 80).alias("ok"))
    return _naive(streams.drain(streams.breakers(rows), "append"), "ts")


def _naive(df: DataFrame, name: str = "start") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))
