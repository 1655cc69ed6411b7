"""Queries over a property graph of regions, nations, customers, suppliers and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import graph
from granary.plans.registry import query
from granary.runtime import table

_VERTICES = (("Region", "region", "r_regionkey", "r_name", None), ("Nation", "nation", "n_nationkey", "n_name", None), ("Customer", "customer", "c_custkey", "c_name", "c_mktsegment"), ("Supplier", "supplier", "s_suppkey", "s_name", None))
_EDGES = (("Nation", "nation", "n_nationkey", "Region", "n_regionkey", "PART_OF"), ("Customer", "customer", "c_custkey", "Nation", "c_nationkey", "LIVES_IN"), ("Supplier", "supplier", "s_suppkey", "Nation", "s_nationkey", "BASED_IN"))


def _id(kind: str, key: str) -> str:
    return f"concat('{kind.lower()}_', {key})"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, name, properties)"""
    parts = [
        table(spark, sf_dir, t).select(F.expr(_id(kind, key)).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), (F.create_map(F.lit("segment"), F.col(extra)) if extra else F.create_map().cast("map<string,string>")).alias("properties"))
        for kind, t, key, name, extra in _VERTICES
    ]
    return reduce(DataFrame.unionAll, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, type, properties)"""
    parts = [table(spark, sf_dir, t).select(F.expr(_id(kind, key)).alias("source_id"), F.expr(_id(to, ref)).alias("target_id"), F.lit(rel).alias("type"), F.create_map().cast("map<string,string>").alias("properties")) for kind, t, key, to, ref, rel in _EDGES]
    return reduce(DataFrame.unionAll, parts)


GRAPH = f"""v AS ({' UNION ALL '.join(f"SELECT {_id(kind, key)} AS id, '{kind}' AS type, {name} AS name, {extra or 'NULL'} AS segment FROM {t}" for kind, t, key, name, extra in _VERTICES)}),
e AS ({' UNION ALL '.join(f"SELECT {_id(kind, key)} AS source_id, {_id(to, ref)} AS target_id, '{rel}' AS type FROM {t}" for kind, t, key, to, ref, rel in _EDGES)}),
bw AS (SELECT source_id AS src, target_id AS dst, type FROM e UNION ALL SELECT target_id, source_id, type FROM e)"""


@query(f"WITH {GRAPH} SELECT src AS id, dst AS neighbour_id, type AS relation FROM bw")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir)
    return graph.neighbours(v, edges(spark, sf_dir), v)


@query(f"WITH {GRAPH} SELECT src AS id, dst AS neighbour_id, type AS relation FROM bw WHERE type = 'LIVES_IN'")
def graph_neighbors_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir)
    return graph.neighbours(v, edges(spark, sf_dir), v, "LIVES_IN")


@query("SELECT concat('customer_', c_custkey) AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def graph_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_property(vertices(spark, sf_dir), "Customer", "segment", "BUILDING").select("id", "name")


@query(f"WITH {GRAPH} SELECT id, name FROM v WHERE type = 'Supplier'")
def graph_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_property(vertices(spark, sf_dir), "Supplier").select("id", "name")


def _seeds(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return vertices(spark, sf_dir).filter(F.col("type") == kind).select(F.col("id").alias("seed"))


def _bfs(kind: str, hops: int, relation: str = "true") -> str:
    parts = [f"{GRAPH}, st AS (SELECT DISTINCT src, dst FROM bw WHERE {relation}), h0 AS (SELECT id AS seed, id FROM v WHERE type = '{kind}')"]
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT seed, id FROM h{i}" for i in range(h))
        parts.append(f"h{h} AS (SELECT DISTINCT f.seed, dst AS id FROM h{h - 1} f JOIN st ON st.src = f.id WHERE (f.seed, dst) NOT IN ({seen}))")
    return ", ".join(parts) + ", hops AS (" + " UNION ALL ".join(f"SELECT seed, {i} AS hop, id FROM h{i}" for i in range(hops + 1)) + ")"


@query(f"WITH {_bfs('Region', 2)} SELECT * FROM hops")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(vertices(spark, sf_dir), edges(spark, sf_dir), _seeds(spark, sf_dir, "Region"), 2)


@query(f"""WITH {_bfs('Region', 2, "type <> 'LIVES_IN'")} SELECT * FROM hops WHERE hop < 2""")
def graph_bfs_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(vertices(spark, sf_dir), edges(spark, sf_dir), _seeds(spark, sf_dir, "Region"), 2, "PART_OF")


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start, end): every customer and its region."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.expr(_id("Customer", "c_custkey")).alias("start"), F.expr(_id("Region", "n_regionkey")).alias("end"))


@query("SELECT a.r_name AS start_name, b.r_name AS end_name FROM region a JOIN region b ON a.r_name < b.r_name")
def graph_seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.seed_pairs(table(spark, sf_dir, "region").select(F.col("r_name").alias("seed"))).toDF("start_name", "end_name")


@query("""SELECT concat('customer_', c_custkey) AS "start", concat('region_', n_regionkey) AS "end", concat('customer_', c_custkey, ' LIVES_IN nation_', n_nationkey, ' PART_OF region_', n_regionkey) AS path FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of up to two edges from every customer to the region of its nation."""
    v = vertices(spark, sf_dir)
    pairs = _homes(spark, sf_dir)
    steps = F.array_join(F.transform("path", lambda s: F.concat_ws(" ", s["relation"], s["target"])), " ")
    return graph.paths(v, edges(spark, sf_dir), pairs, 2).select("start", "end", F.concat_ws(" ", "start", steps).alias("path"))


@query("""SELECT concat('customer_', c_custkey) AS "start", concat('Customer "', c_name, '" → lives in Nation "', n_name, '" → part of Region "', r_name, '"') AS text FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def graph_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir)
    pairs = _homes(spark, sf_dir)
    return graph.path_text(graph.paths(v, edges(spark, sf_dir), pairs, 2), v).select("start", "text")


@query("SELECT concat('customer_', c_custkey, ',nation_', n_nationkey, ',supplier_', s_suppkey) AS ids FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey")
def graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = [("Customer", "LIVES_IN"), ("Nation", "BASED_IN"), ("Supplier", None)]
    return graph.match(vertices(spark, sf_dir), edges(spark, sf_dir), pattern).select(F.array_join("ids", ",").alias("ids"))


@query(f"WITH {GRAPH} SELECT 'entity' AS kind, type, count(*) AS n FROM v GROUP BY type UNION ALL SELECT 'relation', type, count(*) FROM e GROUP BY type")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(vertices(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {_bfs('Region', 1)}, ids AS (SELECT DISTINCT id FROM hops) SELECT e.source_id, e.target_id, e.type FROM e WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids)")
def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir)[1].select("source_id", "target_id", "type")


def _around(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.subgraph(vertices(spark, sf_dir), edges(spark, sf_dir), _seeds(spark, sf_dir, "Region"), 1)[:2]


STATEMENTS = f"""{GRAPH}, s AS (SELECT e.source_id, a.type AS st, a.name AS sn, lower(replace(e.type, '_', ' ')) AS phrase, b.type AS tt, b.name AS tn FROM e JOIN v a ON a.id = e.source_id JOIN v b ON b.id = e.target_id)"""


@query(f"""WITH {STATEMENTS} SELECT source_id, concat(st, ' "', sn, '" ', phrase, ' ', tt, ' "', tn, '".') AS line FROM s""")
def graph_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statements(vertices(spark, sf_dir), edges(spark, sf_dir)).select("source_id", graph.sentence().alias("line"))


_NEAR = f"{STATEMENTS}, sub AS (SELECT * FROM s WHERE st = 'Nation')"


@query(f"""WITH {_NEAR}, l AS (SELECT concat('**', st, ': ', sn, '**', chr(10), string_agg(concat('  - ', phrase, ' ', tt, ' "', tn, '"'), chr(10) ORDER BY concat('  - ', phrase, ' ', tt, ' "', tn, '"'))) AS line FROM sub GROUP BY source_id, st, sn)
SELECT string_agg(line, chr(10) ORDER BY line) AS text FROM l""")
def graph_text_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph_text(*_around(spark, sf_dir), "bullet")


@query(f"""WITH {_NEAR} SELECT concat('[', st, ' Relationships]', chr(10), string_agg(concat('- ', st, ' "', sn, '" ', phrase, ' ', tt, ' "', tn, '"'), chr(10) ORDER BY concat('- ', st, ' "', sn, '" ', phrase, ' ', tt, ' "', tn, '"')), chr(10)) AS text FROM sub GROUP BY st""")
def graph_text_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph_text(*_around(spark, sf_dir), "structured")


@query(f"""WITH {_NEAR}, l AS (SELECT concat(st, ' "', sn, '" ', phrase, ' ', tt, ' "', tn, '".') AS line FROM sub),
c AS (SELECT string_agg(n || ' ' || type || '(s)', ', ' ORDER BY n || ' ' || type || '(s)') AS types FROM (SELECT type, count(*) AS n FROM v WHERE type IN ('Region', 'Nation') GROUP BY type))
SELECT concat('[Graph Evidence]', chr(10), 'Entities found: ', types, chr(10), chr(10), 'Key relationships:', chr(10), (SELECT string_agg(line, chr(10) ORDER BY line) FROM l)) AS text FROM c""")
def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.evidence(*_around(spark, sf_dir))


@query(f"""WITH {GRAPH} SELECT 'node' AS kind, concat('CREATE (n:', type, ' {{id: "', id, '", name: "', name, '"', CASE WHEN segment IS NOT NULL THEN concat(', segment: "', segment, '"') ELSE '' END, '}})') AS line FROM v
UNION ALL SELECT 'edge', concat('MATCH (a {{id: "', source_id, '"}}), (b {{id: "', target_id, '"}}) CREATE (a)-[:', type, ']->(b)') FROM e""")
def cypher_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cypher(vertices(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH {GRAPH}, q AS (SELECT c_custkey AS query_id, 'region_' || replace(lower(r_name), ' ', '_') AS seed FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
rv AS (SELECT 'region_' || replace(lower(name), ' ', '_') AS id, id AS old FROM v WHERE type = 'Region')
SELECT query_id, q.seed, 0 AS hop, q.seed AS id FROM q JOIN rv ON rv.id = q.seed UNION ALL
SELECT query_id, q.seed, 1, bw.dst FROM q JOIN rv ON rv.id = q.seed JOIN bw ON bw.src = rv.old""")
def graph_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks about its region by name; what lies one hop around the region comes back."""
    v, e = vertices(spark, sf_dir), edges(spark, sf_dir)
    named = F.concat(F.lit("region_"), F.replace(F.lower("name"), F.lit(" "), F.lit("_")))
    renamed = v.withColumn("id", F.when(F.col("type") == "Region", named).otherwise(F.col("id")))
    regions = v.filter("type = 'Region'").select(F.col("id").alias("target_id"), named.alias("__new"))
    moved = e.join(regions, "target_id", "left").select("source_id", F.coalesce("__new", "target_id").alias("target_id"), "type", "properties")
    geo = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = geo.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("What happened in "), "r_name", F.lit(" last year?")).alias("text"))
    return graph.graph_retrieve(asked, renamed, moved, 1, {"Region": ["africa", "america", "asia", "europe", r"middle east"]})
