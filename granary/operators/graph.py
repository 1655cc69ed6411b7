"""Property graph over vertices (id, type, name, properties) and edges (source_id, target_id, type, properties)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.functions import text as t
from granary.runtime import BROADCAST_BYTES, cut_lineage


def both_ways(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """(src, dst, type) in both directions."""
    e = edges if relation is None else edges.filter(F.col("type") == relation)
    return e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "type").unionAll(e.select(F.col("target_id"), F.col("source_id"), "type"))


def neighbours(vertices: DataFrame, edges: DataFrame, of: DataFrame, relation: str | None = None) -> DataFrame:
    """(id, neighbour_id, relation): edges of ``of`` (id) to vertices that exist."""
    hops = both_ways(edges, relation).join(of.select(F.col("id").alias("src")), "src")
    return hops.join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbour_id"), F.col("type").alias("relation"))


def by_property(vertices: DataFrame, kind: str, key: str | None = None, value: str | None = None) -> DataFrame:
    out = vertices.filter(F.col("type") == kind)
    return out if key is None else out.filter(F.try_element_at("properties", F.lit(key)) == value)


def bfs(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, max_hops: int = 2, relation: str | None = None) -> DataFrame:
    """(seed, hop, id): the hop at which each vertex is first reached from each seed (seed); the seed itself at hop 0, known or not.
    All seeds go at once; only the frontier is joined, and its lineage is cut each hop."""
    step = both_ways(edges, relation).select("src", "dst").distinct().join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi")
    seen = front = seeds.select("seed", F.lit(0).alias("hop"), F.col("seed").alias("id")).distinct()
    for hop in range(1, max_hops + 1):
        reached = front.join(step, F.col("id") == F.col("src")).select("seed", F.lit(hop).alias("hop"), F.col("dst").alias("id")).distinct()
        front = cut_lineage(reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "hop", "id"))
        seen = seen.unionAll(front)
    return seen


def paths(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, end, path): all simple paths of at most ``max_depth`` edges between pairs (start, end); one empty path if both are the same.
    path is an array of (source, relation, target)."""
    step = both_ways(edges).join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.col("type").alias("rel"))
    hop = F.struct(F.col("src").alias("source"), F.col("rel").alias("relation"), F.col("dst").alias("target"))
    blank = F.filter(F.array(F.struct(F.col("start").alias("source"), F.lit("").alias("relation"), F.col("start").alias("target"))), lambda _: F.lit(False))
    base = pairs.select("start", "end", F.col("start").alias("at"), F.array("start").alias("visited"), blank.alias("path"))
    done, live = base.filter("start = end"), base.filter("start <> end")
    for depth in range(1, max_depth + 1):
        on = F.col("at") == F.col("src")
        # The last edge must lead to the end, so it is joined on both its ends.
        longer = live.join(step, on & (F.col("end") == F.col("dst")) if depth == max_depth else on).filter(~F.array_contains("visited", F.col("dst")))
        longer = longer.select("start", "end", F.col("dst").alias("at"), F.concat("visited", F.array("dst")).alias("visited"), F.concat("path", F.array(hop)).alias("path"))
        longer = cut_lineage(longer)
        done, live = done.unionAll(longer.filter("at = end")), longer.filter("at <> end")
    return done.select("start", "end", "path")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(*edges.columns)


def subgraph(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, max_hops: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices and edges within ``max_hops`` of any seed, and the hop table."""
    hops = bfs(vertices, edges, seeds, max_hops)
    ids = hops.select("id").distinct()
    return vertices.join(ids, "id", "left_semi"), induced(edges, ids), hops


def seed_pairs(seeds: DataFrame) -> DataFrame:
    """(start, end) of all pairs of distinct seeds in order."""
    return seeds.select(F.col("seed").alias("start")).join(seeds.select(F.col("seed").alias("end")), F.col("start") < F.col("end"))


def match(vertices: DataFrame, edges: DataFrame, pattern: Sequence[tuple[str, str | None]]) -> DataFrame:
    """(ids): vertex sequences of a chain [(type, relation to the next), ...], edges in either direction, revisits allowed.

    A step whose edges are few is broadcast, so that sequences grow where they lie and one vertex with many edges is no task's burden; what is
    shuffled is never more than the sequences before the last large step. There are as many rows as matches."""
    typed = vertices.select("id", "type")
    out = typed.filter(F.col("type") == pattern[0][0]).select(F.array("id").alias("ids"), F.col("id").alias("at"))
    for (_, relation), (kind, _) in zip(pattern, pattern[1:], strict=False):
        step = both_ways(edges, relation).select("src", "dst").join(typed.filter(F.col("type") == kind).select(F.col("id").alias("dst")), "dst")
        step = cut_lineage(step)
        if step.count() * 128 <= BROADCAST_BYTES:
            # In so many parts, however few bytes they are: they grow only afterwards.
            out, step = out.repartition(int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ids"), F.broadcast(step)
        out = out.join(step, F.col("at") == F.col("src")).select(F.concat("ids", F.array("dst")).alias("ids"), F.col("dst").alias("at"))
    return out.select("ids")


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n) of entities and relations."""
    return vertices.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), "type", "n").unionAll(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation"), "type", "n"))


def statements(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the types and names of both ends and their phrase; edges without an end go."""
    v = [vertices.select(F.col("id").alias(f"{s}_id"), F.col("type").alias(f"{s}_type"), F.col("name").alias(f"{s}_name")) for s in ("source", "target")]
    return edges.select("source_id", "target_id", t.relation_phrase("type").alias("phrase")).join(v[0], "source_id").join(v[1], "target_id")


def sentence(style: str = "natural") -> Column:
    subject = F.concat("source_type", F.lit(' "'), "source_name", F.lit('"'))
    thing = F.concat("phrase", F.lit(" "), "target_type", F.lit(' "'), "target_name", F.lit('"'))
    return {"natural": F.concat(subject, F.lit(" "), thing, F.lit(".")), "structured": F.concat(F.lit("- "), subject, F.lit(" "), thing), "bullet": F.concat(F.lit("  - "), thing)}[style]


def lines(items: Column, sep: str = "\n") -> Column:
    return F.array_join(F.array_sort(F.collect_list(items)), sep)


def subgraph_text(vertices: DataFrame, edges: DataFrame, style: str = "natural") -> DataFrame:
    """One row (text). natural: sentences; bullet: facts under their source; structured: sections by source type. In alphabetical order."""
    rows = statements(vertices, edges).withColumn("line", sentence(style))
    if style == "natural":
        return rows.agg(lines(F.col("line")).alias("text"))
    if style == "bullet":
        part = rows.groupBy("source_id", "source_type", "source_name").agg(lines(F.col("line")).alias("body"))
        return part.agg(lines(F.concat(F.lit("**"), "source_type", F.lit(": "), "source_name", F.lit("**\n"), "body")).alias("text"))
    part = rows.groupBy("source_type").agg(lines(F.col("line")).alias("body"))
    return part.agg(lines(F.concat(F.lit("["), "source_type", F.lit(" Relationships]\n"), "body", F.lit("\n"))).alias("text"))


def path_text(found: DataFrame, vertices: DataFrame, key: Sequence[str] = ("start", "end", "path")) -> DataFrame:
    """Paths with a text: the first source, then phrase and target of each step."""
    rows = found.select(*key, F.posexplode("path").alias("i", "s")).select(*key, "i", F.col("s.source").alias("source_id"), F.col("s.target").alias("target_id"), F.col("s.relation").alias("type"))
    v = [vertices.select(F.col("id").alias(f"{s}_id"), F.concat("type", F.lit(' "'), "name", F.lit('"')).alias(s)) for s in ("source", "target")]
    named = rows.join(v[0], "source_id").join(v[1], "target_id")
    part = F.concat(F.when(F.col("i") == 0, F.concat("source", F.lit(" → "))).otherwise(""), t.relation_phrase("type"), F.lit(" "), F.col("target"))
    return named.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))), lambda x: x["p"]), " → ").alias("text"))


def evidence(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (text): how many entities of each type, then the statements."""
    counts = vertices.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(lines(F.concat(F.col("n").cast("string"), F.lit(" "), "type", F.lit("(s)")), ", ").alias("types"), F.count(F.lit(1)).alias("k"))
    whole = F.concat(F.lit("[Graph Evidence]\nEntities found: "), "types", F.lit("\n\nKey relationships:\n"), "text")
    return counts.crossJoin(subgraph_text(vertices, edges)).select(F.when(F.col("k") == 0, "[No graph evidence found]").otherwise(whole).alias("text"))


def cypher(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, line): a CREATE for each vertex and edge; quotes in values are escaped."""
    def q(c: str | Column) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(t.col(c), r'(["\\])', r"\\$1"), F.lit('"'))
    def props(c: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(": "), q(e["value"]))), ", ")
    more = F.when(F.size("properties") > 0, F.concat(F.lit(", "), props("properties"))).otherwise("")
    nodes = vertices.select(F.lit("node").alias("kind"), F.concat(F.lit("CREATE (n:"), "type", F.lit(" {id: "), q("id"), F.lit(", name: "), q("name"), more, F.lit("})")).alias("line"))
    own = F.when(F.size("properties") > 0, F.concat(F.lit(" {"), props("properties"), F.lit("}"))).otherwise("")
    rels = edges.select(F.lit("edge").alias("kind"), F.concat(F.lit("MATCH (a {id: "), q("source_id"), F.lit("}), (b {id: "), q("target_id"), F.lit("}) CREATE (a)-[:"), "type", own, F.lit("]->(b)")).alias("line"))
    return nodes.unionAll(rels)


# --- entities in texts

ENTITIES = {
    "Customer": "customer client buyer company corp inc ltd".split(),
    "Contract": ["contract", "agreement", "deal", r"c-\d+"],
    "Product": "product service solution software platform".split(),
    "Region": "region territory area apac emea americas latam".split(),
    "Person": "mr ms dr ceo cto manager director".split(),
}


def mentions(text_col: str, patterns: dict[str, list[str]] | None = None) -> Column:
    """Array of the distinct (entity, type) of a text, lower-cased."""

    def named(kind: str) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.lower(m).alias("entity"), F.lit(kind).alias("type"))

    found = [F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"(?i)\b({'|'.join(ps)})\b"), F.lit(1)), named(kind)) for kind, ps in (patterns or ENTITIES).items()]
    return F.array_distinct(F.flatten(F.array(*found)))


def extract(docs: DataFrame, patterns: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, entity, type): the distinct lower-cased mentions of each type in each text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(mentions(text_col, patterns)).alias("e")).select("doc_id", "e.entity", "e.type")


def spans(docs: DataFrame, patterns: dict[str, list[str]] | None = None, around: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, entity, type, start, end, context): first place of each mention and ``around`` characters on both sides."""
    low = F.lower(text_col)

    def place(e: Column) -> Column:
        start = F.regexp_instr(low, F.concat(F.lit(r"\b\Q"), e["entity"], F.lit(r"\E\b"))) - 1
        end, left = start + F.length(e["entity"]), F.greatest(start - around, F.lit(0))
        return F.struct(e["entity"].alias("entity"), e["type"].alias("type"), start.alias("start"), end.alias("end"), F.substring(F.col(text_col), left + 1, end + around - left).alias("context"))

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.transform(mentions(text_col, patterns), place)).alias("e")).select("doc_id", "e.*")


#: Letters from rare to common; characters that aren't among them come first.
RARE = "qxzjkvbpygfwmucldrhsnioate "


def alike(mentions_: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(entity, type, id): pairs of a type that may have a Jaccard similarity of characters over the threshold, and no pair that has is left out.

    Sets so alike share one of their first n - ceil(threshold * n) + 1 characters in a fixed order, and their sizes differ by no more than the
    threshold's factor; with the rarest characters first, few meet under a (type, size, character)."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        order = F.array_sort(F.transform(t.characters(F.lower(name)), lambda c: F.struct(F.call_function("locate", c, F.lit(RARE)).alias("r"), c.alias("c"))))
        rows = df.withColumn("__set", order).withColumn("__n", F.size("__set"))
        lead = F.col("__n") - F.ceil(F.col("__n") * F.lit(threshold) - 1e-9).cast("int") + 1
        return rows.withColumn("__lead", F.explode(F.transform(F.slice("__set", F.lit(1), lead), lambda x: x["c"])))

    a = keyed(mentions_.select("entity", "type"), "entity").filter("__n > 0")
    low, high = F.ceil(F.col("__n") * F.lit(threshold) - 1e-9).cast("int"), F.floor(F.col("__n") / F.lit(threshold) + 1e-9).cast("int")
    wide = a.select("entity", "type", "__lead", F.explode(F.sequence(low, high)).alias("__n"))
    b = keyed(known.select("id", "type", "name"), "name").select("id", "type", "__lead", "__n")
    return wide.join(b, ["type", "__lead", "__n"]).select("entity", "type", "id").distinct()


def link(found: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, threshold: float = 0.8, create: bool = True) -> DataFrame:
    """(entity, type, entity_id, how): by alias, else by the most similar name of the type over the threshold, else a new id (or null).
    An id is made once for each distinct mention."""
    distinct = found.select("entity", "type").distinct()
    known = entities.select(F.col("id"), F.col("type"), F.col("name"))
    aliased = distinct.select("entity", "type", F.lit(None).cast("string").alias("alias_id")) if aliases is None else distinct.join(aliases.select(F.lower("alias").alias("entity"), F.col("entity_id").alias("alias_id")).dropDuplicates(["entity"]), "entity", "left")
    score = t.character_jaccard(F.lower("entity"), F.lower("name"))
    fuzzy = distinct.join(alike(distinct, known, threshold), ["entity", "type"]).join(known, ["id", "type"]).withColumn("s", score).filter(F.col("s") > threshold)
    best = fuzzy.withColumn("r", F.row_number().over(W.partitionBy("entity", "type").orderBy(F.desc("s"), "id"))).filter("r = 1").select("entity", "type", F.col("id").alias("fuzzy_id"))
    made = F.concat(F.lower("type"), F.lit("_"), F.replace(F.lower("entity"), F.lit(" "), F.lit("_"))) if create else F.lit(None).cast("string")
    out = aliased.join(best, ["entity", "type"], "left")
    how = F.when(F.col("alias_id").isNotNull(), "alias").when(F.col("fuzzy_id").isNotNull(), "fuzzy").otherwise("created" if create else "none")
    return out.select("entity", "type", F.coalesce("alias_id", "fuzzy_id", made).alias("entity_id"), how.alias("how"))


def graph_retrieve(queries: DataFrame, vertices: DataFrame, edges: DataFrame, max_hops: int = 2, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_id, seed, hop, id): what lies around the entities that each query names and the graph knows."""
    named = extract(queries, patterns, id_col="query_id").select(F.col("doc_id").alias("query_id"), F.concat(F.lower("type"), F.lit("_"), F.replace("entity", F.lit(" "), F.lit("_"))).alias("seed"))
    known = named.join(vertices.select(F.col("id").alias("seed")), "seed", "left_semi")
    return known.join(bfs(vertices, edges, known.select("seed").distinct(), max_hops), "seed").select("query_id", "seed", "hop", "id")
