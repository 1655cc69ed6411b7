"""Findings of the second round: one small test for each."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import text as t
from granary.operators import chunking, governance, graph, lexical, retrieval
from granary.streaming import events as streams


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rrf_ranks_ties_by_id(spark):
    """Scores equal to nine decimals tie within each list too."""
    rows = [(0, 1, "vector", 0.5), (0, 2, "vector", 0.5 + 1e-12), (0, 1, "lexical", 3.0), (0, 2, "lexical", 3.0 + 1e-12)]
    out = retrieval.fuse(spark.createDataFrame(rows, "query_id int, id int, system string, score double"), "rrf").collect()
    assert {r["id"]: round(r["fused_score"], 12) for r in out} == {1: round(1 / 61, 12), 2: round(1 / 62, 12)}


def test_bm25_scores_where_texts_lie(spark):
    """No pair of query and document is shuffled: each task passes on at most k rows of a query, among many ties those of the least ids."""
    docs = spark.range(4000, numPartitions=4).select("id", F.expr("if(id % 2 = 0, 'red fish', concat('blue fish ', id))").alias("text")).toDF("doc_id", "text")
    asked = spark.createDataFrame([(7, "red red FISH"), (8, "green"), (9, "blue fish fish")], "query_id int, text string")
    new = sorted(map(tuple, lexical.bm25(docs, asked, 5).collect()))
    old = sorted(map(tuple, lexical.search(lexical.entries(docs), asked, 5).collect()))
    assert [(q, d, r) for q, d, _, r in new] == [(q, d, r) for q, d, _, r in old] and len(new) == 10
    assert [s for *_, s, _ in new] == pytest.approx([s for *_, s, _ in old])
    assert [d for q, d, _, _ in new if q == 7] == [0, 2, 4, 6, 8]
    best = lexical.Best(2, 1)
    for lo in range(0, 600_000, 100_000):
        best.add(pa.array(range(lo, lo + 100_000)), np.ones((100_000, 1)))
        assert best.held <= best.limit + 100_000
    assert [b.to_pydict() for b in best.rows(pa.array(["q"]), ["q", "d", "s"])] == [{"q": ["q", "q"], "d": [0, 1], "s": [1.0, 1.0]}]


def test_bm25_of_queries_beyond_the_bound(spark, monkeypatch):
    """Too many terms for a task go by the shuffled index, with the same rows."""
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "b"), (2, "c a")], "query_id int, text string")
    want = lexical.bm25(docs, asked, 3).collect()
    monkeypatch.setattr(lexical.Asked, "of", staticmethod(lambda queries: None))
    assert sorted(map(str, lexical.bm25(docs, asked, 3).collect())) == sorted(map(str, want)) and len(want) == 4


def test_term_matches_without_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b A b é"), (2, None), (3, "c\u00a0c c")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "É b b a"), (2, "c x"), (3, "")], "query_id int, text string")
    got = lexical.term_matches(docs, asked)
    assert "Exchange" not in plan(got)
    assert {(r[0], r[1], tuple(sorted(r[2].items()))) for r in got.collect()} == {(1, 1, (("a", 1), ("b", 2), ("é", 1))), (2, 3, (("c", 1),))}
    joined = {tuple(r) for r in lexical.term_matches(docs, asked, joined=True).collect()}
    assert joined == {(1, 1, "a=1|b=2|é=1"), (2, 3, "c=1")}
    monkeypatch.setattr(lexical.Asked, "of", staticmethod(lambda queries: None))
    assert {tuple(r) for r in lexical.term_matches(docs, asked, joined=True).collect()} == joined


def test_coherence_splits_once(spark):
    texts = ["One two. Two three! four", "", None, " . ", "A.B c. C  b?\n\nB", "Σας ΣΑΣ. σας! x\u00a0y. X\u00a0Y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = docs.select("doc_id", t.coherence("text").alias("coherence"))
    got = chunking.coherence(docs, "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "transform(" not in plan(got)


def test_quality_report_reads_texts_once(spark):
    chunks = spark.createDataFrame([("a", 0, "x y. y z", 4), ("a", 1, "Z q", 2), ("b", 0, None, 0)], "doc_id string, chunk_index int, text string, token_count int")
    report = chunking.quality_report(chunks)
    assert plan(report).split("== Initial Plan ==")[0].count("MapInArrow") == 1 and "BroadcastNestedLoopJoin" not in plan(report)
    (r,) = report.collect()
    assert (r["total_chunks"], r["min_tokens"], r["max_tokens"], r["too_small"]) == (3, 0, 4, 3)
    assert r["overlap_quality"] == 0.5 and r["avg_coherence"] == 0.5
    assert chunking.overlap_quality(chunks).collect() == [(0.5,)]


def test_breaker_leaves_in_pieces():
    class State:
        exists = False

        def update(self, values):
            self.get, self.exists = values, True

    calls = pd.DataFrame({"ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.random.default_rng(1).integers(0, 10**6, 45_000), unit="s"), "ok": np.random.default_rng(2).random(45_000) < 0.7})
    state = State()
    parts = list(streams.replay(("llm",), iter([calls[:20_000], calls[20_000:]]), state, governance.BREAKERS))
    assert max(map(len, parts)) <= 10_000
    b, want = governance.Breaker(*governance.BREAKERS["llm"]), []
    rows = calls.sort_values(["ts", "ok"], kind="stable")
    for at, ok in zip(rows["ts"], rows["ok"], strict=True):
        want.append((at, ok, b.call(at.timestamp(), ok), b.state))
    out = pd.concat(parts)
    assert list(out[["ts", "ok", "allowed", "state"]].itertuples(index=False, name=None)) == want
    assert state.get == (b.state, b.count, b.last, b.good)


def test_matches_grow_in_many_parts(spark):
    """All sequences pass one vertex; they are spread over tasks before they grow, and no step with few edges is shuffled to."""
    v = [("n", "N", "n", {})] + [(f"a{i}", "A", "", {}) for i in range(60)] + [(f"b{i}", "B", "", {}) for i in range(50)]
    e = [(f"a{i}", "n", "X", {}) for i in range(60)] + [(f"b{i}", "n", "Y", {}) for i in range(50)]
    vs, es = spark.createDataFrame(v, "id string, type string, name string, properties map<string,string>"), spark.createDataFrame(e, "source_id string, target_id string, type string, properties map<string,string>")
    found = graph.match(vs, es, [("A", "X"), ("N", "Y"), ("B", None)]).withColumn("part", F.spark_partition_id())
    assert found.select("ids").distinct().count() == found.count() == 3000
    assert found.select("part").distinct().count() > 2 and "SortMergeJoin" not in plan(found)


def test_stored_index_is_sharded_by_document(spark, tmp_path):
    """Counting and storing shuffle nothing, and a search scores documents whose entries lie in several files or tasks."""
    docs = spark.createDataFrame([(i, f"red w{i % 7} fish fish" if i % 3 else "blue") for i in range(300)] + [(1000, None)], "doc_id int, text string").repartition(5)
    asked = spark.createDataFrame([(1, "fish w3 w3"), (2, "blue RED"), (3, "none")], "query_id int, text string")
    index = lexical.entries(docs)
    assert plan(index).count("Exchange") == plan(docs).count("Exchange")
    lexical.store(index, f"{tmp_path}/i")
    stored = spark.read.parquet(f"{tmp_path}/i")
    got, want = lexical.search(stored, asked, 8).collect(), lexical.bm25(docs, asked, 8).collect()
    rows = lambda x: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in x)
    assert rows(got) == rows(want) and len(got) == 16
    assert rows(lexical.search(stored, asked, None).filter("rank <= 8").collect()) == rows(want)
