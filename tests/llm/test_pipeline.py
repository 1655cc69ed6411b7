from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from granary.llm import neardup, packing, quality, tokencount, toxicity
from tests.conftest import SF
from tests.llm.conftest import HARD
from tests.llm.test_quality_sharding_packing import by_plain_loops

DOC_STAGES = corpus_pipeline.STAGES[:-1]


def test_run_against_brute_force(spark):
    """Each stage done in plain Python, but for the quality limits, which are read off sorted lists."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in table.collect()]
    stems = toxicity.learn(table, spark.read.parquet(f"{SF}/labels.parquet"))
    total, most, _, words = toxicity.scores(pa.array([d[1] for d in docs]), stems)
    docs = [d for d, bad in zip(docs, toxicity.is_toxic(total, most, words, toxicity.Limits()), strict=True) if not bad]

    rules, m = quality.Rules(), quality.measures(pa.array([d[1] for d in docs]))

    def on_grid(v):
        drop = max(int(v).bit_length() - 7, 0)
        return int(v) >> drop << drop

    langs, groups = defaultdict(list), defaultdict(list)
    for d, x in zip(docs, m, strict=True):
        langs[d[2]].append(x), groups[d[2], d[3]].append(x)
    ok = []
    for d, x in zip(docs, m, strict=True):
        mine, shared = groups[d[2], d[3]], langs[d[2]]
        good = True
        for j in range(4):
            weighed = sorted([(on_grid(y[j + 1]), len(shared)) for y in mine] + [(on_grid(y[j + 1]), rules.prior) for y in shared])
            upto, q = np.cumsum([w for _, w in weighed]), []
            for p in (0.25, 0.5, 0.75):
                q.append(weighed[int(np.searchsorted(upto, upto[-1] * p))][0])
            slack = rules.slack[j] // x[0]
            good &= x[j + 1] <= q[1] + rules.reach * max(q[2] - q[1], rules.floors[j]) + slack
            good &= j < 3 or x[4] >= q[1] - rules.reach * max(q[1] - q[0], rules.floors[3]) - slack
        if good:
            ok.append(d)
    first = {}
    for d in ok:
        first[d[1]] = min(first.get(d[1], d), d)
    docs = sorted(first.values())

    index = neardup.Index()
    sig, _ = neardup.signatures(pa.array([d[1] for d in docs]), index)
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in a + 1 + np.flatnonzero((sig[a] != sig[a + 1 :]).sum(1) <= index.distance):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    docs = [d for i, d in enumerate(docs) if root[i] == i]

    encoder = tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=tokencount.read_ranks(tokencount.VOCABULARY), special_tokens={})
    want = set(by_plain_loops([(d[0], len(encoder.encode_ordinary(d[1]))) for d in docs], packing.CAPACITY, 1))
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("stage", [f for _, f in DOC_STAGES], ids=[n for n, _ in DOC_STAGES])
def test_stages_take_hard_rows(spark, hard, nothing, stage):
    out = stage(spark, hard, SF)
    assert out.columns == hard.columns
    assert 0 < out.count() <= len(HARD)
    assert stage(spark, nothing, SF).count() == 0


def test_packing_takes_hard_rows(spark, hard, nothing):
    assert corpus_pipeline.pack(spark, hard, SF).count() > 0
    assert corpus_pipeline.pack(spark, nothing, SF).count() == 0
