from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import exact_dedup, neardup
from tests.llm.conftest import HARD, frame


def test_kept_ids(hard):
    best = {}
    for i, t, *_ in HARD:
        if t not in best or best[t] is None or (i is not None and i < best[t]):
            best[t] = i
    got = exact_dedup.kept_ids(hard).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i in best.values())


@pytest.mark.parametrize("heavy", [0, 2, 1024])
def test_rows_that_stay(hard, heavy):
    out = exact_dedup.deduplicate(hard, heavy=heavy)
    assert out.columns == hard.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert got == [(False, i) for i in (1, 3, 5, 7, 9)] + [(True, 0)]


def test_repeated_winner_stays_once(spark):
    docs = frame(spark, [(1, "same", "en", "a")] * 3 + [(2, "same", "en", "a"), (3, "other", "en", "a")])
    for heavy in (0, 1024):
        assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs, heavy=heavy).collect()) == [1, 3]


def test_empty(nothing):
    assert exact_dedup.kept_ids(nothing).count() == 0
    assert exact_dedup.deduplicate(nothing).count() == 0
    assert neardup.groups(nothing).count() == 0
    assert neardup.deduplicate(nothing).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    rng = np.random.default_rng(3)
    stream = np.concatenate([np.full(400, 5), np.full(300, 6), rng.integers(100, 10_000, 2000)])
    rng.shuffle(stream)
    s = exact_dedup.MisraGries(8)
    for part in np.array_split(stream, 20):
        s.add(part)
    low = dict(zip(s.keys, s.counts, strict=True))
    assert len(low) <= 8
    for key, n in ((5, 400), (6, 300)):
        assert n - len(stream) / 9 <= low.get(key, 0) <= n


def by_brute_force(sig, size, distance):
    """Links and least member by row of signatures."""
    near = [(sig[a] != sig).sum(1) <= distance for a in range(len(sig))]
    links = [int(size[x].sum() - 1) for x in near]
    root = list(range(len(sig)))
    for a in range(len(sig)):
        for b in np.flatnonzero(near[a]):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return links, root


def clusters(index, seed=None):
    rng = np.random.default_rng(index.k if seed is None else seed)
    base = rng.integers(0, 4, (25, index.k), dtype=np.uint16)
    sig = np.repeat(base, 6, axis=0)
    for row in sig:
        where = rng.permutation(index.k)[: rng.integers(0, index.distance + 3)]
        row[where] = rng.integers(0, 4, len(where))
    return np.unique(sig, axis=0), rng


@pytest.mark.parametrize("block", [1, 3, 2048])
@pytest.mark.parametrize("index", [neardup.Index(k=12, r=4, errors=1), neardup.Index(k=12, r=4, errors=2), neardup.Index(k=6, r=3, errors=0), neardup.Index()])
def test_every_link_within_the_distance(spark, index, block):
    sig, rng = clusters(index)
    size = rng.integers(1, 5, len(sig))
    classes = spark.createDataFrame([(i, int(n), bytearray(s.tobytes())) for i, (n, s) in enumerate(zip(size, sig, strict=True))], "id bigint, size bigint, sig binary")
    links, root = by_brute_force(sig, size, index.distance)
    got, label = np.zeros(len(sig), int), np.arange(len(sig))
    for r in neardup.class_links(classes, index, block).collect():
        got[r.id] += r.n
        if r.peer is not None:
            neardup.united(label, np.array([r.id]), np.array([r.peer]))
    assert (got + size - 1).tolist() == links
    assert label.tolist() == root


def test_a_hot_key_is_searched_in_blocks(spark):
    """20,000 signatures under one key: no task has more than two blocks of them, and what is emitted is a row for each at most."""
    index = neardup.Index(k=8, r=4, errors=1)
    rng = np.random.default_rng(0)
    sig = np.unique(np.concatenate([np.full((20_000, 3), 7), rng.integers(0, 60_000, (20_000, 5))], 1).astype(np.uint16), axis=0)
    rows = [(i, 1, bytearray(s.tobytes())) for i, s in enumerate(sig)]
    classes = spark.createDataFrame(rows, "id bigint, size bigint, sig binary").repartition(8)
    got = neardup.class_links(classes, index).groupBy("id").sum("n").collect()
    near = {r[0]: r[1] for r in got}
    for i in rng.permutation(len(sig))[:25].tolist():
        assert near.get(i, 0) == int(((sig[i] != sig).sum(1) <= index.distance).sum() - 1)


def test_pairs_are_made_some_at_a_time(monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS_AT_ONCE", 10)
    rng = np.random.default_rng(4)
    low = rng.integers(0, 30, 40)
    high = low + rng.integers(-3, 25, 40)
    parts = list(neardup.paired(low, high))
    assert [(int(a), int(b)) for i, j in parts for a, b in zip(i, j, strict=True)] == [(i, j) for i in range(40) for j in range(low[i], high[i])]
    assert len(parts) > 10


def test_signatures_estimate_jaccard():
    words = [f"w{i}" for i in range(400)]
    other = words[:340] + [f"x{i}" for i in range(60)]
    sig, some = neardup.signatures(pa.array([" ".join(words), " ".join(other), "", None, "..."]), neardup.Index(k=250, r=5))
    assert some.tolist() == [True, True, False, False, False]
    assert abs((sig[0] == sig[1]).mean() - 339 / 459) < 0.1


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    docs = []
    for group in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.choice([1, 2, 5])):
            docs.append((group, " ".join(rng.choice(vocabulary) if rng.random() < 0.04 else w for w in base)))
    return [(i, g, t) for i, (g, t) in enumerate(docs)]


def test_near_copies_are_found_and_others_are_not(spark):
    docs = near_copies(1)
    df = frame(spark, [(i, t, "en", "a") for i, _, t in docs])
    group = {i: g for i, g, _ in docs}
    first = {g: min(i for i in group if group[i] == g) for g in group.values()}
    rows = neardup.groups(df).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: first[g] for i, g in group.items()}
    assert sum(r.n_links for r in rows) >= 0.97 * sum(list(group.values()).count(g) - 1 for g in group.values())
    assert sorted(r.doc_id for r in neardup.deduplicate(df).collect()) == sorted(first.values())


def shuffled_copies():
    texts, rng = [t for *_, t in near_copies(4)], random.Random(5)
    texts += [t for t in texts[:20] for _ in range(rng.randint(1, 4))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1, 2048])
@pytest.mark.parametrize("heavy", [0, 3, 1024])
def test_groups_against_brute_force(spark, monkeypatch, block, heavy):
    monkeypatch.setattr(neardup, "HEAVY", heavy)
    texts, index = shuffled_copies(), neardup.Index()
    df = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    sig, _ = neardup.signatures(pa.array(texts), index)
    links, root = by_brute_force(sig, np.ones(len(sig), int), index.distance)
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.groups(df, block=block).collect()}
    assert got == {i: (root[i], links[i]) for i in range(len(texts))}


def test_ids_of_any_type(spark):
    texts = shuffled_copies()
    rows = [(f"doc-{i:04d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "name string, text string")
    numbers = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in neardup.groups(df, "name").collect()} == {(f"doc-{r.doc_id:04d}", f"doc-{r.class_id:04d}", r.n_links) for r in numbers}
    assert {r.name for r in neardup.deduplicate(df, "name").collect()} == {f"doc-{r.class_id:04d}" for r in numbers}


def test_hard_rows(hard):
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.groups(hard).collect()}
    assert got == {**{i: (i, 0) for i in (3, 4, 5, 6, 7, 9)}, 1: (1, 2), 2: (1, 2), 8: (1, 2)}
    out = neardup.deduplicate(hard)
    assert out.columns == hard.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 9)] + [(True, 0)] * 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(500, 400), (300, 400)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "doc_id bigint, near_id bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 130)}, 400: 300, 500: 300}


def test_query_has_a_row_for_each_document(spark, tmp_path):
    from granary.llm import queries

    frame(spark, [(i, "the same words in each of them", "en", "a") for i in range(5)] + [(9, "other", "en", "a")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op4_minhash_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, 0, 4) for i in range(5)} | {(9, 9, 0)}
