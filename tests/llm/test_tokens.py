from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import chat, lm, tokencount, unigram
from tests.conftest import SF
from tests.llm.conftest import HARD

SPEC = open(chat.TOKENIZER, encoding="utf-8").read()
MODEL = open(unigram.MODEL, "rb").read()
RANKS = tokencount.read_ranks(tokencount.VOCABULARY)


# --- token counts


def engine():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_counts_are_those_of_the_encoder(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    e = engine()
    got = {r.doc_id: r for r in tokencount.count(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id].n_tokens == len(e.encode_ordinary(r.text))


def test_proven_strings_encode_as_themselves():
    e, whole = engine(), tokencount.proven(RANKS)
    assert len(whole) > 40_000
    assert all(e.encode_ordinary(w) == [RANKS[w.encode()]] for w in whole)


def test_unproven_strings_are_left_to_merging():
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 257, b"abcd": 258, b"xy z": 259}
    assert tokencount.merge(b"abcd", ranks) == [b"a", b"bc", b"d"]
    assert not {"abcd", "xy z"} & set(tokencount.proven(ranks))
    assert "ab" in tokencount.proven(ranks)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_merging_equals_the_encoder(text):
    e = engine()
    assert [RANKS[t] for p in __import__("regex").findall(tokencount.PATTERN, text) for t in tokencount.merge(p.encode(), RANKS)] == e.encode_ordinary(text)


def test_count_hard_rows(hard, nothing):
    got = tokencount.count(hard).collect()
    assert len(got) == len(HARD)
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (3, 4, 5, 6))
    assert tokencount.count(nothing).count() == 0


# --- chat


def test_round_trip_and_mask(spark):
    rng = random.Random(1)
    nasty = ["<|end|>", "<|\\assistant|>", "plain", "", None, "a <|user|> b <|\\\\x|>", "日本 é", "<|endoftext|>"]
    rows, want = [], {}
    for conv in range(40):
        turns = [(t, rng.choice(["system", "user", "assistant", "tool", "critic", None]), rng.choice(nasty)) for t in range(rng.randint(1, 6))]
        want[conv] = [(r if r in chat.ROLES else "other", c or "") for _, r, c in turns]
        rows += [(conv, t, r, c) for t, r, c in turns]
    rng.shuffle(rows)
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    t = chat.tokenizer(SPEC)
    own = chat.reserved(t.get_vocab_size(with_added_tokens=True))
    for r in got.collect():
        assert chat.parse(r.input_ids, SPEC) == want[r.conv_id]
        ids, mask = [own[chat.START]], [0]
        for role, content in want[r.conv_id]:
            c = t.encode(chat.escape(content), add_special_tokens=False).ids
            assert not set(c) & set(own.values())
            ids += [own[role], *c, own[chat.END]]
            mask += [0] + [int(role == "assistant")] * (len(c) + 1)
        assert r.input_ids == ids and r.loss_mask == mask


@given(st.text(alphabet="<|\\>ab_ ", max_size=40))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


def test_chat_hard_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, input_ids string, turns int"
    rows = [(1, 0, "user", "x", "c", 1), (1, 0, "user", "x", "c", 1), (None, 0, "user", "y", "c", 1), (2, None, None, None, "c", 1), (2, 1, "assistant", "z " * 50_000, "c", 1)]
    got = {r.conv_id: chat.parse(r.input_ids, SPEC) for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: [("user", "x")] * 2, 2: [("other", ""), ("assistant", "z " * 50_000)]}
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


# --- unigram


def brute_force(text: str, model: unigram.Unigram, pieces) -> list[int]:
    """Plain Viterbi over characters and a dictionary."""
    table = {p.replace("▁", " "): (s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4)}
    width = max(map(len, table))
    text = text.replace("▁", " ")
    text = " " + text if text else ""
    best = [(0.0, 0, None)] + [(-np.inf, 0, None)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - width), end):
            if (hit := table.get(text[start:end])) or end - start == 1:
                s, i = hit or (model.unknown_score, -1)
                if best[start][0] + s > best[end][0]:
                    best[end] = (best[start][0] + s, start, i)
    out, at = [], len(text)
    while at:
        _, start, i = best[at]
        out[:0] = [i] if i >= 0 else [int(model.bytes[b]) for b in text[start:at].encode()]
        at = start
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ethnis\n▁é日🙂.,", max_size=30), max_size=6))
def test_viterbi_against_brute_force(texts):
    m = unigram.loaded(MODEL)
    pieces, _ = unigram.read_pieces(MODEL)
    ids = m.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [brute_force(t, m, pieces) for t in texts]
    assert m.decode(ids).to_pylist() == [t.replace("▁", " ") for t in texts]


def test_corpus_against_brute_force_and_round_trip(spark):
    m = unigram.loaded(MODEL)
    pieces, _ = unigram.read_pieces(MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = unigram.encode(docs)
    assert got.filter("not lossless").count() == 0
    texts = {r.doc_id: r.text for r in docs.filter("n_chars < 700").collect()}
    for r in got.collect():
        if r.doc_id in texts:
            assert r.pieces == brute_force(texts[r.doc_id], m, pieces)
    back = {r.doc_id: r.text for r in unigram.decode(got).collect()}
    assert all(back[i] == t for i, t in texts.items())


def test_merge_order_becomes_log_scores():
    pieces, _ = unigram.read_pieces(MODEL)
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=unigram.MODEL)
    normal = sorted((i for i, p in enumerate(pieces) if p[2] == unigram.NORMAL), key=lambda i: -own.get_score(i))
    score = np.array([pieces[i][1] for i in normal])
    assert np.exp(score).sum() == pytest.approx(1, abs=1e-5)
    assert np.exp(score[0] - score) == pytest.approx(np.arange(1, len(score) + 1), rel=1e-5)
    assert unigram.zipf([("a", 5.0, 3), ("b", -1.0, 1), ("c", 0.0, 1)]) == [("a", 5.0, 3), ("b", pytest.approx(np.log(1 / 3)), 1), ("c", pytest.approx(np.log(2 / 3)), 1)]


def test_memory_is_bounded(monkeypatch):
    """Forgetting changes nothing."""
    rng = random.Random(6)
    texts = pa.array([" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 9, 400]))) for _ in range(60)) for _ in range(40)])
    want = unigram.Unigram(MODEL).encode(texts).to_pylist()
    monkeypatch.setattr(unigram, "SOLVED", 3000)
    m = unigram.Unigram(MODEL)
    assert [m.encode(texts.slice(i, 1)).to_pylist()[0] for i in range(40)] == want and len(m.solved) <= 3000 + 60 * 400
    monkeypatch.setattr(tokencount, "MEMORY", 5)
    c = tokencount.Counts(tokencount.proven(RANKS)[:1000], RANKS, tokencount.PATTERN)
    e = engine()
    for t in texts.to_pylist():
        assert c.count(t)[0] == len(e.encode_ordinary(t))
    assert len(c) <= 2 * c.limit and all(len(k) < tokencount.LONG for k in c)


def test_decoding_sql(spark, duck):
    from granary.llm import queries
    from tests import oracle

    assert oracle.differences(queries.queries()["sentencepiece_decoding"](spark, SF), queries.oracle_sql()["sentencepiece_decoding"], duck) == ""


def test_a_trie_holds_its_keys_only():
    keys = [(w.encode(), i) for i, w in enumerate(["a", "ab", "abc", "b", "bcd", "é", "日本", "z" * 40])]
    t = unigram.DoubleArray(keys)

    def find(word):
        node = 0
        for c in word:
            nxt = int(t.base[node]) + c
            if t.check[nxt] != node:
                return -1
            node = nxt
        return int(t.value[node])

    assert all(find(k) == i for k, i in keys)
    assert find(b"bc") == find(b"q") == find("日".encode()) == find(b"abcd") == -1


def test_unigram_hard_rows(hard, nothing):
    got = unigram.encode(hard).collect()
    assert len(got) == len(HARD) and all(r.lossless for r in got)
    assert all(r.pieces == [] for r in got if r.doc_id in (3, 4, 5, 6))
    assert unigram.encode(nothing).count() == 0
    lists = hard.sparkSession.createDataFrame([(1, None), (2, []), (3, [413, 581])], "doc_id int, pieces array<int>")
    assert [r.text for r in unigram.decode(lists).orderBy("doc_id").collect()][:2] == [None, ""]


# --- window network


def test_gradient_against_differences():
    shape = lm.Shape(classes=3, per_class=4, shared=3, embed=2, window=1, hidden=5, batch=8)
    rng = np.random.default_rng(0)
    size = sum(int(np.prod(d)) for d in shape.layout().values())
    flat = rng.normal(0, 0.5, size).astype(np.float32)
    target = rng.integers(0, shape.size, 30).astype(np.int32)
    context = rng.integers(0, shape.size, (30, 2)).astype(np.int32)
    order = np.argsort(target // shape.per_class, kind="stable")
    target, context = target[order], context[order]

    def loss(x):
        return -float(lm.Network(shape, x).forward(context, target).astype(float).mean())

    net = lm.Network(shape, flat.copy())
    net.train(context, target)
    gradient = net.m / np.float32(0.1)
    for i in rng.permutation(size)[:40]:
        step = np.zeros(size, np.float32)
        step[i] = 1e-2
        assert gradient[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-2, abs=2e-3)


def test_probabilities_add_up_to_one():
    shape = lm.Shape(classes=3, per_class=4, shared=3, embed=2, window=2, hidden=5)
    rng = np.random.default_rng(1)
    flat = rng.normal(0, 1, sum(int(np.prod(d)) for d in shape.layout().values())).astype(np.float32)
    context = np.tile(rng.integers(0, shape.size, (1, 4)), (shape.size, 1)).astype(np.int32)
    logp = lm.Network(shape, flat).forward(context, np.arange(shape.size, dtype=np.int32))
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-4)


def test_windows_stay_within_documents():
    ids, rows = np.array([1, 2, 3, 4, 5]), np.array([0, 0, 0, 1, 1])
    assert lm.windows(ids, rows, 2).tolist() == [[0, 0, 2, 3], [0, 1, 3, 0], [1, 2, 0, 0], [0, 0, 5, 0], [0, 4, 0, 0]]


def test_word_order_is_learnt(spark):
    """Held out: a text in the corpus's order scores better than its words shuffled, and better than by frequency alone."""
    rng = random.Random(3)
    follows = {f"w{i}": [f"w{(i * 7 + j) % 50}" for j in range(2)] for i in range(50)}

    def walk(n):
        w, out = "w0", []
        for _ in range(n):
            w = rng.choice(follows[w])
            out.append(w)
        return out

    docs = spark.createDataFrame([(i, " ".join(walk(300))) for i in range(400)], "doc_id bigint, text string")
    shape, counts, flat = lm.fit(docs, shape=lm.Shape(batch=512, shard_tokens=10_000))
    held = walk(2000)
    mixed = held[:]
    rng.shuffle(mixed)
    total, n = lm.score_texts(pa.array([" ".join(held), " ".join(mixed)]), shape, counts, flat)
    assert n.tolist() == [2000, 2000]
    assert total[0] / 2000 > -2.5 > -np.log(50) > total[1] / 2000


def test_lm_hard_rows(hard, nothing):
    got = lm.score(hard).collect()
    assert len(got) == len(HARD)
    for r in got:
        empty = r.doc_id in (3, 4, 5, 6, 9)
        assert (r.n_tokens == 0) == (r.mean_log_likelihood is None)
        assert not empty or (r.n_tokens == 0 and r.log_likelihood == 0)
        assert r.log_likelihood <= 0
    assert lm.score(nothing).count() == 0


def corpus(seed=8):
    rng = random.Random(seed)
    known = [f"known{i}" for i in range(40)]
    texts = [" ".join(rng.choice(known[:6] * 20 + known) for _ in range(120)) for _ in range(60)]
    return [*texts, " ".join(known[20:40] * 6), " ".join(f"x{rng.random():.9f}".replace(".", "") for _ in range(120)), "", None, texts[0], texts[1]]


SMALL = lm.Shape(classes=3, per_class=4, shared=3, embed=2, window=1, hidden=5, batch=64, rounds=2, shard_tokens=1500)


def plain_scores(texts, counted, shape, counts, flat):
    """Document scores word by word from the parameters: plain loops, no slices, sorting or Spark."""
    views = lm.Network(shape, flat).p
    own = {int(w): i + 1 for i, w in enumerate(counts.words)}
    ids_of = {}
    for w in counted:
        h = lm.kernel.hash_text(w)
        ids_of[w] = own.get(h, shape.own + 1 + (h >> 8) % shape.shared)
    sums = {}
    for w, n in counted.items():
        sums[ids_of[w]] = sums.get(ids_of[w], 0) + n
    out = []
    for text in texts:
        words = (text or "").split()
        ids, score = [ids_of[w] for w in words], 0.0
        for at, w in enumerate(words):
            around = [ids[at + j] if 0 <= at + j < len(ids) else 0 for j in [*range(-shape.window, 0), *range(1, shape.window + 1)]]
            x = np.concatenate([views["E"][i] for i in around]).astype(float)
            h = np.tanh(x @ views["W"] + views["b"])
            k, within = divmod(ids[at], shape.per_class)
            a, q = h @ views["C"] + views["cb"], h @ views["K"][k] + views["kb"][k]
            score += a[k] - np.log(np.exp(a).sum()) + q[within] - np.log(np.exp(q).sum())
            if ids[at] > shape.own:
                score += np.log(counted[w] / sums[ids[at]])
        out.append((score, len(words)))
    return out


@pytest.mark.parametrize("known", [0, 30, 1000])
def test_scores_against_brute_force(spark, known):
    """Whatever number of words is known to the tasks; repeated rows, null ids and ties too."""
    from collections import Counter
    from dataclasses import replace

    texts = corpus()
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (1, texts[1])], "doc_id bigint, text string").repartition(3)
    shape = replace(SMALL, known=known)
    rows = lm.score(docs, shape=shape).collect()
    assert Counter(r.doc_id for r in rows) == Counter([*range(len(texts)), None, 1])
    counted = Counter(w for t in [*texts, texts[0], texts[1]] for w in (t or "").split())
    want = plain_scores(texts, counted, *lm.fit(docs, shape=shape))
    for r in rows:
        score, n = want[0 if r.doc_id is None else r.doc_id]
        assert r.n_tokens == n
        assert r.log_likelihood == pytest.approx(score, rel=1e-4, abs=1e-6)
    mean = {r.doc_id: r.mean_log_likelihood for r in rows}
    assert mean[60] > mean[61] + 2 and mean[64] == mean[0]


def test_scores_do_not_depend_on_the_partitioning(spark):
    texts = corpus(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    one, many = ({r.doc_id: r.log_likelihood for r in lm.score(d, shape=SMALL).collect()} for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(16)))
    assert one.keys() == many.keys()
    assert all(one[i] == pytest.approx(many[i], rel=1e-6) for i in one)


def test_all_documents_are_trained_on_once(spark, monkeypatch):
    seen = []
    texts = corpus(10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    real = lm.summed
    monkeypatch.setattr(lm, "summed", lambda rows, n: seen.append((n, real(rows, n).first().seen)) or real(rows, n))
    lm.fit(docs, shape=SMALL)
    assert sum(n for _, n in seen) == sum(len((t or "").split()) for t in texts)
    assert len(seen) == 2 and all(n > 1 for n, _ in seen)


def test_sums_of_many_shards(spark):
    rng = np.random.default_rng(2)
    parts = rng.normal(0, 1, (300, 7))
    rows = spark.createDataFrame([(i, i + 1, bytearray((p * (i + 1)).tobytes())) for i, p in enumerate(parts)], lm.ROW).repartition(5)
    (got,) = lm.summed(rows, 300).collect()
    assert got.seen == 300 * 301 // 2
    assert np.allclose(np.frombuffer(got.flat) / got.seen, np.average(parts, 0, np.arange(1, 301)))


def test_the_vocabulary_follows_the_corpus():
    sizes = [lm.fitting(10**e).size for e in range(0, 16)]
    assert sizes == sorted(sizes) and sizes[0] == 1024 and sizes[8] > 1500 and sizes[-1] == 16_384
