from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import toxicity
from tests.llm.conftest import HARD, frame


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("You are an idiot and a moron.", True),
        ("I will kill you.", True),
        ("The weather is fine. Nothing to see here.", False),
        ("He is not an idiot.", False),
        ("She said they called him an idiot once, in a report of many words about what was heard in the hall.", False),
        ("You should kill the process.", False),
        ("IDIOT!!! you pathetic LOSER!!!", True),
        ("the&&& stupid$$$ ntatth$$$ worthless***", True),
        ("", False),
        (None, False),
    ],
)
def test_cases(text, toxic):
    total, most, _, words = toxicity.scores(pa.array([text], pa.string()))
    assert bool(toxicity.is_toxic(total, most, words, toxicity.Limits())[0]) is toxic


def test_marks_lower_and_targets_raise():
    s = toxicity.clause_score
    assert s("I") > s("RI") > s("NI") > s("RNI") > 0 == s("H") == s("hT") == s("MhTD") == s("TV") == s("X") == s("MV")
    assert s("MhT") == s("MhTo") == s("MTV") == s("MoX") == s("MHTD") > s("NMhT") > 0
    assert s("TI") == s("Ioo" + "T") > s("GI"[1:] + "G") > s("I")
    assert s("MHT") > s("HT") > s("NHT") > 0
    assert s("T" + "o" * toxicity.MEMORY + "I") == s("I")


def test_composition_equals_running_each_in_turn():
    parts = [toxicity.Negation(), toxicity.Reported(), toxicity.Threat(), toxicity.Target(), toxicity.Scoring()]
    import itertools

    for symbols in itertools.product("IiHhVXMTGNRDlo", repeat=4):
        text, total = [*symbols, toxicity.END], 0.0
        for t in parts:
            state, out = t.start, []
            for x in text:
                state, y, w = t.step(state, x)
                out.append(y)
                total += w
            text = out
        assert toxicity.clause_score("".join(symbols)) == pytest.approx(total)


def brute(text):
    """Clause by clause, word by word, without skipping."""
    import re

    kinds = {w: k for k, ws in toxicity.LEXICON.items() for w in ws.split()}
    total = 0.0
    for clause in re.split(r"[.!?;\n\r]", text or ""):
        symbols = "".join(kinds.get(w, "o") for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", clause.lower()))
        if any(c in toxicity.CORE for c in symbols):
            total += toxicity.clause_score(symbols)
    return total


def test_against_brute_force(spark):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert got[i].toxic_score == pytest.approx(brute(t), abs=1e-5)


def test_labels_in_every_language(spark):
    """Small labels: stems learned on nine tenths of the labelled documents, each tenth judged by those of the others."""
    from tests.conftest import SF

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = []
    for fold in range(10):
        held = labels.filter(f"pmod(xxhash64(doc_id), 10) = {fold}")
        stems = toxicity.learn(docs, labels.join(held, "doc_id", "left_anti"))
        mine = docs.join(held, "doc_id").select("doc_id", "text", "lang", F.col("toxic").alias("label")).collect()
        total, most, _, words = toxicity.scores(pa.array([r.text for r in mine]), stems)
        rows += zip([r.lang for r in mine], [r.label for r in mine], toxicity.is_toxic(total, most, words, toxicity.Limits()), strict=True)
    assert not any(f and not y for _, y, f in rows)
    for lang in ("en", "de", "fr", "es"):
        # One of five French documents and three of 36 English ones are junk without a single insult.
        assert sum(f for n, y, f in rows if y and n == lang) >= 0.8 * sum(y for n, y, _ in rows if n == lang), lang


def test_hard_rows(hard, nothing):
    assert toxicity.score(hard).count() == len(HARD)
    assert toxicity.score(nothing).count() == 0
    out = toxicity.reject(hard)
    assert out.columns == hard.columns and out.count() == len(HARD)
    assert toxicity.reject(nothing).count() == 0


def test_reject_drops_only_what_is_toxic(spark):
    docs = frame(spark, [(1, "You are a worthless moron.", "en", "a"), (2, "A calm sentence.", "en", "a"), (None, "you scum", "en", "a")])
    assert [r.doc_id for r in toxicity.reject(docs).collect()] == [2]


def brute_stems(rows, learning):
    """rows: (doc_id, text, toxic)."""
    import re
    from collections import Counter, defaultdict

    single, df, tf, words = {}, defaultdict(set), {0: Counter(), 1: Counter()}, Counter()
    for doc, text, toxic in sorted(rows):
        ws = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        if ws:
            single.setdefault((tuple(sorted({toxicity.kernel.hash_text(w) for w in ws})[:4]), toxic), ws)
    for (least, toxic), ws in single.items():
        words[toxic] += len(ws)
        for w in ws:
            for size in learning.lengths:
                if len(w.encode()) >= size:
                    key = w.encode()[:size]
                    tf[toxic][key] += 1
                    if toxic:
                        df[key].add(least)
    docs = sum(toxic for _, toxic in single)
    enough = lambda k: max(learning.support, learning.share * docs) <= len(df[k]) <= tf[1][k] / learning.again
    return {k for k in df if enough(k) and tf[1][k] / words[1] >= learning.lift * (tf[0][k] + 1) / words[0]}


def test_learning_against_brute_force(spark):
    import numpy as np
    from tests.conftest import SF

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learning = toxicity.Learning(support=4, share=0.05, again=1.5, lift=5.0)
    want = brute_stems([tuple(r) for r in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()], learning)
    got = toxicity.learn(docs, labels, learning=learning)

    def hashed(b):
        x = np.frombuffer(b, np.uint8)
        return int(toxicity.kernel.span_hashes(x, np.array([0]), np.array([len(b)]))[0]) & ~15 | len(b)

    assert want and {int(k) for v in got.values() for k in v} == {hashed(b) for b in want}


def test_held_out_accuracy_in_every_language(spark):
    """Stems learned on one half of the labelled documents, all languages judged on the other."""
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.selectExpr("*", "xxhash64(doc_id) % 2 = 0 as held")
    stems = toxicity.learn(docs, half.filter("not held"))
    rows = toxicity.score(docs, stems=stems).withColumnRenamed("toxic", "found").join(half.filter("held"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "found").collect()
    for lang in ("en", "de", "fr", "es"):
        mine = [(r.toxic, r.found) for r in rows if r.lang == lang]
        hits = sum(t and f for t, f in mine)
        assert hits >= 0.85 * sum(t for t, _ in mine) and hits >= 0.9 * sum(f for _, f in mine), lang


def test_learning_hard_rows(spark, hard, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (7, 1), (8, 0), (77, 1)], "doc_id bigint, toxic int")
    assert toxicity.learn(hard, labels) == {}
    assert toxicity.learn(nothing, labels) == {} == toxicity.learn(hard, labels.filter("false"))
    assert toxicity.learn(hard, labels, learning=toxicity.Learning(support=1, share=0, again=1, lift=1e-6))


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("She put the trash out.", False),
        ("The clown at the party made the children laugh.", False),
        ("The pigs ate the garbage.", False),
        ("The clowns threw garbage at the screen. The pigs ate it.", False),
        ("The filth was washed off.", False),
        ("The parasite was found. " + "Nothing else was seen in the field that day. " * 40 + "The farm had pigs.", False),
        ("Idiot was heard. Somewhere the word moron.", True),
        ("You are a clown.", True),
        ("What a stupid loser!", True),
        ("A moron and a liar.", True),
    ],
)
def test_isolated_words_decide_nothing(text, toxic):
    total, most, _, words = toxicity.scores(pa.array([text]))
    assert bool(toxicity.is_toxic(total, most, words, toxicity.Limits())[0]) is toxic


def test_reject_keeps_isolated_words(spark):
    docs = frame(spark, [(1, "She put the trash out.", "en", "a"), (2, "The pigs ate the garbage.", "en", "a"), (3, "You are trash.", "en", "a")])
    assert sorted(r.doc_id for r in toxicity.reject(docs).collect()) == [1, 2]
    assert {r.doc_id: r.toxic for r in toxicity.score(docs).collect()} == {1: False, 2: False, 3: True}


@pytest.mark.parametrize("apostrophe", ["'", "\u2019", "\u02bc"])
def test_contracted_negations(apostrophe):
    plain = ["He is not an idiot.", "You are not an idiot.", "THEY are NOT worthless morons.", "Do not hurt them.", "You are an idiot.", "I can not kill you, you did not ask."]
    short = ["He isn't an idiot.", "You aren't an idiot.", "THEY AREN'T worthless morons.", "Don't hurt them.", "You're an idiot.", "I can't kill you, you didn't ask."]
    want, got = (toxicity.measures(pa.array(x)) for x in (plain, [s.replace("'", apostrophe) for s in short]))
    assert got[0][0].tolist() == pytest.approx(want[0][0].tolist())
    judged = toxicity.is_toxic(got[1][0], got[1][1], got[1][3], toxicity.Limits())
    assert judged.tolist() == [False] * 4 + [True, False]


def test_a_lone_t_is_no_negation():
    total, *_ = toxicity.scores(pa.array(["Isn t you idiot.", "At t you idiot.", "can", "t' you idiot."]))
    assert total.tolist() == pytest.approx([1.8, 1.8, 0, 1.8])


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("The dog ate the trash.", False),
        ("He picked up the garbage bags.", False),
        ("My pig farm is doing well this year.", False),
        ("The parasite lives in the gut of the host.", False),
        ("The loser of the match shook hands.", False),
        ("You should shoot them a message tomorrow.", False),
        ("I will beat you at chess.", False),
        ("He beat them in the final.", False),
        ("They want to kill time with you.", False),
        ("The fool and the clown are characters in the play.", False),
        ("Stupid me, I forgot the ugly sweater.", False),
        ("You are not stupid, you are tired.", False),
        ("These people should be shot.", False),
        ("Du bist ein Idiot.", True),
        ("Tu es un connard.", True),
        ("Eres un imbécil.", True),
        ("Ich werde dich töten.", True),
        ("Je vais te tuer.", True),
        ("Voy a matarte.", True),
        ("Don't hit them, you could burn the toast for them.", False),
        ("You beat me to it.", False),
        ("Will you shoot the photos, or should they?", False),
        ("We will destroy you.", True),
        ("You people are vermin.", True),
        ("Immigrants are scum.", True),
        ("I will beat you.", True),
        ("I will beat you senseless", True),
        ("Du bist kein Idiot.", False),
        ("Tu n'es pas un imbécile.", False),
        ("Ich werde dich nicht töten.", False),
        ("No voy a matarte.", False),
        ("I will kill them.", True),
        ("She said he will kill them", False),
        ("You should kill the process.", False),
        ("Will you kill the lights?", False),
        ("I will not hurt you.", False),
        ("La máquina va a matar el proceso.", False),
        ("Er will den Prozess töten.", False),
    ],
)
def test_clauses_in_four_languages(text, toxic):
    total, most, _, words = toxicity.scores(pa.array([text]))
    assert bool(toxicity.is_toxic(total, most, words, toxicity.Limits())[0]) is toxic
