"""Every query over the driver tables against its SQL, and those without SQL against a plain version."""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from granary import plans
from granary.operators import chunking, context, embedding, governance, graph
from granary.sources.files import html_text
from tests import oracle
from tests.conftest import SF

QUERIES, SQL = plans.queries(), plans.oracle_sql()
PLAIN = {"html_parse", "semantic_chunks", "semantic_chunks_bpe", "answer_queries"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    assert oracle.differences(QUERIES[name](spark, SF), SQL[name], duck) == ""


def test_every_query_without_sql_has_a_test():
    assert set(QUERIES) - set(SQL) == PLAIN


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def got(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_html_parse(spark, duck):
    class Visible(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "head", "template")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "head", "template")

        def handle_data(self, data):
            if self.off <= 0:
                self.words.append(data)

    rows = {r["page_id"]: r["text"] for r in got(spark, "html_parse")}
    pages = duck.sql("SELECT page_id, html FROM pages").fetchall()
    assert len(rows) == len(pages)
    for page, html in pages:
        p = Visible()
        p.feed(html)
        assert "".join(rows[page].split()) == "".join("".join(p.words).split())
    assert html_text("<p>a&amp;b</p><script>x</script><p>c  d</p>") == "a&b\n\nc d"


def test_embed_documents(spark, texts):
    encode = embedding.hashing_encoder()
    by = defaultdict(lambda: np.zeros(384))
    for r in got(spark, "embed_documents"):
        by[int(r["doc_id"])][r["place"]] = r["x"]
    for doc, text in texts.items():
        v = encode([" ".join(text.split())[:2048]])[0]
        assert np.allclose(by[doc], v / (np.linalg.norm(v) + 1e-10), atol=1e-6)


def test_chunks_by_byte_pairs(spark, texts):
    count = chunking.BytePairs("/opt/tokenizers/byte_bpe_50k.tiktoken")
    rows = got(spark, "semantic_chunks_bpe")
    by = defaultdict(list)
    for r in rows:
        by[int(r["doc_id"])].append((r["chunk_index"], r["text"], r["token_count"]))
    for doc, text in texts.items():
        want = chunking.pack(chunking.paragraphs(text), 500, 50, count)
        assert sorted(by[doc]) == [(c["chunk_index"], c["text"], c["token_count"]) for c in want]
        assert all(n == count(t) for _, t, n in by[doc])


def test_semantic_chunks(spark, texts):
    by = defaultdict(list)
    for r in got(spark, "semantic_chunks"):
        by[int(r["doc_id"])].append(r)
    for doc, text in texts.items():
        parts = sorted(by[doc], key=lambda r: r["chunk_index"])
        assert [r["chunk_id"] for r in parts] == [f"{doc}#chunk_{i}" for i in range(len(parts))]
        assert all(r["token_count"] == len(r["text"].split()) for r in parts)
        # Nothing is lost: without overlapping paragraphs, the chunks are the document's paragraphs.
        blocks = chunking.paragraphs(text)
        if len(blocks) == 1:
            assert " ".join(r["text"] for r in parts).split() == blocks[0][0].split()


def test_sentence_chunks(spark, duck, texts):
    sentences = {r["doc_id"]: [s for s in r["sentences"].split("|")] for r in got(spark, "sentence_split")}
    by = defaultdict(list)
    for r in got(spark, "sentence_chunks"):
        by[int(r["doc_id"])].append((r["chunk_index"], r["text"]))
    for doc in texts:
        if "|" in texts[doc]:
            continue
        have = [c for _, c in sorted(by[doc])]
        want, held = [], []
        for s in [s for s in sentences[doc] if s]:
            if held and sum(len(x.split()) for x in held) + len(s.split()) > 200:
                want.append(" ".join(held))
                held = held[-1:]
            held.append(s)
        assert have == (want + [" ".join(held)] if held else want)


def test_chunk_quality_report(spark):
    (r,) = got(spark, "chunk_quality_report")
    (size,), (lap,) = got(spark, "chunk_size_quality"), got(spark, "chunk_overlap")
    assert r["total_chunks"] == size["total_chunks"] and r["overlap_quality"] == pytest.approx(lap["overlap_quality"])
    assert 0 <= r["avg_coherence"] <= 1 and r["recommendations"]


def test_extract_names(spark, texts):
    java = re.compile(r"(?<!\w)([A-Z][a-z]+(?:[ \t\n\x0b\f\r]+[A-Z][a-z]+)*)(?!\w)")
    for r in got(spark, "extract_names"):
        want = {n for n in java.findall(texts[r["doc_id"]]) if n.lower() not in ("the", "this", "that", "these", "those")}
        assert r["names"] == "|".join(sorted(want))


def test_pii_spans(spark, texts):
    want = {(str(d), k, m.group(), *m.span()) for d, t in texts.items() for k, p in governance.PII.items() for m in re.finditer(p, t, re.I)}
    assert {tuple(r) for r in got(spark, "pii_spans")} == want and want


def test_entities(spark):
    from granary.plans.documents import letters

    texts = {r.doc_id: r.text for r in letters(spark, SF).collect()}
    found = {(d, m.lower(), k) for d, t in texts.items() for k, ps in graph.ENTITIES.items() for m in re.findall(rf"(?i)\b({'|'.join(ps)})\b", t)}
    assert {tuple(r) for r in got(spark, "entity_extract")} == found and len(found) > 5000
    rows = got(spark, "entity_spans")
    assert {(r["doc_id"], r["entity"], r["type"]) for r in rows} == found
    for r in rows:
        text = texts[r["doc_id"]]
        assert text[r["start"] : r["end"]].lower() == r["entity"] and text[max(0, r["start"] - 50) : r["end"] + 50] == r["context"]


def test_rerank_and_dedupe(spark, texts):
    ranked = defaultdict(list)
    for r in got(spark, "rerank_batch"):
        ranked[r["query_id"]].append((r["rank"], r["id"]))
    want = set()
    for q, rows in ranked.items():
        kept = []
        for rank, doc in sorted(rows):
            ws = set(texts[doc].lower().split())
            if all(len(ws & k) / max(len(ws | k), 1) <= 0.85 for k in kept):
                kept.append(ws)
                want.add((q, doc, rank))
    assert {(r["query_id"], r["id"], r["rank"]) for r in got(spark, "rerank_and_dedupe")} == want


def test_context_assemble(spark, texts):
    rows = got(spark, "context_assemble")
    assert len(rows) == 40
    for r in rows:
        ids = r["sources"].split(",")
        assert r["token_count"] <= 1500 + 40 and len(ids) == r["chunks_included"]
        assert all(f"doc={i} chunk={i}" in r["context"] for i in ids)
        if not r["chunks_truncated"]:
            assert all(texts[int(i)] in r["context"] for i in ids)


def test_answer_queries(spark, duck, texts):
    rows = got(spark, "answer_queries")
    assert {r["query_id"] for r in rows} == {q for (q,) in duck.sql("SELECT item_id FROM benchmark").fetchall()}
    for r in rows:
        first = texts[int(r["sources"][0]["doc_id"])]
        assert r["answer"] == re.split(r"(?<=[.!?])\s+", first)[0] and 1 <= len(r["sources"]) <= 5
        assert (r["status"], r["confidence"]) in {("valid", "high"), ("invalid", "low")}
        assert [s["score"] for s in r["sources"]] == sorted((s["score"] for s in r["sources"]), reverse=True)


def test_breakers(spark, duck):
    calls = duck.sql("SELECT event_type, ts, value < 80 FROM events ORDER BY event_type, ts").fetchall()
    want, state = [], {}
    for service, ts, ok in calls:
        s = state.setdefault(service, {"open": None, "fails": 0, "trials": None})
        if s["open"] is not None:
            if (ts - s["open"]).total_seconds() < 30:
                want.append((service, ok, False, "open"))
                continue
            s.update(open=None, trials=0)
        if ok:
            s["fails"] = 0
            if s["trials"] is not None:
                s["trials"] += 1
                if s["trials"] >= 2:
                    s["trials"] = None
        else:
            s["fails"] += 1
            if s["trials"] is not None or s["fails"] >= 3:
                s.update(open=ts, trials=None)
        want.append((service, ok, True, "open" if s["open"] is not None else "half_open" if s["trials"] is not None else "closed"))
    for name in ("breaker_replay", "stream_breakers"):
        have = sorted(got(spark, name), key=lambda r: (r["service"], r["ts"]))
        assert [(r["service"], r["ok"], r["allowed"], r["state"]) for r in have] == want
    assert {w[3] for w in want} == {"open", "half_open", "closed"}


def test_fill():
    chunks = [{"id": str(i), "doc_id": "d", "title": None, "text": "w " * 400, "score": 1.0} for i in range(3)]
    stop = context.fill(chunks, 407 + 1 + 200)
    cut = context.fill(chunks, 407 + 1 + 201)
    assert (stop["chunks_included"], stop["chunks_truncated"]) == (1, 0)
    assert cut["chunks_truncated"] == 1 and cut["chunks_included"] >= 2
