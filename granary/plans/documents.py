"""Queries over documents: ingestion, text rules, chunks, facts, personal data and entities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.functions import text as t
from granary.operators import chunking, corpus, embedding, governance, graph, verify
from granary.plans import sql
from granary.plans.registry import query
from granary.runtime import checkpoint_dir, table
from granary.sources import files


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# --- ingestion

@query(f"""WITH h AS (SELECT doc_id, md5({sql.collapse('text')}) AS content_hash FROM documents)
SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS existing_doc_id, doc_id <> min(doc_id) OVER (PARTITION BY content_hash) AS is_duplicate FROM h""")
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_of_content(documents(spark, sf_dir))


@query(f"SELECT doc_id, {sql.boilerplate('text')} AS clean FROM documents")
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.strip_boilerplate("text").alias("clean"))


@query(f"SELECT doc_id, {sql.ocr('text')} AS clean FROM documents")
def ocr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.clean_ocr("text").alias("clean"))


@query(f"""WITH c AS (SELECT doc_id AS id, {sql.boilerplate(sql.ocr('text'))} AS x FROM documents)
SELECT id, md5({sql.collapse('x')}) AS doc_id, x <> '' AS success, length(x)::VARCHAR AS char_count, len({sql.words('x')})::VARCHAR AS word_count, id || '.txt' AS filename, '.txt' AS file_extension FROM c""")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file's bytes through cleaning, hashing and metadata."""
    raw = documents(spark, sf_dir).select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("bigint").alias("length"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("modificationTime"),
    )
    m = F.col("metadata")
    return corpus.normalize(raw, now="2025-01-01T00:00:00Z").select(
        F.regexp_extract(m["filename"], r"^(\d+)", 1).cast("bigint").alias("id"), "doc_id", "success", m["char_count"].alias("char_count"), m["word_count"].alias("word_count"), m["filename"].alias("filename"), m["file_extension"].alias("file_extension"),
    )


@query(f"SELECT doc_id, len({sql.words('text')})::INTEGER AS words, length(text)::INTEGER AS chars FROM documents")
def doc_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.word_count("text").alias("words"), F.length("text").alias("chars"))


@query(f"""WITH r AS (SELECT doc_id, length(text) AS chars, len({sql.words('text')}) AS words, md5({sql.collapse('text')}) AS h, {sql.collapse('text')} <> '' AS ok FROM documents),
k AS (SELECT h, count(*) AS n, arg_min(chars, doc_id) AS chars, arg_min(words, doc_id) AS words FROM r WHERE ok GROUP BY h)
SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r WHERE NOT ok) AS failed, count(*) AS successful, coalesce(sum(n - 1), 0)::BIGINT AS duplicates, sum(chars)::BIGINT AS total_chars, sum(words)::BIGINT AS total_words FROM k""")
def ingestion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ingestion_stats(documents(spark, sf_dir))


@query()
def html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_html(table(spark, sf_dir, "pages"), "page_id")


HASHED = f"""hw AS (SELECT doc_id, md5(unnest({sql.tokens(f"left({sql.collapse('text')}, 2048)")})) AS m FROM documents), hh AS (SELECT doc_id, ('0x' || left(m, 15))::BIGINT AS h FROM hw),
hv AS (SELECT doc_id, (h % 384)::INTEGER AS place, sum(1 - 2 * (h // 384 % 2))::DOUBLE AS x FROM hh GROUP BY ALL), hn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM hv GROUP BY ALL)"""


@query(f"WITH {HASHED} SELECT doc_id::VARCHAR AS doc_id, place, (x / (n + 1e-10::DOUBLE))::FLOAT::DOUBLE AS x, 'hashing' AS model, left(md5('hashing:True:1'), 8) AS preprocessing_hash FROM hv JOIN hn USING (doc_id) WHERE x <> 0")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's vector, by its components that aren't 0."""
    rows = embedding.embed(documents(spark, sf_dir), now="2025-01-01T00:00:00Z")
    return rows.select("doc_id", F.posexplode("embedding").alias("place", "x"), "model", "preprocessing_hash").filter("x <> 0").withColumn("x", F.col("x").cast("double"))


@query(f"SELECT doc_id, left({sql.collapse('text')}, 2048) AS ready, left(md5('hashing:True:1'), 8) AS preprocessing_hash, 'docs_a_b_2025_01_01' AS index_name FROM documents")
def preprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the encoder sees; the cut at 2,048 characters is the encoder's own limit."""
    return documents(spark, sf_dir).select("doc_id", t.preprocess("text").alias("ready"), t.preprocessing_hash("hashing", True, "1").alias("preprocessing_hash"), t.index_name("docs", "a-b", "2025-01-01").alias("index_name"))


@query("SELECT doc_id, md5(concat_ws('|', doc_id::VARCHAR, source, 'lang=' || lang)) AS key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.cache_key("doc_id", "source", lang="lang").alias("key"))


# --- sentences and chunks

@query(f"SELECT doc_id, len({sql.plain_sentences('text')})::INTEGER AS n_sentences FROM documents")
def sentence_split_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(t.plain_sentences("text")).alias("n_sentences"))


SENTENCES = rf"""g AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])({t.any_of(t.ABBREVIATIONS)})\.', '\1\2' || chr(2), 'gi'), '(\d)\.(\d)', '\1' || chr(2) || '\2', 'g') AS x FROM documents),
ss AS (SELECT doc_id, list_filter(list_transform({sql.plain_sentences('x')}, lambda s: {sql.strip("replace(s, chr(2), '.')")}), lambda s: s <> '') AS ss FROM g)"""


@query(f"WITH {SENTENCES} SELECT doc_id, array_to_string(ss, '|') AS sentences FROM ss")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(t.sentences("text"), "|").alias("sentences"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(documents(spark, sf_dir), limit=300, overlap=30)


@query()
def semantic_chunks_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in tokens of a byte-pair vocabulary instead of words."""
    return chunking.chunk_documents(documents(spark, sf_dir), limit=500, overlap=50, count=chunking.BytePairs("/opt/tokenizers/byte_bpe_50k.tiktoken"))


@query(f"""WITH RECURSIVE {SENTENCES}, one AS MATERIALIZED (SELECT doc_id, i, ss[i] AS s, len({sql.words('ss[i]')}) AS n, len(ss) AS m FROM ss, unnest(range(1, len(ss) + 1)) AS u(i)),
f(doc_id, i, m, chunk, held, sizes, cut, done) AS (SELECT doc_id, 1::BIGINT, m, 0, [s], [n], -1, NULL::VARCHAR FROM one WHERE i = 1 UNION ALL
  SELECT doc_id, o.i, o.m, CASE WHEN full_ THEN chunk + 1 ELSE chunk END, CASE WHEN full_ THEN [held[-1], o.s] ELSE list_append(held, o.s) END, CASE WHEN full_ THEN [sizes[-1], o.n] ELSE list_append(sizes, o.n) END,
    CASE WHEN full_ THEN chunk ELSE -1 END, CASE WHEN full_ THEN array_to_string(held, ' ') END FROM (SELECT f.*, o, list_sum(f.sizes) + o.n > 200 AS full_ FROM f JOIN one o ON o.doc_id = f.doc_id AND o.i = f.i + 1)),
c AS (SELECT doc_id, cut AS chunk_index, done AS text FROM f WHERE cut >= 0 UNION ALL SELECT doc_id, chunk, array_to_string(held, ' ') FROM f WHERE i = m)
SELECT doc_id::VARCHAR AS doc_id, chunk_index, text, len({sql.words('text')})::INTEGER AS token_count FROM c""")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_chunks(documents(spark, sf_dir), limit=200, overlap=1)


WINDOWS = f"""ws AS (SELECT doc_id, {sql.words('text')} AS ws FROM documents),
cut AS (SELECT doc_id, ws, unnest(range(greatest(ceil((len(ws) - 50) / 450.0)::BIGINT, 1))) AS i FROM ws WHERE len(ws) > 0),
chunks AS (SELECT doc_id, i::INTEGER AS chunk_index, array_to_string(ws[i * 450 + 1 : i * 450 + 500], ' ') AS text, len(ws[i * 450 + 1 : i * 450 + 500])::INTEGER AS token_count FROM cut)"""


@query(f"WITH {WINDOWS} SELECT * FROM chunks")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_windows(documents(spark, sf_dir))


@query(f"""WITH {WINDOWS} SELECT count(*) AS total_chunks, avg(token_count) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, stddev_pop(token_count) AS std_tokens,
count(*) FILTER (token_count < 50) AS too_small, count(*) FILTER (token_count > 1500) AS too_large FROM chunks""")
def chunk_size_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.size_quality(token_windows(spark, sf_dir))


@query(f"""WITH {WINDOWS}, p AS (SELECT list_distinct({sql.tokens('text')}[-50:]) AS a, lead(list_distinct({sql.tokens('text')}[:50])) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS b FROM chunks)
SELECT CASE WHEN count(*) < 2 THEN 1.0::DOUBLE ELSE coalesce(avg(len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE) FILTER (len(a) > 0 AND len(b) > 0), 0) END AS overlap_quality FROM p""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.overlap_quality(token_windows(spark, sf_dir))


@query(f"""WITH s AS (SELECT doc_id, list_transform(list_filter(list_transform({sql.plain_sentences('text')}, lambda s: {sql.strip('s')}), lambda s: s <> ''), lambda s: list_distinct({sql.tokens('s')})) AS sets FROM documents)
SELECT doc_id, CASE WHEN len(sets) < 2 THEN 1.0::DOUBLE ELSE list_avg(list_transform(range(1, len(sets)), lambda i: len(list_intersect(sets[i], sets[i + 1])) / least(len(sets[i]), len(sets[i + 1]))::DOUBLE)) END AS coherence FROM s""")
def sentence_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.coherence(documents(spark, sf_dir), "doc_id")


def _coherence(x: str) -> str:
    """CTE-free coherence of the sentence sets ``x``."""
    pairs = f"list_filter(list_transform(range(1, greatest(len({x}), 1)), lambda i: CASE WHEN len({x}[i]) > 0 AND len({x}[i + 1]) > 0 THEN len(list_intersect({x}[i], {x}[i + 1])) / least(len({x}[i]), len({x}[i + 1]))::DOUBLE END), lambda y: y IS NOT NULL)"
    return f"CASE WHEN len({x}) < 2 THEN 1.0::DOUBLE WHEN len({pairs}) = 0 THEN 0.5::DOUBLE ELSE list_avg({pairs}) END"


@query(f"""WITH {WINDOWS}, st AS (SELECT count(*) AS total_chunks, avg(token_count) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, stddev_pop(token_count) AS std_tokens,
count(*) FILTER (token_count < 50) AS too_small, count(*) FILTER (token_count > 1500) AS too_large FROM chunks),
p AS (SELECT list_distinct({sql.tokens('text')}[-50:]) AS a, lead(list_distinct({sql.tokens('text')}[:50])) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS b FROM chunks),
o AS (SELECT CASE WHEN count(*) < 2 THEN 1.0::DOUBLE ELSE coalesce(avg(len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE) FILTER (len(a) > 0 AND len(b) > 0), 0) END AS overlap_quality FROM p),
k AS (SELECT list_transform(list_filter(list_transform({sql.plain_sentences('text')}, lambda s: {sql.strip('s')}), lambda s: s <> ''), lambda s: list_distinct({sql.tokens('s')})) AS sets FROM chunks),
h AS (SELECT avg({_coherence('sets')}) AS avg_coherence FROM k), al AS (SELECT * FROM st CROSS JOIN o CROSS JOIN h)
SELECT *, coalesce(nullif(concat_ws('|', CASE WHEN too_small > total_chunks * 0.1 THEN too_small || ' of ' || total_chunks || ' chunks are below 50 tokens: lower the minimum' END,
CASE WHEN too_large > total_chunks * 0.1 THEN too_large || ' of ' || total_chunks || ' chunks exceed 1500 tokens: lower the maximum' END, CASE WHEN std_tokens > 400 THEN 'sizes vary widely: make boundaries more even' END,
CASE WHEN avg_coherence < 0.5 THEN 'low coherence: chunks may span subjects' END, CASE WHEN overlap_quality < 0.3 THEN 'little overlap: raise overlap_tokens' END), ''), 'chunk sizes and boundaries look good') AS recommendations FROM al""")
def chunk_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.quality_report(token_windows(spark, sf_dir)).withColumn("recommendations", F.array_join("recommendations", "|"))


_PARAMS = {k: v for k, v in t.CHUNK_DEFAULTS.items() if k != "general"}


@query(f"""WITH p AS (SELECT doc_id, len({sql.words('text')}) / greatest(len(string_split(coalesce(text, ''), chr(10) || chr(10))), 1)::DOUBLE AS mean,
CASE source {' '.join(f"WHEN '{k}' THEN {v[0]}" for k, v in _PARAMS.items())} ELSE {t.CHUNK_DEFAULTS['general'][0]} END AS size,
CASE source {' '.join(f"WHEN '{k}' THEN {v[1]}" for k, v in _PARAMS.items())} ELSE {t.CHUNK_DEFAULTS['general'][1]} END AS lap FROM documents)
SELECT doc_id, CASE WHEN mean > size THEN floor(mean * 1.2::DOUBLE)::INTEGER ELSE size END AS max_tokens, lap AS overlap_tokens, mean > size AS widened FROM p""")
def chunk_param_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.chunk_params("text", "source").alias("p")).select("doc_id", "p.*")


@query(f"""WITH w AS (SELECT doc_id, text, {sql.words('text')} AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) <= 120 THEN text ELSE array_to_string(ws[:120], ' ') END AS by_end,
CASE WHEN len(ws) <= 120 THEN text ELSE array_to_string(ws[:48], ' ') || chr(10) || chr(10) || '[...content truncated...]' || chr(10) || chr(10) || array_to_string(ws[len(ws) - 71 :], ' ') END AS by_middle FROM w""")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.operators.context import truncate

    return documents(spark, sf_dir).select("doc_id", truncate("text", 120, "end").alias("by_end"), truncate("text", 120, "middle").alias("by_middle"))


# --- facts and verification

_PIPE = "array_to_string({}, '|')"


@query(f"""SELECT doc_id, {_PIPE.format(sql.found('text', t.NUMBER))} AS numbers, {_PIPE.format(sql.found('text', t.CURRENCY))} AS currencies,
{_PIPE.format(f"list_sort(list_distinct({' || '.join(sql.found('text', '(?i)' + p) for p in t.DATES)}))")} AS dates FROM documents""")
def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", *[F.array_join(f("text"), "|").alias(n) for n, f in (("numbers", t.numbers), ("currencies", t.currencies), ("dates", t.dates))])


@query(r"""WITH m AS (SELECT doc_id, chr(1) || regexp_replace(coalesce(text, ''), '([^\p{L}\p{N}\p{M}_]+)', chr(1) || '\1' || chr(1), 'g') || chr(1) AS x FROM documents),
n AS (SELECT doc_id, list_transform(regexp_extract_all(x, '\x01([A-Z][a-z]+(?:\x01\s+\x01[A-Z][a-z]+)*)\x01', 1), lambda w: replace(w, chr(1), '')) AS ns FROM m)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(ns, lambda w: lower(w) NOT IN ('the', 'this', 'that', 'these', 'those')))), '|') AS names FROM n""")
def extract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised words. The SQL marks word edges itself, since its own are ASCII only."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(t.names("text"), "|").alias("names"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, answer, context): each assistant turn after the turn before it."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = turns(spark, sf_dir).select("conv_id", "turn", "role", F.col("text").alias("answer"), before.alias("context"))
    return rows.filter("role = 'assistant'").select("conv_id", "turn", "answer", F.coalesce("context", F.lit("")).alias("context"))


ANSWERS = """ans AS (SELECT conv_id, turn, answer, coalesce(context, '') AS context FROM
  (SELECT conv_id, turn, role, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations) WHERE role = 'assistant')"""


def _missing(pattern: str) -> str:
    return f"list_filter({sql.found('answer', pattern)}, lambda x: NOT list_contains({sql.found('context', pattern)}, x))"


_NUMBERS, _MONEY = _missing(t.NUMBER), _missing(t.CURRENCY)
_DATES = [f"list_sort(list_distinct({' || '.join(sql.found(c, '(?i)' + p) for p in t.DATES)}))" for c in ("answer", "context")]
_DATES = f"list_filter({_DATES[0]}, lambda x: NOT list_contains({_DATES[1]}, x))"


@query(f"""WITH {ANSWERS}, m AS (SELECT conv_id, turn, {_NUMBERS} AS a, {_DATES} AS b, {_MONEY} AS c FROM ans)
SELECT conv_id, turn, len(a) + len(b) + len(c) = 0 AS level1_passed, array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'unsupported numbers: ' || array_to_string(a, ', ') END,
CASE WHEN len(b) > 0 THEN 'unsupported dates: ' || array_to_string(b, ', ') END, CASE WHEN len(c) > 0 THEN 'unsupported currencies: ' || array_to_string(c, ', ') END], lambda x: x IS NOT NULL), '|') AS issues FROM m""")
def verify_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.check(answers(spark, sf_dir)).select("conv_id", "turn", "level1_passed", F.array_join("issues", "|").alias("issues"))


_STOP = ", ".join(f"'{w}'" for w in verify.STOP)
_GENERIC = " OR ".join("contains(lower(answer), '{}')".format(g.replace("'", "''")) for g in verify.GENERIC)


@query(f"""WITH {ANSWERS}, k AS (SELECT conv_id, turn, answer, len({_NUMBERS}) + len({_DATES}) + len({_MONEY}) = 0 AS l1,
list_filter(list_distinct({sql.tokens('answer')}), lambda w: w NOT IN ({_STOP})) AS own, {sql.tokens('context')} AS other FROM ans),
v AS (SELECT *, NOT (coalesce(len(own) > 0 AND len(list_intersect(own, other)) / len(own)::DOUBLE < 0.3::DOUBLE, false) OR {_GENERIC}) AS ok FROM k)
SELECT conv_id, turn, l1 AS level1_passed, CASE WHEN l1 THEN ok END AS level2_passed, CASE WHEN l1 AND ok THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN l1 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
CASE WHEN l1 AND ok THEN answer ELSE 'Not found in context' END AS final_answer FROM v""")
def verify_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels, with the keyword critic as level 2."""
    got = verify.heuristic_critic("answer", "context")
    critic = F.struct(got["valid"].alias("valid"), F.lit(0.8).alias("confidence"), got["issues"].alias("issues"))
    out = verify.answer_or_fallback(verify.verify(answers(spark, sf_dir), critic=critic))
    return out.select("conv_id", "turn", "level1_passed", "level2_passed", "status", "confidence", "final_answer")


# --- personal data and access

_PII = {k: f"(?i){p}".replace("(\\+?", "(?:\\+?") for k, p in governance.PII.items()}


@query(f"SELECT doc_id, {', '.join(f'len(regexp_extract_all(text, {chr(39)}{p}{chr(39)}))::INTEGER AS {k}' for k, p in _PII.items())} FROM documents")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", governance.pii("text").alias("m"))
    return rows.select("doc_id", *[F.size(F.col("m")[k]).alias(k) for k in governance.PII])


@query(f"SELECT doc_id, list_reduce(list_prepend(text, {' || '.join(f'regexp_extract_all(text, {chr(39)}{p}{chr(39)})' for p in _PII.values())}), lambda acc, m: replace(acc, m, '[REDACTED]')) AS clean FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", governance.redact("text").alias("clean"))


_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS gaps FROM documents" for k, p in _PII.items())


@query(f"""WITH f AS ({_FOUND}), k AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f WHERE len(m) > 0),
s AS (SELECT doc_id, type, m[k] AS value, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda x: length(x))), 0) AS start FROM k)
SELECT doc_id::VARCHAR AS doc_id, type, value, start::INTEGER AS start, (start + length(value))::INTEGER AS "end" FROM s""")
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.pii_spans(documents(spark, sf_dir))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants made from labels: tenants by quality, users by toxicity."""
    base = table(spark, sf_dir, "labels").select(F.concat(F.lit("tenant-"), F.col("quality").cast("string")).alias("tenant_id"), F.concat(F.lit("user-"), F.col("toxic").cast("string")).alias("user_id"), "doc_id")
    return governance.grant(base, base)


GRANTS = "g AS (SELECT DISTINCT 'tenant-' || quality AS tenant_id, 'user-' || toxic AS user_id, doc_id FROM labels)"


@query(f"WITH {GRANTS} SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM g WHERE tenant_id = 'tenant-1')")
def acl_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.allowed(documents(spark, sf_dir), grants(spark, sf_dir), "tenant_id", "tenant-1").select("doc_id", "lang", "source")


@query(f"WITH {GRANTS} SELECT doc_id, lang AS tenant_id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM g WHERE user_id = 'user-0')")
def acl_tenant_and_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access predicate of a tenant, here a language, and a user on a table that carries its tenants."""
    owned = documents(spark, sf_dir).withColumnRenamed("lang", "tenant_id")
    return governance.access_predicate(owned, grants(spark, sf_dir), "en", "user-0").select("doc_id", "tenant_id")


@query(f"WITH {GRANTS} SELECT doc_id, 'tenant-0' AS tenant_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND g.tenant_id = 'tenant-0')")
def acl_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = documents(spark, sf_dir).select("doc_id", F.lit("tenant-0").alias("tenant_id"))
    return governance.denied(asked, grants(spark, sf_dir), ["doc_id", "tenant_id"])


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND contains(text, 'and')")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.operators.retrieval import where

    return where(documents(spark, sf_dir), {"lang": "en"}, "and").select("doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table without some documents, as a new version of the index would be written."""
    return corpus.without_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels").filter("toxic = 1")).select("doc_id", "lang")


# --- entities

def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a sentence for every customer that names entities of each type."""
    parts = ("The manager of customer ", "c_name", " signed agreement C-", "c_custkey", " in the EMEA region. The CEO of the company wants the software platform, and the Manager a deal in ", "c_mktsegment", ".")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(*[F.col(x).cast("string") if x.startswith("c_") else F.lit(x) for x in parts]).alias("text"))


LETTERS = "SELECT c_custkey AS doc_id, 'The manager of customer ' || c_name || ' signed agreement C-' || c_custkey || ' in the EMEA region. The CEO of the company wants the software platform, and the Manager a deal in ' || c_mktsegment || '.' AS text FROM customer"
MENTIONS = f"l AS ({LETTERS}), m AS ({' UNION '.join(f"SELECT DISTINCT doc_id, text, lower(unnest(regexp_extract_all(text, '(?i){chr(92)}b({'|'.join(ps)}){chr(92)}b', 1))) AS entity, '{k}' AS type FROM l" for k, ps in graph.ENTITIES.items())})"


@query(f"WITH {MENTIONS} SELECT doc_id, entity, type FROM m")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.extract(letters(spark, sf_dir))


@query(rf"""WITH {MENTIONS}, p AS (SELECT *, length(regexp_extract(lower(text), '^(.*?)\b' || entity || '\b', 1))::INTEGER AS start FROM m)
SELECT doc_id, entity, type, start, (start + length(entity))::INTEGER AS "end", substr(text, greatest(start - 50, 0) + 1, start + length(entity) + 50 - greatest(start - 50, 0)) AS context FROM p""".replace("\\\\", "\\"))
def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.spans(letters(spark, sf_dir))


_COLOURS = {"Colour": ["red", "blue", "green", "small", "large"]}


@query("""SELECT DISTINCT p_partkey AS doc_id, w AS entity, 'Colour' AS type FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w IN ('red', 'blue', 'green', 'small', 'large')""")
def entity_extract_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.extract(table(spark, sf_dir, "part"), _COLOURS, "p_partkey", "p_name")


_CHARS = "list_filter(list_distinct(string_split({}, '')), lambda c: c <> '')"


@query(f"""WITH e AS (SELECT min(p_partkey)::VARCHAR AS id, p_name AS name FROM part GROUP BY p_name), m AS (SELECT DISTINCT lower(p_name) || 's' AS entity FROM part UNION SELECT DISTINCT lower(p_brand) FROM part),
f AS (SELECT entity, id, {sql.jaccard(_CHARS.format('entity'), _CHARS.format('lower(name)'))} AS s FROM m CROSS JOIN e),
b AS (SELECT entity, id FROM (SELECT entity, id, row_number() OVER (PARTITION BY entity ORDER BY s DESC, id) AS r FROM f WHERE s > 0.8::DOUBLE) WHERE r = 1)
SELECT entity, 'Part' AS type, CASE WHEN starts_with(entity, 'brand#1') THEN 'alias-' || entity WHEN b.id IS NOT NULL THEN b.id ELSE 'part_' || replace(entity, ' ', '_') END AS entity_id,
CASE WHEN starts_with(entity, 'brand#1') THEN 'alias' WHEN b.id IS NOT NULL THEN 'fuzzy' ELSE 'created' END AS how FROM m LEFT JOIN b USING (entity)""")
def entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plurals of part names and brands linked by alias, by likeness or anew."""
    part = table(spark, sf_dir, "part")
    known = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("id")).withColumn("type", F.lit("Part"))
    brands = part.select(F.lower("p_brand").alias("entity")).distinct()
    found = part.select(F.concat(F.lower("p_name"), F.lit("s")).alias("entity")).union(brands).withColumn("type", F.lit("Part"))
    aliases = brands.filter(F.col("entity").startswith("brand#1")).select(F.col("entity").alias("alias"), F.concat(F.lit("alias-"), "entity").alias("entity_id"))
    return graph.link(found, known, aliases)


# --- files, metadata and the stored index

@query(f"""WITH c AS (SELECT item_id, {sql.boilerplate(sql.ocr('text'))} AS x FROM benchmark), k AS (SELECT md5({sql.collapse('x')}) AS doc_id, item_id, x FROM c WHERE x <> '')
SELECT doc_id, true AS success, 'acme' AS tenant_id, 'bench' AS kind, arg_min(len({sql.words('x')}), item_id)::VARCHAR AS word_count FROM k GROUP BY doc_id""")
def files_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a file of its own: directory scan, size guard, parsing, cleaning, metadata and the first file of each content."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").select("text", F.format_string("%012d", "item_id").alias("item")).write.partitionBy("item").option("lineSep", "\n").text(base)
    m = F.col("metadata")
    found = files.ingest(spark, base, "acme", {"kind": "bench"}, now="2025-01-01T00:00:00Z")
    return found.select("doc_id", "success", m["tenant_id"].alias("tenant_id"), m["kind"].alias("kind"), m["word_count"].alias("word_count"))


@query("SELECT item_id, strlen(text) + 1 AS bytes, strlen(text) + 1 <= 400 AS fits FROM benchmark")
def files_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size guard over listed files: those within the limit and those beyond it."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").select("text", F.format_string("%012d", "item_id").alias("item")).write.partitionBy("item").option("lineSep", "\n").text(base)
    good, large = files.sized(files.scan(spark, [base]), 400)
    both = good.select("path", "length", F.lit(True).alias("fits")).unionAll(large.select("path", "length", F.lit(False)))
    return both.select(F.regexp_extract("path", r"item=(\d+)", 1).cast("bigint").alias("item_id"), F.col("length").alias("bytes"), "fits")


@query("SELECT vec_id AS id, label::VARCHAR AS tenant_id, 'hashing' AS embedding_model, '1' AS embedding_version, (SELECT count(*) FROM embeddings) AS rows FROM embeddings WHERE vec_id IN (3, 77, 401)")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector table written by tenant in two inserts, counted and looked up by ids."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("tenant_id"), "embedding")
    for part in (rows.filter("tenant_id < '5'"), rows.filter("tenant_id >= '5'")):
        corpus.add_to_index(part, path, model="hashing", version="1")
    index = spark.read.schema("id bigint, tenant_id string, embedding_model string, embedding_version string").parquet(path)
    return corpus.by_ids(index, [3, 77, 401]).crossJoin(F.broadcast(index.agg(F.count(F.lit(1)).alias("rows"))))


@query("SELECT doc_id, 'bench' AS kind, 'fixed' AS lang, source FROM documents")
def metadata_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    m = F.col("metadata")
    return corpus.override_metadata(rows, {"lang": "fixed", "kind": "bench"}).select("doc_id", m["kind"].alias("kind"), m["lang"].alias("lang"), m["source"].alias("source"))


@query(f"""WITH {ANSWERS}, m AS (SELECT conv_id, turn, {_NUMBERS} AS a, {sql.found('context', t.NUMBER)} AS c FROM ans)
SELECT conv_id, turn, array_to_string(list_filter(a, lambda x: len(list_filter(c, lambda y: abs(replace(x, '%', '')::DOUBLE - replace(y, '%', '')::DOUBLE) <= 2)) = 0), '|') AS unsupported FROM m""")
def number_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of an answer that no number of its context is within 2 of."""
    return answers(spark, sf_dir).select("conv_id", "turn", F.array_join(verify.unsupported_numbers("answer", "context", 2.0), "|").alias("unsupported"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN true ELSE false END AS valid, CASE turn % 3 WHEN 2 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS confidence,
CASE turn % 3 WHEN 2 THEN 'the critic''s reply can''t be read' WHEN 1 THEN 'a' ELSE '' END AS issues FROM conversations""")
def critic_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's replies read as verdicts: plain JSON, JSON within talk, and talk."""
    reply = F.when(F.col("turn") % 3 == 0, '{"valid": true, "confidence": 0.25, "issues": []}').when(F.col("turn") % 3 == 1, 'Here: {"valid": false, "confidence": 0.25, "issues": ["a"]} as asked').otherwise("I think it is fine")
    rows = turns(spark, sf_dir).select("conv_id", "turn", verify.critic_from_text(reply).alias("c"))
    return rows.select("conv_id", "turn", "c.valid", "c.confidence", F.array_join("c.issues", "|").alias("issues"))
