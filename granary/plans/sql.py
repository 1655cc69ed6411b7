"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from granary.functions import text as t


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({x}, ''), '\s+'), lambda w0: w0 <> '')"


def tokens(x: str) -> str:
    return words(f"lower({x})")


def collapse(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def boilerplate(x: str) -> str:
    for p in map(t.phrase_pattern, t.BOILERPLATE):
        x = f"regexp_replace({x}, '{p.removeprefix('(?i)')}', ' ', 'gi')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')")


def ocr(x: str) -> str:
    x = rf"regexp_replace({x}, '(\w)-\n(\w)', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '\s([a-zA-Z])\n([a-zA-Z])', ' \1\2', 'g')"
    return f"replace(replace(replace({x}, '–', '-'), '—', '-'), chr(12), chr(10) || chr(10))"


def plain_sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def found(x: str, pattern: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(coalesce({x}, ''), '{pattern}')))"


def overlap(q: str, x: str) -> str:
    """Share of the query's distinct words that the text has."""
    d = f"list_distinct({tokens(q)})"
    return f"CASE WHEN len({d}) = 0 THEN 0::DOUBLE ELSE len(list_intersect({d}, {tokens(x)})) / len({d})::DOUBLE END"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct({a} || {b})) = 0 THEN 0::DOUBLE ELSE len(list_intersect({a}, {b})) / len(list_distinct({a} || {b}))::DOUBLE END"


def contains_any(x: str, some: tuple[str, ...]) -> str:
    return f"regexp_matches({x}, '{'|'.join(some)}')"


def query_type(x: str) -> str:
    return f"CASE WHEN {contains_any(f'lower({x})', t.FACTUAL)} THEN 'factual' WHEN {contains_any(f'lower({x})', t.EXPLORATORY)} THEN 'exploratory' WHEN regexp_matches({x}, '[A-Z]{{2,}}\\d+|\\d{{3,}}') THEN 'navigational' ELSE 'general' END"


def weight(kind: str, i: int) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {w[i]}::DOUBLE" for k, w in t.WEIGHTS.items()) + " END"


BENCHMARK = "SELECT item_id AS query_id, text FROM benchmark"


def bm25(queries: str, k: int | None, where: str = "true") -> str:
    """CTEs up to bm(query_id, doc_id, score, rank)."""
    return f"""q AS ({queries}),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM q) GROUP BY ALL),
toks AS (SELECT doc_id, {tokens('text')} AS ts FROM documents WHERE {where}),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM toks) GROUP BY ALL),
dl AS (SELECT doc_id, len(ts) AS dlen FROM toks),
st AS (SELECT count(*)::DOUBLE AS n, avg(dlen) AS average FROM dl),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
bms AS (SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dlen / average))) AS score
  FROM asked JOIN post USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY query_id, doc_id),
bm AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bms){f' WHERE rank <= {k}' if k else ''})"""


def knn(queries: str, k: int, corpus: str = "SELECT vec_id AS id, embedding AS v FROM embeddings") -> str:
    """CTEs up to nn(query_id, id, cos, score, rank); ``queries`` gives (query_id, qvec)."""
    return f"""vq AS ({queries}), vc AS ({corpus}),
nns AS (SELECT query_id, id, list_cosine_similarity(v::DOUBLE[], qvec::DOUBLE[]) AS cos FROM vc CROSS JOIN vq),
nn AS (SELECT * FROM (SELECT query_id, id, cos, (1 + cos) / 2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round((1 + cos) / 2, 9) DESC, id) AS rank FROM nns) WHERE rank <= {k})"""


ITEM_VECTORS = "SELECT item_id AS query_id, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id"
ALL_VECTORS = "SELECT vec_id AS query_id, embedding AS qvec FROM embeddings"
