"""Text, hash and pattern functions: Column to Column, all inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(words: Iterable[str]) -> str:
    """A pattern that holds one of some literal words."""
    return "|".join(w.replace(".", r"\.") for w in words)


def words(text: ColumnOrName) -> Column:
    """White-space separated words as they are; none for null or empty text."""
    return F.array_remove(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), "")


def tokens(text: ColumnOrName) -> Column:
    """Lower-cased words."""
    return words(F.lower(col(text)))


def word_count(text: ColumnOrName) -> Column:
    return F.size(words(text))


def collapse(text: ColumnOrName) -> Column:
    """White space collapsed to single spaces."""
    return F.array_join(words(text), " ")


def content_hash(text: ColumnOrName, algorithm: str = "md5") -> Column:
    """Hash of the collapsed text, by MD5 unless SHA-256 is asked for."""
    return F.sha2(collapse(text), 256) if algorithm == "sha256" else F.md5(collapse(text))


#: Phrases that go, in this order: an earlier one may take part of a later one.
BOILERPLATE = (
    "confidential information",
    "all rights reserved",
    "page # of #",
    "copyright ©? ?####",
    "proprietary and confidential",
    "do not distribute",
    "internal use only",
    "draft ?-? ?not for distribution",
)


def phrase_pattern(phrase: str) -> str:
    """``BOILERPLATE`` spelling to pattern: a space is white space, ' ?' optional white space, # digits, #### a year."""
    out = phrase.replace(" ?-? ?", r"\s*-?\s*").replace(" ©? ?", r"\s+©?\s*").replace("####", r"\d{4}").replace("#", r"\d+")
    return "(?i)" + out.replace(" ", r"\s+")


def strip_white(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_boilerplate(text: ColumnOrName, patterns: Iterable[str] | None = None) -> Column:
    """Boilerplate replaced by a space, then blank lines and runs of spaces squeezed. ``patterns`` replace the standard ones."""
    out = col(text)
    for p in patterns if patterns is not None else map(phrase_pattern, BOILERPLATE):
        out = F.regexp_replace(out, p, " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip_white(F.regexp_replace(out, r"[ \t]{2,}", " "))


def clean_ocr(text: ColumnOrName, normalize_quotes: bool = False) -> Column:
    """Words broken over lines joined, a lone letter at a line's end drawn to the next line, dashes made plain, form feeds made blank lines.
    Curly quotes only on request."""
    out = F.regexp_replace(col(text), r"(\w)-\n(\w)", "$1$2")
    out = F.translate(F.regexp_replace(out, r"\s([a-zA-Z])\n([a-zA-Z])", " $1$2"), "–—", "--")
    if normalize_quotes:
        out = F.translate(out, "“”‘’", "\"\"''")
    return F.regexp_replace(out, "\f", "\n\n")


def plain_sentences(text: ColumnOrName) -> Column:
    """Split after . ! or ? before white space."""
    return F.split(col(text), r"(?<=[.!?])\s+")


ABBREVIATIONS = "mr mrs ms dr prof sr jr vs etc eg ie al inc ltd corp jan feb mar apr jun jul aug sep oct nov dec".split()


def sentences(text: ColumnOrName) -> Column:
    """Sentences, not split after an abbreviation or within a decimal number."""
    guarded = F.regexp_replace(col(text), rf"(?i)\b({any_of(ABBREVIATIONS)})\.", "$1\u0001")
    guarded = F.regexp_replace(guarded, r"(\d)\.(\d)", "$1\u0001$2")
    parts = F.transform(F.split(guarded, r"(?<=[.!?])\s+"), lambda s: strip_white(F.translate(s, "\u0001", ".")))
    return F.filter(parts, lambda s: s != "")


def preprocess(text: ColumnOrName, max_chars: int = 2048) -> Column:
    """What an encoder sees: collapsed and cut."""
    return F.substring(collapse(text), 1, max_chars)


def preprocessing_hash(model: str, normalize: bool, version: str) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(model), F.lit(str(normalize)), F.lit(version))), 1, 8)


def index_name(collection: str, model: str, version: str) -> Column:
    """Name of the index of one model and version; versions never share one."""
    return F.concat_ws("_", F.lit(collection), F.translate(F.lit(model), "/-.", "___"), F.translate(F.lit(version), "-", "_"))


def cache_key(*parts: ColumnOrName, **named: ColumnOrName) -> Column:
    """MD5 of the parts and the sorted name=value pairs, joined by bars."""
    values = [col(p).cast("string") for p in parts] + [F.concat(F.lit(f"{k}="), col(v).cast("string")) for k, v in sorted(named.items())]
    return F.md5(F.concat_ws("|", *values))


# --- queries

FILLERS = ("please", "can", "you", "tell", "me", "about", "what", "is", "the")
FACTUAL = ("what is", "how much", "when", "where", "price", "cost", "date", "number", "amount")
EXPLORATORY = ("explain", "describe", "overview", "summary", "tell me about", "what are", "how does")
WEIGHTS = {"factual": (0.5, 0.5), "exploratory": (0.8, 0.2), "navigational": (0.3, 0.7), "general": (0.7, 0.3)}


def expand_query(query: ColumnOrName) -> Column:
    """The query without filler words, or itself if fewer than two words would stay."""
    kept = F.filter(words(query), lambda w: ~F.lower(w).isin(*FILLERS))
    return F.when(F.size(kept) < 2, col(query)).otherwise(F.array_join(kept, " "))


def query_type(query: ColumnOrName) -> Column:
    """factual, exploratory, navigational or general; the first that fits. Keywords count as substrings."""
    low = F.lower(col(query))
    return (
        F.when(low.rlike(any_of(FACTUAL)), "factual")
        .when(low.rlike(any_of(EXPLORATORY)), "exploratory")
        .when(col(query).rlike(r"[A-Z]{2,}\d+|\d{3,}"), "navigational")
        .otherwise("general")
    )


def query_weights(kind: ColumnOrName) -> Column:
    """struct(vector_weight, lexical_weight) of a query type."""
    out = None
    for name, (v, x) in WEIGHTS.items():
        pair = F.struct(F.lit(v).alias("vector_weight"), F.lit(x).alias("lexical_weight"))
        out = F.when(col(kind) == name, pair) if out is None else out.when(col(kind) == name, pair)
    return out


COMPLEX = ("legal", "policy", "compliance", "contract", "regulation", "liability", "indemnification")
MODELS = {"small": "gpt-4.1-mini", "medium": "gpt-4.1-mini", "large": "gpt-4.1"}


def route_model(query: ColumnOrName) -> Column:
    """Size of the model for a query: small under 40 characters, large for complex subjects or several questions, else medium."""
    q, low = col(query), F.lower(col(query))
    several = (F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit(""))) > 1) | low.contains(" and ")
    return F.when(F.length(q) < 40, "small").when(low.rlike(any_of(COMPLEX)) | several, "large").otherwise("medium")


def model_name(size: ColumnOrName) -> Column:
    """Model of a size; an unknown size is medium."""
    return F.when(col(size) == "large", MODELS["large"]).when(col(size) == "small", MODELS["small"]).otherwise(MODELS["medium"])


# --- facts in a text

NUMBER = r"\b\d+(?:\.\d+)?%?\b"
CURRENCY = r"[$€£¥][\d,]+(?:\.\d{2})?"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DATES = (r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", rf"\b(?:{'|'.join(MONTHS)})[a-z]* \d{{1,2}},? \d{{4}}\b", r"\b\d{4}[-/]\d{2}[-/]\d{2}\b")


def found(text: ColumnOrName, pattern: str, group: int = 0) -> Column:
    """Distinct matches of a pattern, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(group))))


def numbers(text: ColumnOrName) -> Column:
    """Whole and decimal numbers; a percent sign stays only if a word character follows."""
    return found(text, NUMBER)


def currencies(text: ColumnOrName) -> Column:
    return found(text, CURRENCY)


def dates(text: ColumnOrName) -> Column:
    parts = [found(text, "(?i)" + p) for p in DATES]
    return F.array_sort(F.array_union(F.array_union(parts[0], parts[1]), parts[2]))


def names(text: ColumnOrName) -> Column:
    """Runs of capitalised words, but for five pronouns and articles."""
    return F.filter(found(text, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", 1), lambda n: ~F.lower(n).isin("the", "this", "that", "these", "those"))


def facts(text: ColumnOrName) -> Column:
    return F.struct(numbers(text).alias("numbers"), dates(text).alias("dates"), currencies(text).alias("currencies"), names(text).alias("entities"))


# --- overlap

def lexical_overlap(query: ColumnOrName, text: ColumnOrName, epsilon: float = 0.0) -> Column:
    """Share of the query's distinct words that the text has; 0 for an empty query. ``epsilon`` is added to the denominator."""
    q = F.array_distinct(tokens(query))
    shared = F.size(F.array_intersect(q, tokens(text)))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(shared / (F.size(q) + F.lit(epsilon)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def characters(text: ColumnOrName) -> Column:
    return F.filter(F.array_distinct(F.split(F.coalesce(col(text), F.lit("")), "")), lambda c: c != "")


def character_jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    return jaccard(characters(a), characters(b))


def bm25_without_idf(query: ColumnOrName, text: ColumnOrName, k1: float = 1.5, b: float = 0.75, average: float = 500.0) -> Column:
    """Saturated term frequencies summed over the query's words, each as often as it is repeated there."""

    def total(terms: Column) -> Column:
        norm = k1 * (1 - b + b * F.size(terms) / F.lit(average))
        tfs = F.transform(tokens(query), lambda q: (F.size(terms) - F.size(F.array_remove(terms, q))).cast("double"))
        return F.aggregate(tfs, F.lit(0.0), lambda x, tf: x + tf * (k1 + 1) / (tf + norm))

    # The words are bound to a variable, so that they are split once a row and not once for each of the query's.
    return F.element_at(F.transform(F.array(tokens(text)), total), 1)


# --- rendering

def relation_phrase(kind: ColumnOrName) -> Column:
    return F.lower(F.replace(col(kind), F.lit("_"), F.lit(" ")))


def chunk_header(position: ColumnOrName, doc: ColumnOrName, chunk: ColumnOrName, score: ColumnOrName | None, title: ColumnOrName | None = None) -> Column:
    """Header of a source in a context; ``position`` counts from 1."""
    out = F.concat(F.lit("[Source "), col(position).cast("string"), F.lit("] doc="), col(doc).cast("string"), F.lit(" chunk="), col(chunk).cast("string"))
    if score is not None:
        out = F.concat(out, F.lit(" | score: "), F.format_string("%.2f", col(score)))
    return out if title is None else F.concat(out, F.when(F.coalesce(col(title), F.lit("")) != "", F.concat(F.lit("\nTitle: "), col(title))).otherwise(""))


def simple_chunk(position: ColumnOrName, doc: ColumnOrName, chunk: ColumnOrName, text: ColumnOrName) -> Column:
    return F.concat(F.lit("[Chunk "), col(position).cast("string"), F.lit("] doc="), F.coalesce(col(doc).cast("string"), F.lit("unknown")), F.lit(" chunk="), F.coalesce(col(chunk).cast("string"), (col(position) - 1).cast("string")), F.lit("\n"), F.coalesce(col(text), F.lit("")))


def json_in(text: ColumnOrName, schema: str) -> Column:
    """The text read as JSON, or what lies between its first and last brace, or null."""
    whole = F.from_json(F.when(col(text).rlike(r"^\s*[\{\[]"), col(text)), schema, {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(col(text), r"(\{[\s\S]*\})", 1), schema, {"mode": "PERMISSIVE"})
    return F.coalesce(whole, F.when(col(text).rlike(r"\{[\s\S]*\}"), inner))


# --- chunk rules

CHUNK_DEFAULTS = {"legal": (1200, 150), "code": (600, 50), "faq": (300, 30), "general": (800, 100)}


def chunk_params(text: ColumnOrName, domain: ColumnOrName) -> Column:
    """struct(max_tokens, overlap_tokens, widened): a domain's defaults, widened to 1.2 times the mean paragraph if that is longer."""
    mean = word_count(text) / F.greatest(F.size(F.split(F.coalesce(col(text), F.lit("")), "\n\n")), F.lit(1))
    size, overlap = (F.element_at(F.create_map(*[F.lit(x) for k, v in CHUNK_DEFAULTS.items() for x in (k, v[i])]), F.when(col(domain).isin(*CHUNK_DEFAULTS), col(domain)).otherwise("general")) for i in (0, 1))
    return F.struct(F.when(mean > size, F.floor(mean * 1.2).cast("int")).otherwise(size).alias("max_tokens"), overlap.alias("overlap_tokens"), (mean > size).alias("widened"))


def coherence(text: ColumnOrName) -> Column:
    """Mean word overlap of adjacent sentences: 1 below two sentences, 0.5 if no pair has words."""
    parts = F.filter(F.transform(plain_sentences(text), strip_white), lambda s: s != "")
    sets = F.transform(parts, lambda s: F.array_distinct(tokens(s)))
    pairs = F.zip_with(F.slice(sets, 1, F.greatest(F.size(sets) - 1, F.lit(0))), F.slice(sets, 2, F.greatest(F.size(sets) - 1, F.lit(0))), lambda a, b: F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))
    good = F.filter(pairs, lambda x: x.isNotNull())
    mean = F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / F.size(good)
    return F.when(F.size(parts) < 2, F.lit(1.0)).when(F.size(good) == 0, F.lit(0.5)).otherwise(mean)
