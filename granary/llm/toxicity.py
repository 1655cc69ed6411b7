"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols of a small alphabet. Five transducers rewrite and score them:

- negation marks the insults and threats within a few words after a negator, n't with any apostrophe included;
- reported speech marks those after a reporting verb in the same clause;
- threat looks for a verb of violence with its target: grave verbs with the target after them; verbs that have harmless senses too only after a
  modal, and not if the target is followed by what makes it another sense (beat you at chess, shoot them a message); verbs that come after
  their target, as in German, French and Spanish, only after a modal. A modal adds to a threat;
- target pairs an insult with a second person or group word near it on either side;
- scoring turns insults, as marked, into weights.

They are composed into one weighted transducer, whose states are built as they are
reached. A clause's score is the weight of its path; a document's score is the sum over its clauses.
A last transducer tells which clauses count by themselves: those with an insult near a target, with two insults (two mild
ones must be next to each other) or with a threat. The others hold isolated words, of which one
decides nothing: they count only if two clauses or more hold insults, not all of them mild, and
such clauses are ``SCATTERED`` by word, as labelled documents have insults strewn over their clauses.
A document is toxic if a clause that counts by itself reaches ``clause_limit``, or if the sum over those that
count reaches ``score_limit`` and, by word, ``density_limit``.

The lexicon of insults is widened by stems that are learned from labelled documents: word beginnings that are
far more frequent in toxic ones than in others and come back within a document. They are read as a weak insult, which needs a second one in its clause,
a target or many such clauses to count.
At most ``Learning.rows`` labelled documents of each class are used; documents that share their four least word hashes,
as copies do, count once.

Only words of the lexicon are looked at one by one, and only in clauses that hold an insult
or a threat; all others are passed over by vectorised hash lookups.

Defined results: a null or empty text has score 0 and isn't toxic; every row gives one
row, repeated rows and null doc_ids too; an empty table gives an empty table. Letter case doesn't count.
A language whose toxic documents are fewer than ``support`` or ``share`` of all used learns no stems. Labels without a doc_id or a class are ignored; of several for a document the toxic one counts. Without labels of both classes nothing is learned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernel
from granary.llm.common import map_batches

LEXICON = {
    # strong and mild insults
    "I": "idiot idiots moron morons imbecile imbeciles scum scumbag worthless disgusting vermin subhuman bastard bitch asshole retard retarded degenerate filth parasite cretin "
    "arschloch schwachkopf abschaum wichser missgeburt connard connasse salaud ordure gilipollas cabrón imbécil escoria débile enculé",
    "i": "stupid clown clowns loser losers pathetic trash garbage dumb ugly fool fools creep jerk pig pigs coward cowards liar "
    "trottel versager widerlich erbärmlich minable pitoyable dégoûtant dégueulasse estúpido estúpida patético basura asqueroso perdedor",
    # verbs of violence: grave ones; those with harmless senses; those that follow their object; those that hold it
    "H": "kill murder strangle stab slaughter",
    "h": "hurt destroy shoot beat burn hang hit",
    "V": "töten umbringen erschießen erwürgen verprügeln tuer frapper poignarder étrangler égorger matar golpear apuñalar",
    "X": "matarte mataros matarlos matarlas golpearte apuñalarte",
    "M": "will gonna going shall should must want wollen will werde werden sollte vais vas va allons vont doit veux voy vamos van quiero debe",
    "T": "you your youre yours yourself u ya du bist dich dir euch seid tu toi te vous êtes ti usted ustedes vosotros eres",
    "G": "they them these those people immigrants women men jews muslims christians blacks whites",
    # what may follow the object of a verb in a harmless sense
    "D": "a an the some at in on to for with by",
    "N": "not never no nobody isnt arent wasnt dont doesnt didnt without hardly nicht kein keine niemals jamais aucun nunca ningún",
    "R": "said says say told called calls wrote writes claimed claims according quoted quote quotes reported reports alleged allegedly tweeted shouted insisted sagte behauptete dit disait dijo afirmó",
}
CORE = "IiHhVXl"  # l: a learned stem
STRENGTH = {"I": 1.0, "i": 0.7, "l": 0.3}
THREAT, MODAL = 0.8, 0.8
END = "$"  # of a clause


@dataclass(frozen=True)
class Limits:
    clause_limit: float = 1.6
    score_limit: float = 0.6
    density_limit: float = 0.003


class Transducer:
    """A sequential weighted transducer: ``step(state, symbol)`` gives (state, output symbol, weight); states are hashable, 'o' is any other word."""

    start: object = 0

    def step(self, state: object, symbol: str) -> tuple[object, str, float]:
        raise NotImplementedError


class Negation(Transducer):
    """State: how many words the negator still reaches."""

    reach = 3

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        if symbol == "N":
            return self.reach, symbol, 0.0
        if state and symbol[0] in CORE:
            return state - 1, symbol + "-", 0.0
        return max(0, state - 1), symbol, 0.0


class Reported(Transducer):
    """State: whether a reporting verb has come in this clause."""

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        if symbol == "R":
            return 1, symbol, 0.0
        return state, symbol + "~" if state and symbol[0] in CORE else symbol, 0.0


class Target(Transducer):
    """State: how near the last target and the last unpaired plain insult are. Pairing adds weight."""

    reach, bonus = 4, 0.8
    start = (0, 0)

    def step(self, state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str, float]:
        target, open_ = max(0, state[0] - 1), max(0, state[1] - 1)
        if symbol[0] in "TG":
            return (self.reach, 0), symbol, self.bonus * (open_ > 0) * (1.0 if symbol[0] == "T" else 0.6)
        if symbol in ("I", "i"):
            return ((target, 0), symbol, self.bonus) if target else ((target, self.reach), symbol, 0.0)
        return (target, open_), symbol, 0.0


def mark(symbol: str) -> float:
    """What negation and reported speech leave of a weight."""
    return (0.1 if "-" in symbol else 1.0) * (0.3 if "~" in symbol else 1.0)


class Threat(Transducer):
    """Gives weight and a '!' to the symbol at which a threat is complete (no '!' to a negated one).
    State: how near the last modal and target are; of a verb that lacks its target the words left, its weight and symbol; a weight that the next symbol may still undo, and its symbol."""

    reach = 3
    start = (0, 0, 0, 0.0, "", 0.0, "")

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str, float]:
        modal, target, open_ = (max(0, x - 1) for x in state[:3])
        worth, verb, held, of = state[3:]
        kind, full = symbol[0], (THREAT + MODAL) * mark(symbol)
        weight, whole = (held, "-" not in of) if held and kind != "D" else (0.0, False)
        held, of = 0.0, ""
        if kind == "M":
            modal = self.reach
        elif kind == "H":
            open_, worth, verb = self.reach, full if modal else THREAT * mark(symbol), symbol
        elif kind == "h" and modal:
            open_, worth, verb = 2, full, symbol
        elif (kind == "V" and modal and target) or (kind == "X" and modal):
            weight, whole = weight + full, whole or "-" not in symbol
        elif kind in "TG":
            target = 2
            if open_ and verb[0] == "H":
                weight, whole = weight + worth, whole or "-" not in verb
            elif open_:
                held, of = worth, verb
            open_ = 0
        if not open_:
            worth, verb = 0.0, ""
        return (modal, target, open_, worth, verb, held, of), symbol + "!" * whole, weight


class Scoring(Transducer):
    """Insults by their weight; without a state."""

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return state, symbol, STRENGTH.get(symbol[0], 0.0) * mark(symbol)


class Pairing(Transducer):
    """Passes on what negation, reported speech and threat have marked, with weight where an insult is paired or a threat complete; negated ones pair with nothing.
    State: how near the last target and plain insult are; mild insults so far (3: a strong one or a stem has come); whether a mild one came just before."""

    start = (0, 0, 0, False)

    def step(self, state: tuple[int, int, int, bool], symbol: str) -> tuple[tuple[int, int, int, bool], str, float]:
        target, insult = (max(0, x - 1) for x in state[:2])
        seen, beside = state[2:]
        kind, threat = "o" if "-" in symbol else symbol[0], "!" in symbol
        if kind in "TG":
            return (Target.reach, 0, seen, False), symbol, float(insult > 0 or threat)
        if kind in "Iil":
            mild, plain = kind == "i", "~" not in symbol
            paired = (target > 0 and plain) or seen >= 2 or (seen == 1 and (beside or not mild))
            return (target, Target.reach if plain else insult, min(seen + 1, 3) if mild else 3, mild), symbol, float(paired or threat)
        return (target, insult, seen, False), symbol, float(threat)


class Composed(Transducer):
    """``first`` composed with ``second``: outputs of the one are read by the other, weights add up. Arcs are built once, when first taken."""

    def __init__(self, first: Transducer, second: Transducer) -> None:
        self.first, self.second, self.start = first, second, (first.start, second.start)
        self.arcs: dict[tuple[object, str], tuple[object, str, float]] = {}

    def step(self, state: object, symbol: str) -> tuple[object, str, float]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            a, middle, x = self.first.step(state[0], symbol)
            b, out, y = self.second.step(state[1], middle)
            arc = self.arcs[state, symbol] = (a, b), out, x + y
        return arc


@cache
def grammar() -> Composed:
    return Composed(Composed(Composed(Composed(Negation(), Reported()), Threat()), Target()), Scoring())


@cache
def pairing() -> Composed:
    return Composed(Composed(Composed(Negation(), Reported()), Threat()), Pairing())


def path(g: Transducer, symbols: str) -> tuple[float, object]:
    """Weight of the path that reads the symbols and the clause's end, and the state where it ends."""
    state, total = g.start, 0.0
    for s in symbols + END:
        state, _, w = g.step(state, s)
        total += w
    return total, state


def clause_score(symbols: str) -> float:
    """Score of the symbols of one clause."""
    return path(grammar(), symbols)[0]


def evidence(symbols: str) -> tuple[bool, bool, bool]:
    """Of a clause: whether it counts by itself, whether it holds an insult and whether one that isn't mild."""
    paired, (_, end) = path(pairing(), symbols)
    return paired > 0, end[2] > 0, end[2] == 3


#: Clauses with an insult by word from which insults that are strewn over a document's clauses count.
SCATTERED = 0.006


#: After so many other words no state of the grammar remembers a distance.
MEMORY = 5


@cache
def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    found = {kernel.hash_text(w): s for s, words in LEXICON.items() for w in words.split()}
    keys = np.array(sorted(found), np.uint64)
    return keys, np.array([ord(found[int(k)]) for k in keys], np.uint8)


_END = np.zeros(256, np.uint8)
_END[[*b".!?;\n\r"]] = 1


Stems = dict[int, np.ndarray]  # by length in bytes: sorted hashes of word beginnings


@dataclass(frozen=True)
class Learning:
    """rows: most labelled documents of each class; support, share: toxic documents that a stem needs, by number and of all that are used; again: how often it
    occurs in each of them on average; lift: how much more frequent it is in them."""

    rows: int = 2000
    support: int = 3
    share: float = 0.02
    again: float = 2.0
    lift: float = 10.0
    lengths: tuple[int, ...] = (5, 6, 7, 8)


def beginnings(texts: pa.Array, lengths: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """By row: hashes of the distinct beginnings of words and how often each occurs; a hash of the four least word hashes; words. The length of a beginning is in its hash's lowest 4 bits."""
    n = len(texts)
    least, words = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    keys, counts = [np.zeros(0, np.uint64)] * n, [np.zeros(0, np.int32)] * n
    for at, buf, offs in kernel.slices(texts):
        buf = kernel.plain_apostrophes(buf)
        starts, ends, rows = kernel.spans(buf, offs)
        if not len(starts):
            continue
        hashed = kernel.hasher(kernel.lowered(buf))
        h = hashed(starts, ends)
        order = np.lexsort((h, rows))
        h, r = h[order], rows[order]
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]))
        h, r = h[new], r[new]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        for j in range(4):
            least[at + r[place == j]] = kernel.mix(least[at + r[place == j]] ^ h[place == j])
        words[at : at + len(offs) - 1] = np.bincount(rows, minlength=len(offs) - 1)
        parts = []
        for size in lengths:
            ok = ends - starts >= size
            parts.append((rows[ok], hashed(starts[ok], starts[ok] + size) & ~np.uint64(15) | np.uint64(size)))
        r, k = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        order = np.lexsort((k, r))
        r, k = r[order], k[order]
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])) if len(r) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(r)))
        cuts = np.searchsorted(r[new], np.arange(len(offs)))
        for i in range(len(offs) - 1):
            keys[at + i], counts[at + i] = k[new][cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]].astype(np.int32)
    return keys, counts, least, words


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learning: Learning | None = None) -> Stems:
    """Stems from documents labelled toxic, 1 or 0."""
    g = learning or Learning()
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    sample = None
    for klass in (1, 0):
        part = known.filter(F.col("toxic") == klass).orderBy(F.xxhash64("id"), "id").limit(g.rows)
        sample = part if sample is None else sample.unionAll(part)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "toxic", "text")
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts, least, words = beginnings(batch.column(2), g.lengths)
        lists = [pa.array(x, pa.list_(t)) for x, t in (([k.view(np.int64) for k in keys], pa.int64()), (counts, pa.int32()))]
        out = pa.record_batch([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(least.view(np.int64)), pa.array(words), *lists], ["id", "toxic", "least", "words", "keys", "counts"])
        return out.filter(pa.array(words > 0))

    found = map_batches(chosen, run, f"id {kind}, toxic int, least bigint, words bigint, keys array<bigint>, counts array<int>")
    single = found.groupBy("least", "toxic").agg(F.min_by(F.struct("words", "keys", "counts"), "id").alias("d"))
    each = single.select("toxic", F.explode(F.arrays_zip("d.keys", "d.counts")).alias("k")).select("toxic", F.col("k.keys").alias("key"), F.col("k.counts").alias("n"))
    toxic = F.col("toxic") == 1
    total = single.agg(F.sum(F.when(toxic, F.col("d.words"))).alias("pos"), F.sum(F.when(~toxic, F.col("d.words"))).alias("neg"), F.count_if(toxic).alias("toxic_docs"))
    sums = each.groupBy("key").agg(F.count_if(toxic).alias("docs"), F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("b"))
    lifted = (F.col("a") / F.col("pos")) >= g.lift * (F.col("b") + 1) / F.coalesce("neg", F.lit(1))
    wide = (F.col("docs") >= g.support) & (F.col("docs") >= g.share * F.col("toxic_docs")) & (F.col("a") >= g.again * F.col("docs"))
    rows = sums.filter(F.col("docs") >= g.support).crossJoin(total).filter(wide & lifted).select("key").toPandas()
    keys = np.sort(rows["key"].to_numpy(np.int64).view(np.uint64))
    return {int(size): keys[(keys & np.uint64(15)) == size] for size in np.unique(keys & np.uint64(15))}


def contractions(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The words that are the t of a contracted not: isn't is read as isn and t, and the t negates as not does."""
    t = 1 + np.flatnonzero((ends[1:] - starts[1:] == 1) & (low[starts[1:]] == ord("t")) & (rows[1:] == rows[:-1]))
    before, gap = ends[t - 1], starts[t] - ends[t - 1]
    inside = (low[before] == 39) & (low[starts[t] - 1] == 39) & (low[before + gap // 2] == 39)
    return t[(gap <= 3) & (low[before - 1] == ord("n")) & inside]


def measures(texts: pa.Array, stems: Stems | None = None) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By row: score and greatest clause score of all clauses; score of those that count, the greatest and the number of those that do by themselves, words."""
    keys, symbols = _lexicon()
    n = len(texts)
    total, most, counted, worst, matched, words = (np.zeros(n, t) for t in (float, float, float, float, np.int64, np.int64))
    insulting, grave = np.zeros(n, np.int64), np.zeros(n, bool)
    for at, buf, offs in kernel.slices(texts):
        buf = kernel.plain_apostrophes(buf)
        starts, ends, rows = kernel.spans(buf, offs)
        if not len(starts):
            continue
        words[at : at + len(offs) - 1] = np.bincount(rows, minlength=len(offs) - 1)
        low = kernel.lowered(buf)
        hashed = kernel.hasher(low)
        h = hashed(starts, ends)
        where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[where] == h
        kind = np.where(hit, symbols[where], ord("o")).astype(np.uint8)
        short = contractions(low, starts, ends, rows)
        kind[short], hit[short] = ord("N"), True
        for size, known in (stems or {}).items():
            ok = np.flatnonzero((ends - starts >= size) & ~hit)
            h = hashed(starts[ok], starts[ok] + size) & ~np.uint64(15) | np.uint64(size)
            got = ok[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            kind[got], hit[got] = ord("l"), True
        # What may follow an object only matters right after one.
        after = np.flatnonzero(kind == ord("D"))
        before = kind[np.maximum(after - 1, 0)]
        off = after[(after == 0) | ((before != ord("T")) & (before != ord("G"))) | (rows[np.maximum(after - 1, 0)] != rows[after])]
        kind[off], hit[off] = ord("o"), False
        core = np.isin(kind, np.frombuffer(CORE.encode(), np.uint8))
        if not core.any():
            continue
        clause = np.cumsum(_END[buf])[starts].astype(np.int64) + rows * (len(buf) + 1)
        hot = np.unique(clause[core])
        inside = np.flatnonzero(hit & np.isin(clause, hot))
        cut = np.flatnonzero(np.diff(clause[inside])) + 1
        for part in np.split(inside, cut):
            gaps = np.minimum(np.diff(part) - 1, MEMORY)
            text = chr(kind[part[0]]) + "".join("o" * g + chr(s) for g, s in zip(gaps, kind[part[1:]], strict=True))
            s = clause_score(text)
            if s > 0:
                row = at + rows[part[0]]
                total[row] += s
                most[row] = max(most[row], s)
                paired, insult, strong = evidence(text)
                insulting[row] += insult
                grave[row] |= paired or strong
                if paired:
                    counted[row] += s
                    worst[row] = max(worst[row], s)
                    matched[row] += 1
    strewn = (insulting > 1) & grave & (insulting >= SCATTERED * words - 1e-9)
    return (total, most), (np.where(strewn, total, counted), worst, matched, words)


def scores(texts: pa.Array, stems: Stems | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By row: score of the clauses that count, the greatest and the number of those that do by themselves; words."""
    return measures(texts, stems)[1]


def is_toxic(total: np.ndarray, most: np.ndarray, words: np.ndarray, limits: Limits) -> np.ndarray:
    return (most >= limits.clause_limit - 1e-9) | ((total >= limits.score_limit - 1e-9) & (total >= limits.density_limit * words - 1e-9))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None, stems: Stems | None = None) -> DataFrame:
    """(doc_id, toxic_score, worst_clause, toxic) for every row; the scores are of all clauses, toxic goes by those that count."""
    limits = limits or Limits()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        (total, most), (counted, worst, _, words) = measures(batch.column(1), stems)
        return pa.record_batch([batch.column(0), pa.array(total.round(6)), pa.array(most.round(6)), pa.array(is_toxic(counted, worst, words, limits))], ["doc_id", "toxic_score", "worst_clause", "toxic"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"doc_id {kind}, toxic_score double, worst_clause double, toxic boolean")


def reject(docs: DataFrame, text_col: str = "text", limits: Limits | None = None, stems: Stems | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, columns as they were, in one pass without a shuffle."""
    limits, at = limits or Limits(), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, most, _, words = scores(batch.column(at), stems)
        return batch.filter(pa.array(~is_toxic(total, most, words, limits)))

    return map_batches(docs, run, docs.schema)
