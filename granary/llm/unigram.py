"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their log scores are read from a model file. A file of a merging encoder has no log scores, only the order of its merges; tokenizers aren't trained here,
so its pieces get those of Zipf's law by rank, log p = -log(rank) - log(1 + 1/2 + ... + 1/n), which add up to 1. The trie is a double array over UTF-8 bytes, with the
white-space marker as the one byte 0x20. A text is its units' concatenation: a unit is a run of spaces
with what follows up to the next space or line feed, or a line feed. No piece crosses a unit's edge, which is
proven when the model is read (else whole texts are units), so the best path of a text is that of
its units, and equal units are solved once for a whole slice and remembered. All start positions of all new
units walk the trie at once, and the Viterbi recursion runs over positions for all units at once.

A character that no piece covers gets the lowest normal score less 10 and is written as its byte pieces
(the unknown id if the model has none). Of equal paths the one whose last piece is longer wins.

Defined results: a null or empty text has no pieces and decodes to the empty text; a text of spaces keeps them. The
marker character U+2581 itself reads as a space, the one loss. Every row gives one row, repeated rows and null
doc_ids too; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from granary.llm import kernel
from granary.llm.common import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED, SOLVED = 400_000, 4_000_000  # units kept solved in a worker, and their ids; beyond either they are forgotten, not refused


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i, x, shift = i + 1, x | (c & 127) << shift, shift + 7
        if c < 128:
            return x, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({5: 4, 1: 8}[kind], i)
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
EXACT = 1 << 20  # scores are kept to 20 binary places: sums are exact then, and equal paths are equal whatever goes before them
MERGING = 2  # the type of model whose scores are the order of merges


def read_pieces(model: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, kind) by id, and whether a space goes before each text."""
    pieces, prefix, merges = [], True, False
    for tag, v in _fields(model):
        if tag == 1:
            p = dict(_fields(v))
            pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif tag == 2:
            merges = dict(_fields(v)).get(3) == MERGING
        elif tag == 3:
            rules = dict(_fields(v))
            if rules.get(2) or rules.get(4, 1):
                raise ValueError("only models with identity normalisation that keep white space")
            prefix = bool(rules.get(3, 1))
    return [(text, round(score * EXACT) / EXACT, kind) for text, score, kind in (zipf(pieces) if merges else pieces)], prefix


def zipf(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Normal pieces, best score first, with log-probabilities by rank."""
    order = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: (-pieces[i][1], i))
    score = -np.log(np.arange(1.0, len(order) + 1))
    score -= np.logaddexp.reduce(score) if len(order) else 0.0
    new = dict(zip(order, score.tolist(), strict=True))
    return [(text, new.get(i, old), kind) for i, (text, old, kind) in enumerate(pieces)]


class DoubleArray:
    """Byte trie: the child of node s by byte c is base[s] + c if check there is s. value: piece id or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        keys = sorted(keys)
        free, wide, todo = 256, 256, [(0, 0, len(keys), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(keys[lo][0]) == depth:
                self.value[node] = keys[lo][1]
                lo += 1
            if lo == hi:
                continue
            cuts = [lo] + [i for i in range(lo + 1, hi) if keys[i][0][depth] != keys[i - 1][0][depth]] + [hi]
            codes = np.array([keys[i][0][depth] for i in cuts[:-1]])
            while self.check[free] >= 0:
                free += 1
            # A node with one child takes the first free slot; others look on from where the last one fitted.
            b = (free if len(codes) == 1 else max(free, wide)) - int(codes[0])
            while True:
                if b + 256 >= len(self.check):
                    for name, fill in (("base", 0), ("check", -1), ("value", -1)):
                        old = getattr(self, name)
                        setattr(self, name, np.concatenate([old, np.full(len(old), fill, np.int32)]))
                if (self.check[b + codes] < 0).all():
                    break
                b += 1
            if len(codes) > 1:
                wide = b + int(codes[0])
            self.base[node] = b
            self.check[b + codes] = node
            todo += [(b + int(c), x, y, depth + 1) for c, x, y in zip(codes, cuts, cuts[1:], strict=False)]
        end = int(np.flatnonzero(self.check >= 0).max(initial=0)) + 257
        self.base, self.check, self.value = (getattr(self, n)[:end].copy() if end <= len(self.check) else np.concatenate([getattr(self, n), np.full(end - len(self.check), f, np.int32)]) for n, f in (("base", 0), ("check", -1), ("value", -1)))


class Unigram:
    def __init__(self, model: bytes) -> None:
        pieces, self.prefix = read_pieces(model)
        text = [p.replace(MARK, " ").encode() for p, _, _ in pieces]
        usable = [i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and text[i]]
        self.score = np.array([s for _, s, _ in pieces])
        self.trie = DoubleArray([(text[i], i) for i in usable])
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.unknown_score = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0) - 10
        self.bytes = np.full(256, self.unknown, np.int32)
        self.has_bytes = False
        shown = list(text)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
                self.has_bytes, shown[i] = True, bytes([int(p[3:5], 16)])
            elif kind == CONTROL:
                shown[i] = b""
            elif kind == UNKNOWN:
                shown[i] = " ⁇ ".encode()
        self.cuts = not any(b" " in text[i].lstrip(b" ") or (b"\n" in text[i] and len(text[i]) > 1) for i in usable)
        self.pool = np.frombuffer(b"".join(shown), np.uint8)
        self.width = np.array([len(s) for s in shown], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.where, self.count, self.solved = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def viterbi(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the units at starts..ends, which lie end to end in ``buf``, and the number of each."""
        n, base, check, value = len(buf), self.trie.base, self.trie.check, self.trie.value
        unit = np.repeat(np.arange(len(starts)), ends - starts)
        begin = np.flatnonzero((buf & 0xC0) != 0x80)
        begin = np.union1d(begin, starts)
        char_end = np.append(begin[1:], n)
        stop = ends[unit[begin]]
        char_end = np.minimum(char_end, stop)
        pos, node, src = begin.copy(), np.zeros(len(begin), np.int32), np.arange(len(begin))
        edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(begin), bool)
        while len(pos):
            nxt = base[node] + buf[pos]
            ok = check[nxt] == node
            src, pos, node = src[ok], pos[ok] + 1, nxt[ok]
            got = value[node]
            hit = got >= 0
            edges.append((src[hit], pos[hit], got[hit]))
            single[src[hit & (pos == char_end[src])]] = True
            more = pos < stop[src]
            src, pos, node = src[more], pos[more], node[more]
        lone = np.flatnonzero(~single)
        edges.append((lone, char_end[lone], np.full(len(lone), -1, np.int32)))
        e_src, e_end, e_piece = (np.concatenate([e[i] for e in edges]) for i in range(3))
        e_start = begin[e_src]
        e_score = np.where(e_piece >= 0, self.score[e_piece], self.unknown_score)
        level = e_end - starts[unit[e_start]]
        order = np.lexsort((e_start, e_end, level))
        e_start, e_end, e_piece, e_score, level = e_start[order], e_end[order], e_piece[order], e_score[order], level[order]
        best, back = np.full(n + 1, -np.inf), np.full(n + 1, -1, np.int64)
        opens = np.zeros(n + 1, bool)
        opens[starts] = True
        head = np.flatnonzero(np.concatenate([[True], e_end[1:] != e_end[:-1]]))
        levels = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1], [True]]))
        heads = np.searchsorted(head, levels)
        for k in range(len(levels) - 1):
            lo, hi = levels[k], levels[k + 1]
            h = head[heads[k] : heads[k + 1]]
            s = e_start[lo:hi]
            total = np.where(opens[s], 0.0, best[s]) + e_score[lo:hi]
            top = np.maximum.reduceat(total, h - lo)
            size = np.diff(np.append(h, hi))
            winner = np.where(total == np.repeat(top, size), np.arange(lo, hi), hi)
            # An end that is the next unit's start is not that start: opens covers it when read.
            best[e_end[h]], back[e_end[h]] = top, np.minimum.reduceat(winner, h - lo)
        at, who, depth = ends.copy(), np.arange(len(starts)), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            e = back[at]
            found.append((who, np.full(len(who), -depth), e))
            at, depth = e_start[e], depth + 1
            go = at > starts[who]
            at, who = at[go], who[go]
        f_unit, f_depth, f_edge = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((f_depth, f_unit))
        f_unit, f_edge = f_unit[order], f_edge[order]
        ids = e_piece[f_edge]
        if (ids < 0).any():
            size = np.where(ids < 0, e_end[f_edge] - e_start[f_edge] if self.has_bytes else 1, 1)
            at = np.repeat(np.cumsum(size) - size, size)
            inner = np.arange(int(size.sum())) - at
            raw = self.bytes[buf[np.minimum(np.repeat(e_start[f_edge], size) + inner, n - 1)]]
            wide = np.repeat(ids, size)
            ids, f_unit = np.where(wide < 0, raw, wide), np.repeat(f_unit, size)
        return ids.astype(np.int32), np.bincount(f_unit, minlength=len(starts))

    def units(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the units of a slice."""
        cut = np.zeros(len(buf) + 1, bool)
        cut[offs] = True
        if self.cuts:
            space, line = buf == 32, buf == 10
            cut[:-1] |= line
            cut[1:-1] |= (space[1:] & ~space[:-1]) | line[:-1]
        starts = np.flatnonzero(cut[:-1])
        return starts, np.append(starts[1:], len(buf)), np.searchsorted(offs, starts, "right") - 1

    def solve(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places in the memory of solved units, by unit."""
        h = kernel.span_hashes(buf, starts, ends)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, distinct)
        spot_in = np.minimum(spot, max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[spot_in] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            s, e = starts[first[new]], ends[first[new]]
            size = e - s
            if len(self.known) and (len(self.known) + len(new) > REMEMBERED or len(self.solved) + int(size.sum()) > SOLVED):
                self.forget()
                return self.solve(buf, starts, ends)
            at = np.cumsum(size) - size
            flat = np.arange(int(size.sum())) - np.repeat(at - s, size)
            ids, count = self.viterbi(buf[flat], at, at + size)
            where = len(self.solved) + np.cumsum(count) - count
            self.solved = np.concatenate([self.solved, ids])
            place = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, place, distinct[new])
            self.where, self.count = np.insert(self.where, place, where), np.insert(self.count, place, count)
        return np.searchsorted(self.known, distinct)[inverse]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        offsets, parts = np.zeros(len(texts) + 1, np.int64), []
        for at, buf, offs in kernel.slices(texts, 1 << 20):
            if not len(buf):
                continue
            starts, ends, rows = self.units(buf, offs)
            place = self.solve(buf, starts, ends)
            count, where = self.count[place], self.where[place]
            lead = np.cumsum(count) - count
            parts.append(self.solved[np.arange(int(count.sum())) - np.repeat(lead - where, count)])
            offsets[at + 1 : at + len(offs)] = np.bincount(rows, count, len(offs) - 1)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: markers become spaces, byte pieces bytes, and the leading space goes. Bytes that are no UTF-8 become U+FFFD."""
        offs = np.asarray(lists.offsets, dtype=np.int64)
        ids = lists.values.to_numpy()[offs[0] : offs[-1]]
        width = self.width[ids]
        total = np.concatenate([[0], np.cumsum(width)])
        raw = self.pool[np.arange(total[-1]) + np.repeat(self.first[ids] - total[:-1], width)]
        lo, hi = total[offs[:-1] - offs[0]], total[offs[1:] - offs[0]]
        drop = np.zeros(len(lo), np.int64)
        if self.prefix:
            some = hi > lo
            drop[some] = raw[lo[some]] == 32
        keep = np.ones(len(raw), bool)
        keep[lo[drop > 0]] = False
        ends = np.cumsum(hi - lo - drop)
        out = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[keep]))])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in out.to_pylist()], pa.string())


@cache
def loaded(model: bytes) -> Unigram:
    return Unigram(model)


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(doc_id, pieces, lossless): ids of each text's pieces, and whether decoding them gives the text."""
    model = _model(path)
    if any(len(p.encode()) > 1 << 16 for p, _, _ in read_pieces(model)[0]):
        raise ValueError("a piece is too long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = loaded(model)
        texts, steps = batch.column(1), []
        for lo in range(0, len(texts), 500):
            part = texts.slice(lo, 500)
            ids = m.encode(part)
            steps.append((ids, pc.equal(m.decode(ids), pc.fill_null(part, ""))))
        return pa.record_batch([batch.column(0), pa.concat_arrays([a for a, _ in steps]), pa.concat_arrays([b for _, b in steps])], ["doc_id", "pieces", "lossless"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"doc_id {kind}, pieces array<int>, lossless boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", path: str = MODEL) -> DataFrame:
    """(doc_id, text) of lists of piece ids; a null list gives a null text."""
    model = _model(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        whole = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32())) if lists.null_count else lists
        texts = loaded(model).decode(whole)
        return pa.record_batch([batch.column(0), pc.if_else(pc.is_valid(lists), texts, None)], ["doc_id", "text"])

    kind = encoded.select(id_col).schema[0].dataType.simpleString()
    return map_batches(encoded.select(id_col, pieces_col), run, f"doc_id {kind}, text string")


DECODED_SQL = f"SELECT doc_id, replace(coalesce(text, ''), '{MARK}', ' ') AS text FROM documents"
