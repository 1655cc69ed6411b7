"""Token counts with a whole-token shortcut.

Offline, each string of a byte-level BPE vocabulary is merged from its bytes by the vocabulary's
own ranks and cut by the pre-tokenizer; it is proven if it stays one pre-token and ends as
the one token of its rank. A text's pre-tokens that are proven strings count as one token each by
a dictionary lookup; only the others are merged.

Defined results: null and empty texts have 0 tokens; strings of special tokens are ordinary text;
every row gives one row, repeated rows and null doc_ids too; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY = 300_000  # remembered counts of merged pre-tokens in a worker; beyond it they are forgotten, not refused
LONG = 64  # characters of a pre-token from which it is merged each time, so that what is remembered stays under some 80 MB
MERGED = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one pre-token: the adjacent pair of least rank merges first, the leftmost of equals; a heap keeps it n log n."""
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if not part[i] or after[i] != j or not part[j] or len(part[i]) + len(part[j]) != size:
            continue
        part[i] += part[j]
        part[j] = b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, b, len(part[a]) + len(part[b])))
    return [p for p in part if p]


def proven(ranks: dict[bytes, int], pattern: str = PATTERN) -> list[str]:
    """The vocabulary's strings that, alone, are one pre-token and encode as one token."""
    import regex

    cut = regex.compile(pattern)
    found = []
    for token in ranks:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if (m := cut.match(text)) and m.end() == len(text) and merge(token, ranks) == [token]:
            found.append(text)
    return found


class Counts(dict):
    """Tokens by pre-token: 1 for proven strings; others are merged when first met and carry MERGED on top."""

    def __init__(self, whole: list[str], ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import tiktoken

        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.limit = whole, len(whole) + MEMORY
        self.pieces = regex.compile(pattern).findall
        self.engine = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.engine._encode_single_piece(piece)) + MERGED
        if len(piece) < LONG:
            self[piece] = n
        return n

    def count(self, text: str | None) -> tuple[int, int]:
        """Tokens, and pre-tokens that had to be merged."""
        if not text:
            return 0, 0
        total = 0
        for lo in range(0, len(pieces := self.pieces(text)), self.limit):
            total += sum(map(self.__getitem__, pieces[lo : lo + self.limit]))
            if len(self) > self.limit:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
        return total % MERGED, total // MERGED


@cache
def _counts(whole: str, blob: bytes, pattern: str) -> Counts:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    return Counts(whole.split("\0"), ranks, pattern)


@cache
def _offline(path: str, pattern: str) -> tuple[str, bytes]:
    with open(path, "rb") as f:
        blob = f.read()
    return "\0".join(proven(read_ranks(path), pattern)), blob


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, n_merged): tokens of each text, and how many of its pre-tokens had to be merged."""
    whole, blob = _offline(path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _counts(whole, blob, pattern)
        found = [c.count(t.as_py()) for t in batch.column(1)]
        return pa.record_batch([batch.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["doc_id", "n_tokens", "n_merged"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"doc_id {kind}, n_tokens bigint, n_merged bigint")
