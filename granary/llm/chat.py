"""Chat formatting at token level.

Each turn becomes: the reserved id of its role, the ids of its content, the reserved id of an end of turn;
a conversation starts with one more reserved id. Contents are encoded apart from each
other and never see reserved ids, so nothing in a content can become one. Control strings that occur in a
content are escaped besides, reversibly: ``<|name|>`` becomes ``<|\\name|>``, and so on by one
backslash more. Reserved ids are spliced in by offsets, and the loss mask, 1 on assistant contents and
their ends, is a prefix sum over its edges.

Defined results: turns go in order of turn, role and text, nulls first; repeated rows are kept, as turns of
their own. A null role, or one not known, gets the id of "other". A null or empty content is a turn without
content. Rows without a conv_id belong to no conversation and give nothing. Other columns are ignored. An empty
table gives an empty table.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ROLES = ("system", "user", "assistant", "tool", "other")
START, END = "<|start|>", "<|end|>"

_control = re.compile(r"<\|(\\*[A-Za-z_]+\|>)")
_escaped = re.compile(r"<\|\\(\\*[A-Za-z_]+\|>)")


def escape(content: str) -> str:
    return _control.sub(r"<|\\\1", content)


def unescape(content: str) -> str:
    return _escaped.sub(r"<|\1", content)


def reserved(size: int) -> dict[str, int]:
    """Reserved ids, above a vocabulary of ``size`` ids."""
    return {name: size + i for i, name in enumerate((START, END, *ROLES))}


@cache
def tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    return t


def assemble(turns: list[list[tuple[str | None, str | None]]], spec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of conversations of (role, content), end to end, and the offset of each."""
    t = tokenizer(spec)
    own = reserved(t.get_vocab_size(with_added_tokens=True))
    flat = [turn for conv in turns for turn in conv]
    encoded = [e.ids for e in t.encode_batch([escape(c or "") for _, c in flat], add_special_tokens=False)] if flat else []
    lens = np.array([len(e) for e in encoded], np.int64)
    per = np.array([len(c) for c in turns], np.int64)
    # Each turn takes its content and two more; each conversation one more, before its first turn.
    conv_of = np.repeat(np.arange(len(turns)), per)
    at = np.concatenate([[0], np.cumsum(lens + 2)[:-1]]).astype(np.int64)[: len(flat)] + conv_of + 1
    size = int((lens + 2).sum()) + len(turns)
    body = np.concatenate([[0], np.cumsum(lens + 2)])
    first = np.concatenate([[0], np.cumsum(per)])
    offsets = body[first] + np.arange(len(turns) + 1)
    ids = np.empty(size, np.int32)
    spliced = np.zeros(size, bool)
    spliced[offsets[:-1]] = spliced[at] = spliced[at + lens + 1] = True
    ids[offsets[:-1]] = own[START]
    ids[at] = [own.get(r, own["other"]) if r in ROLES else own["other"] for r, _ in flat]
    ids[at + lens + 1] = own[END]
    ids[~spliced] = np.fromiter((i for e in encoded for i in e), np.int32, int(lens.sum()))
    says = np.array([r == "assistant" for r, _ in flat], bool)
    edges = np.zeros(size + 1, np.int32)
    edges[at[says] + 1] += 1
    edges[at[says] + lens[says] + 2] -= 1
    return ids, np.cumsum(edges[:-1], dtype=np.int32), offsets


def parse(ids: list[int], spec: str) -> list[tuple[str, str]]:
    """The (role, content) turns of one formatted conversation."""
    t = tokenizer(spec)
    names = {i: n for n, i in reserved(t.get_vocab_size(with_added_tokens=True)).items()}
    out, role, content = [], "", []
    for i in ids:
        name = names.get(i)
        if name == END:
            out.append((role, unescape(t.decode(content, skip_special_tokens=False))))
        elif name in ROLES:
            role, content = name, []
        elif name is None:
            content.append(i)
    return out


def format_chats(turns: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(conv_id, input_ids, loss_mask) of each conversation of rows (conv_id, turn, role, text)."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        convs = [[(x["role"], x["text"]) for x in c] for c in batch.column(1).to_pylist()]
        ids, mask, offsets = assemble(convs, spec)
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in (ids, mask)]
        return pa.record_batch([batch.column(0), *lists], ["conv_id", "input_ids", "loss_mask"])

    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", "role", "text").alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = turns.select("conv_id").schema[0].dataType.simpleString()
    return map_batches(grouped, run, f"conv_id {kind}, input_ids array<int>, loss_mask array<int>")
