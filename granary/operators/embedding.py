"""Embedding by a pluggable encoder, with provenance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text as t
from granary.runtime import ship

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 384) -> Encoder:
    """Signed hashing of words by MD5: deterministic, needs no model, and says little about meaning."""
    places: dict[str, tuple[int, int]] = {}

    def place(w: str) -> tuple[int, int]:
        if len(places) > 500_000:
            places.clear()
        h = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:15], 16)
        places[w] = out = h % dim, 1 - 2 * (h // dim % 2)
        return out

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            if found := [places.get(w) or place(w) for w in text.lower().split()]:
                at, sign = zip(*found, strict=True)
                row += np.bincount(at, sign, dim)
        return out

    return encode


def embed(docs: DataFrame, encoder: Callable[[], Encoder] = hashing_encoder, model: str = "hashing", version: str = "1", normalize: bool = True, now: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch: int = 32, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, embedding, model, version, embedded_at, preprocessing_hash), and the columns ``keep``. ``encoder`` is called once a task, as a model is loaded once."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *docs.select(*keep).schema.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for b in batches:
            texts = b["__ready"].fillna("").tolist()
            v = np.concatenate([encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]) if texts else np.zeros((0, 1))
            if normalize:
                v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)
            yield pd.DataFrame({"doc_id": b["__id"], "embedding": list(v.astype(np.float32)), **{c: b[c] for c in keep}})

    ready = docs.select(F.col(id_col).cast("string").alias("__id"), t.preprocess(text_col).alias("__ready"), *keep)
    vectors = ready.mapInPandas(run, schema)
    stamp = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return vectors.select("*", F.lit(model).alias("model"), F.lit(version).alias("version"), stamp.alias("embedded_at"), t.preprocessing_hash(model, normalize, version).alias("preprocessing_hash"))
