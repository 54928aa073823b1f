"""Dense vectors of texts from a pluggable encoder, in batches that adapt to memory."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

Encoder = Callable[[list[str]], np.ndarray]


def adaptive_batches(texts: list[str], encode: Encoder, batch: int) -> np.ndarray:
    """Encode in batches; halve the batch when memory runs out, double it up to ``batch`` after success."""
    out, at, size = [], 0, batch
    while at < len(texts):
        try:
            out.append(np.asarray(encode(texts[at : at + size]), dtype=float))
        except MemoryError:
            if size == 1:
                raise
            size //= 2
            continue
        at += size
        size = min(batch, size * 2)
    return np.vstack(out) if out else np.empty((0, 0))


def hashing_encoder(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in without a model: signed counts of hashed words."""
    words = [" ".join(text.lower().split()).encode().split() for text in texts]
    h = np.array([zlib.crc32(w) for ws in words for w in ws], np.int64)
    row = np.repeat(np.arange(len(texts)), np.array([len(ws) for ws in words], np.int64))
    return np.bincount(row * dim + h % dim, weights=(h >> 16 & 1) * 2.0 - 1, minlength=len(texts) * dim).reshape(len(texts), dim)


def embed(
    docs: DataFrame, make_encoder: Callable[[], Encoder] = lambda: hashing_encoder, batch: int = 16, id_col: str = "id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, vector) with vectors of length one, and the columns to carry. ``make_encoder`` runs once a task, so a model is loaded once a task; null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for rows in batches:
            vectors = adaptive_batches([t or "" for t in rows.column(1).to_pylist()], encode, batch)
            norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
            unit = (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)
            ends = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1])
            others = [rows.column(i) for i in range(2, rows.num_columns)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(ends, pa.array(unit.ravel())), *others], names=["id", "vector", *carry])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *carry)
    out = T.StructType([rows.schema["id"], T.StructField("vector", T.ArrayType(T.FloatType())), *[rows.schema[c] for c in carry]])
    return rows.mapInArrow(run, out)
