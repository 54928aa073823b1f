"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ensure_checkpoint_dir, ship

__all__ = ["cut", "ensure_checkpoint_dir", "id_text", "merge_equal", "power_of_two", "python_on", "text_bytes", "unused", "word_count", "words"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def python_on(df: DataFrame) -> DataFrame:
    """df, in a session whose workers can import this package."""
    ship(df.sparkSession)
    return df


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of the words; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def id_text(column: Column) -> Column:
    """An id as text; a null id is the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a text column: one scalar, summed by the executors."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def power_of_two(n: float) -> int:
    """The smallest power of two that is n or more."""
    return 1 << max(0, int(-(-n // 1)) - 1).bit_length()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like those wanted that clash with none of df's, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        fresh = f"__{name}"
        while fresh.lower() in taken:
            fresh = "_" + fresh
        taken.add(fresh.lower())
        out.append(fresh)
    return out


def merge_equal(df: DataFrame, copies: str) -> DataFrame:
    """df with equal rows of each Arrow batch merged, and how many each stands for in a new column.

    A row that is a third of the table shrinks to one a batch before it is
    shuffled. Rows are told apart by 128 bits of hash over all columns.
    """
    key1, key2 = unused(df, "key1", "key2")
    values = [F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    nulls = F.concat(*[v.isNull().cast("string") for v in values])  # hashes pass over nulls
    keyed = df.select("*", *[F.xxhash64(F.lit(k), nulls, *values).alias(n) for k, n in ((1, key1), (2, key2))])
    schema = T.StructType([*df.schema.fields, T.StructField(copies, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([c.to_numpy() for c in batch.columns[-2:]], axis=1)
            _, first, n = np.unique(keys, axis=0, return_index=True, return_counts=True)
            order = np.argsort(first)
            columns = batch.columns[:-2]
            if len(first) < len(keys):
                at = pa.array(first[order])
                columns = [c.take(at) for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n[order].astype(np.int64))], names=schema.names)
            del batch, columns
            pa.default_memory_pool().release_unused()

    return python_on(keyed).mapInArrow(run, schema)
