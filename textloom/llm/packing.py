"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents are tokenised once, in Arrow batches, into pieces; only numbers go
on. Packing is bulk-synchronous best fit. Pieces are sorted by length and open
sequences by gap. Each superstep takes the longest unplaced length, sweeps to
its successor among the gaps (the smallest that is large enough), hands gaps
to pieces by rank, so no two claim one gap, updates the gaps and repeats; what
finds no gap opens sequences.

Pieces of one length are interchangeable, and so are gaps of one size. A
superstep therefore moves runs of ranks: its state is at most ``capacity``
lengths and gap sizes with counts, whatever the number of documents, and it
costs no job. The executors rank the pieces within each length (in cells of
the hash range, so a length that most pieces share is spread out) and look up
the run that holds a rank.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, power_of_two, python_on

CAPACITY = 1024
END_ID = 2
ROWS_PER_CELL = 4096
#: Texts without these need no look-ahead: no run of white space, Latin only.
_NEEDS_LOOKAHEAD = re.compile(r"\s\s|[^\x00-ɏ]")
_LOOKAHEAD = r"\s+(?!\S)|"


class Encoder:
    """Ids of the byte-level vocabulary, as the tokenizers library gives them.

    The ranks of the same vocabulary give the same ids several times faster.
    Where no white space runs on, the pattern's look-ahead matches nothing that
    its last branch doesn't, so it is left out. A text that spells a special
    token goes through the tokenizers library itself.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path(f"{vocabulary}.json")
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pattern = public_tokenizers.PATTERN
        make = lambda name, p: tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
        self.full = make("full", pattern)
        self.plain = make("plain", pattern.replace(_LOOKAHEAD, "")) if _LOOKAHEAD in pattern else self.full
        self.special = None
        self.slow = None

    def _library(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json)
            self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        return self.slow

    def encode(self, text: str) -> list[int]:
        if "<" in text:
            slow = self._library()
            if any(s in text for s in self.special):
                return slow.encode(text, add_special_tokens=False).ids
        return (self.full if _NEEDS_LOOKAHEAD.search(text) else self.plain).encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def tokenized_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32. The first piece is the short one."""
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    )

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for at in range(0, batch.num_rows, 256):
                for i, text in enumerate(batch.column(1).slice(at, 256).to_pylist(), at):
                    ids = enc.encode(text or "")
                    ids.append(end_id)
                    packed = np.array(ids, dtype="<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k in range(len(edges) - 1):
                        row.append(i)
                        piece.append(k)
                        start.append(edges[k])
                        length.append(edges[k + 1] - edges[k])
                        crc.append(zlib.crc32(packed[edges[k] : edges[k + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=schema.names,
            )

    return python_on(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut_up, schema)


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Supersteps over lengths: rows (length, first rank, number of ranks, first sequence, offset).

    ``counts`` has the number of pieces of each length. Gaps hold runs of
    sequence numbers. A superstep splits one run at most for each run that it
    takes, so there are no more than about capacity squared rows at worst.
    """
    gaps: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []  # of gaps, sorted
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = deque()
                insort(sizes, size)
            held = gaps[size]
            if held and held[-1][0] + held[-1][1] == first:
                held[-1] = (held[-1][0], held[-1][1] + n)
            else:
                held.append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (k := bisect_left(sizes, length)) < len(sizes):
            size = sizes[k]
            first, n = gaps[size].popleft()
            taken = min(n, left)
            if taken < n:
                gaps[size].appendleft((first + taken, n - taken))
            elif not gaps[size]:
                del gaps[size], sizes[k]
            runs.append((length, rank, taken, first, capacity - size))
            leave(size - length, first, taken)
            rank, left = rank + taken, left - taken
        if left:
            fit = capacity // length
            full, rest = divmod(left, fit)
            for layer in range(fit):
                n = full + (layer < rest)
                if n:
                    runs.append((length, rank, n, opened, layer * length))
                    rank += n
            leave(capacity - fit * length, opened, full)
            if rest:
                leave(capacity - rest * length, opened + full, 1)
            opened += full + (rest > 0)
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with sequence_id and offset. pieces: doc_id, piece, start, length, ids_crc32, already materialised."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = best_fit_runs(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    slices = power_of_two(min(4096, max(1, sum(counts.values()) / ROWS_PER_CELL)))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    cells = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    along = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "slice", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = sliced.withColumn("r", F.row_number().over(within)).join(cells, ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    step = 1 << 44
    keys = runs[:, 0] * step + runs[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = runs[np.searchsorted(keys, length * step + rank, side="right") - 1]
            columns = batch.columns[:5] + [pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return python_on(ranked).mapInArrow(look_up, ranked.schema)


def pack_documents(
    df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty, and an empty document is one piece that holds
    the end id alone. Only documents longer than ``capacity`` are cut; all
    pieces of one but the first are full. Rows with equal ids are packed each
    for itself. Other columns are not read. An empty table gives no pieces.
    """
    return place(cut(tokenized_pieces(df, id_col, text_col, capacity, end_id, vocabulary)), capacity)


def op7_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
