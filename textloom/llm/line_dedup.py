"""Line dedup by content-defined chunks of lines.

A window slides along the lines: it ends at a line and reaches back over as few
lines as have ``least_words`` words, two at least. A rolling hash over the
hashes of its lines (the new line comes in, those that fall out are taken off)
depends on them alone, so the same lines have the same hash wherever they
stand. It decides where chunks end: each residue of the hash gives one cut of
the text into chunks of several lines, and no shift of a passage moves a cut
inside it, once a window lies in the passage.

A passage may be too short to hold a whole chunk of a cut, or its lines may
stand in several earlier documents. So the windows are chunks themselves, and
so are those that reach forward: from each line the fewest lines onwards. Each
line of a passage of several lines and ``least_words`` words lies in a window
that lies in the passage, so all of it is found, whatever its lines' lengths and
wherever else they occur. Only lines without words may lie outside. A line of
``solo_words`` words is a passage, and a chunk, by itself.

Chunks are counted over the whole table by hash. Of a chunk that is found twice
or more, the first occurrence (smallest id, then place) stays; every other is
compared with it byte by byte and removed, with the lines without words next to
it in which both agree. A single line of fewer than ``solo_words`` words stays.

Texts are shuffled once, into buckets of bounded size; both passes over the
texts read the same shuffle. What else moves are hashes, counted per bucket
before they are shuffled, and one text for each repeated chunk and bucket. Equal
rows are merged and counted before they are shuffled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, merge_equal, python_on, text_bytes, unused

BUCKET_BYTES = 6 << 20
DIVISOR = 2
SOLO_WORDS = 50
LEAST_WORDS = 16
#: Lines without words before and after a chunk that are compared too, at most.
BEFORE, AFTER = 2, 1
_ODD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def cut_lines(lines: list[bytes], counts: list[int], divisor: int = DIVISOR, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """All chunks (first line, line after the last) of the cuts by each residue; counts: words of each line."""
    ends: list[list[int]] = [[0] for _ in range(divisor)]
    window: deque[tuple[int, int]] = deque()  # hash and words of each line in it; lines without words are left out
    rolled, words = 0, 0
    for i, (line, n) in enumerate(zip(lines, counts)):
        if not n:
            continue
        h = xxhash.xxh64_intdigest(line)
        window.append((h, n))
        rolled = (rolled * _ODD + h) & _ALL
        words += n
        while len(window) > 2 and words - window[0][1] >= least:
            h, n = window.popleft()
            rolled = (rolled - h * pow(_ODD, len(window), 1 << 64)) & _ALL
            words -= n
        if len(window) > 1 and words >= least:
            ends[(rolled >> 32) % divisor].append(i + 1)
    spans = set()
    for e in ends:
        if e[-1] < len(lines):
            e.append(len(lines))
        spans.update(zip(e, e[1:]))
    return sorted(spans)


def stretches(counts: list[int], least: int = LEAST_WORDS) -> set[tuple[int, int]]:
    """The windows: shortest runs of several lines with words that have least words, from each such line on and back from each.

    counts: words of each line.
    """
    at, sums = [], [0]
    for i, n in enumerate(counts):
        if n:
            at.append(i)
            sums.append(sums[-1] + n)
    spans = set()
    k = 1
    for s in range(len(at) - 1):
        k = max(k, s + 1)
        while k < len(at) and sums[k + 1] - sums[s] < least:
            k += 1
        if k == len(at):
            break
        spans.add((at[s], at[k] + 1))
    s = 0
    for k in range(1, len(at)):
        while s + 1 < k and sums[k + 1] - sums[s + 1] >= least:
            s += 1
        if sums[k + 1] - sums[s] >= least:
            spans.add((at[s], at[k] + 1))
    return spans


def chunk_hash(body: bytes) -> int:
    h = xxhash.xxh64_intdigest(body)
    return h - (1 << 64) if h >> 63 else h


Options = tuple[int, int, int]


def _chunks(text: bytes, options: Options) -> tuple[list[bytes], list[tuple[int, int]], list[int]]:
    """Lines, the chunks that can be removed, and their hashes."""
    lines = text.split(b"\n")
    divisor, solo, least = options
    counts = [len(line.split()) for line in lines]
    starts, sums, full = [0], [0], [0]
    for line, n in zip(lines, counts):
        starts.append(starts[-1] + len(line) + 1)
        sums.append(sums[-1] + n)
        full.append(full[-1] + (n > 0))
    spans = stretches(counts, least)
    spans.update((a, b) for a, b in cut_lines(lines, counts, divisor, least) if sums[b] - sums[a] >= least and full[b] - full[a] > 1)
    spans.update((i, i + 1) for i, n in enumerate(counts) if n >= solo)
    spans = sorted(spans)
    return lines, spans, [chunk_hash(text[starts[a] : starts[b] - 1]) for a, b in spans]


def _empty_lines(lines: Iterable[bytes]) -> list[bytes]:
    """The lines up to the first that has words."""
    return list(takewhile(lambda line: not line.split(), lines))


def remove_repeats(text: bytes, row: int, known: dict[int, tuple[int, int, bytes, list[bytes], list[bytes]]], options: Options) -> tuple[bytes, int, int]:
    """What is left of a text, its lines and how many of them went.

    known: for each hash the row and number of its first occurrence, its bytes
    and the lines without words before and after it there.
    """
    lines, spans, hashes = _chunks(text, options)
    gone, stays = [False] * len(lines), [False] * len(lines)
    found = []
    for k, ((a, b), h) in enumerate(zip(spans, hashes)):
        if h not in known:
            continue
        first_row, first_number, body, before, after = known[h]
        if first_row == row and first_number == k:
            stays[a:b] = [True] * (b - a)
        elif b"\n".join(lines[a:b]) == body:
            found.append((a, b, before, after, spans[first_number][1] if first_row == row else 0))
    for a, b, before, after, inside in found:  # inside: where the first occurrence ends, if it is in this text
        for there in reversed(before):
            if not a or (inside and stays[a - 1]) or lines[a - 1] != there:
                break
            a -= 1
        for there in after:
            if b >= len(lines) or (inside and stays[b]) or lines[b] != there:
                break
            b += 1
        a = max(a, inside)  # the first occurrence may overlap this one
        gone[a:b] = [True] * (b - a)
    if not any(gone):
        return text, len(lines), 0
    return b"\n".join(line for line, x in zip(lines, gone) if not x), len(lines), sum(gone)


def dedup_lines(
    df: DataFrame,
    divisor: int = DIVISOR,
    solo_words: int = SOLO_WORDS,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """df with shorter texts, and n_lines and n_removed (which replace columns of these names).

    Lines end at line feeds.
    Every row stays, with an empty text if all its lines were repeats. Null
    texts stay null and have no lines. Null ids come first in the order of
    occurrences. Rows that are equal in id and text are one document and keep
    the same lines. An empty table gives an empty table.
    """
    options = (divisor, solo_words, least_words)
    df = python_on(df).select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_lines", "n_removed")])
    row, bucket, copies, copy = unused(df, "row", "bucket", "copies", "copy")
    buckets = max(1, -(-text_bytes(df, text_col) // bucket_bytes))
    hashed = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    of_row = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    keyed = df.select("*", hashed.alias(row)).withColumn(bucket, of_row(F.col(row)))
    docs = merge_equal(keyed, copies)
    kind = df.schema[id_col].dataType.simpleString()

    def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes, numbers = [], [], []
            for start in range(0, batch.num_rows, 256):
                for i, text in enumerate(batch.column(1).slice(start, 256).to_pylist(), start):
                    for k, h in enumerate(_chunks(text, options)[2]) if text is not None else ():
                        at.append(i)
                        hashes.append(h)
                        numbers.append(k)
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), *[batch.column(c).take(places) for c in (0, 2, 3)], pa.array(numbers, pa.int32())],
                names=["h", "id", "row", "bucket", "number"],
            )

    text = F.col(f"`{text_col}`").cast("binary")
    # from unmerged rows: two Python functions in one task would need twice the memory, and hashes are combined anyway
    listed = keyed.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.col(row).alias("row"), F.col(bucket).alias("bucket"))
    listed = listed.mapInArrow(list_chunks, f"h long, id {kind}, row long, bucket long, number int")
    by_bucket = cut(listed.groupBy("h", "bucket").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "number")).alias("first")))
    repeated = by_bucket.groupBy("h").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    repeated = cut(repeated.select("h", F.col("first.row").alias("first_row"), F.col("first.number").alias("first_number")))

    def read_firsts(key: tuple[pa.Scalar, ...], part: pa.Table, wanted: pa.Table) -> pa.Table:
        asked: dict[int, list[tuple[int, int]]] = {}
        for h, r, k in zip(*[wanted.column(c).to_pylist() for c in ("h", "first_row", "first_number")]):
            asked.setdefault(r, []).append((h, k))
        out: dict[str, list] = {"h": [], "first_row": [], "first_number": [], "body": [], "before": [], "after": []}
        for i in np.flatnonzero(np.isin(part.column(row).to_numpy(), np.array(list(asked), dtype=np.int64))) if asked else ():
            r = part.column(row)[i].as_py()
            if r not in asked:
                continue  # an equal row has been read
            lines, spans, _ = _chunks(part.column(text_col)[i].as_py().encode(), options)
            for h, k in asked.pop(r):
                a, b = spans[k]
                values = (h, r, k, b"\n".join(lines[a:b]), _empty_lines(lines[max(0, a - BEFORE) : a][::-1])[::-1], _empty_lines(lines[b : b + AFTER]))
                for name, value in zip(out, values):
                    out[name].append(value)
        several = pa.list_(pa.binary())
        return pa.table(out, schema=pa.schema([("h", pa.int64()), ("first_row", pa.int64()), ("first_number", pa.int32()), ("body", pa.binary()), ("before", several), ("after", several)]))

    grouped = docs.groupBy(bucket)
    wanted = repeated.withColumn("at", of_row(F.col("first_row"))).groupBy("at")
    firsts = grouped.cogroup(wanted).applyInArrow(read_firsts, "h long, first_row long, first_number int, body binary, before array<binary>, after array<binary>")
    here = by_bucket.select(F.col("h").alias("bh"), F.col("bucket").alias("to"), F.col("n").alias("bn"), F.col("first.row").alias("br"), F.col("first.number").alias("bk"))
    repeats = (F.col("bh") == F.col("h")) & ~((F.col("bn") == 1) & (F.col("br") == F.col("first_row")) & (F.col("bk") == F.col("first_number")))
    sent = here.join(firsts, repeats).drop("bh", "bn", "br", "bk")  # not to a bucket that has the first occurrence alone

    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in (copies, "n_lines", "n_removed")]])
    names = [*df.columns, copies]
    place = names.index(text_col)

    def rewrite(key: tuple[pa.Scalar, ...], part: pa.Table, got: pa.Table) -> pa.Table:
        known = {}
        for h, r, k, *bodies in zip(*[got.column(c).to_pylist() for c in ("h", "first_row", "first_number", "body", "before", "after")]):
            known[h] = (r, k, *bodies)
        texts, n_lines, n_removed = [], [], []
        rows = part.column(row).to_pylist()
        for start in range(0, part.num_rows, 256):
            for r, t in zip(rows[start : start + 256], part.column(text_col).slice(start, 256).to_pylist()):
                left, n, m = (None, 0, 0) if t is None else remove_repeats(t.encode(), r, known, options)
                texts.append(left if left is None else left.decode())
                n_lines.append(n)
                n_removed.append(m)
        part = part.select(names)
        part = part.set_column(place, text_col, pa.array(texts, pa.string()))
        return part.append_column("n_lines", pa.array(n_lines, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))

    out = grouped.cogroup(sent.groupBy("to")).applyInArrow(rewrite, schema)
    return out.select("*", F.explode(F.sequence(F.lit(1), copies)).alias(copy)).drop(copies, copy)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
