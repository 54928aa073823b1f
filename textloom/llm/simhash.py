"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius of 3 bits meet at a point that lies within
half of it of both: one bit from one of them and two from the other. Every
fingerprint emits points around itself, points are shuffled, and fingerprints
that meet are verified and linked.

Not all points of the balls are needed. Bits have two halves, and of three
differing bits two lie in one half. Fingerprints of even weight emit
themselves, all points at two bits of one half, and all at one bit; those of
odd weight emit all points at one bit. Then
  3 bits apart: one is odd; it flips the bit that is alone in its half (or any
                one) and the even one flips the other two;
  2 bits apart: both odd or both even; each flips one of the two;
  1 bit apart:  the odd one flips it and meets the even one itself.
That is 1057 or 64 points instead of 2081.

Points are shuffled by some of their bits. A fingerprint is sent once to each
cell in which it has points, and the cell makes the points; so the shuffle
carries tens of rows for a fingerprint, not a thousand. Cells that hold much
are worked off in parts by further bits. Within a cell, members of a point
are linked to one that is within one bit of it (all of these links hold), so
large groups cost a row a member, and a spanning forest of each cell's links
is all that leaves it. Components over all cells come from star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, python_on, unused

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Points that a cell should make at most at a time.
POINTS_PER_CELL = 1 << 20
#: Points of a fingerprint on average, half of them odd.
MEAN_POINTS = 561
#: Bits that decide on the cell, alternating between the halves.
ROUTE = [b for k in range(16) for b in (2 * k + 1, 32 + 2 * k + 1)]
LEFT = 0xFFFFFFFF


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is set if more than half of the shingles' hashes have it. No words: 0."""
    ws = text.lower().split()
    if not ws:
        return 0
    shingles = map(b" ".join, zip(*(ws[i:] for i in range(k)))) if len(ws) >= k else [b" ".join(ws)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        totals += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * totals > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, fp): fp as a signed long. Keyed, also (key1, key2): see row_keys."""
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, fp long" + ", key1 long, key2 long" * keyed
    names = ["doc_id", "fp", "key1", "key2"][: 4 if keyed else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                out += [fingerprint(b or b"") for b in batch.column(1).slice(at, 256).to_pylist()]
            fps = np.array(out, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=names)

    read = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text")]
    if keyed:
        read += [k.alias(n) for k, n in zip(row_keys(id_col, text_col), names[2:])]
    return python_on(df).select(*read).mapInArrow(run, schema)


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes of id and text, 128 bits together: rows that share them are equal in both."""
    both = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return F.xxhash64(F.lit(1), *both), F.xxhash64(F.lit(2), *both)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _routes(bits: list[int]) -> tuple[list[int], list[int]]:
    """What a fingerprint's points can differ by in the routing bits: at most one bit, and two of one half."""
    one = [0, *(1 << b for b in bits)]
    two = [1 << a | 1 << b for a, b in combinations(bits, 2) if (a < 32) == (b < 32)]
    return one, two


def _flips(difference: int, route: int) -> tuple[list[int], list[int]]:
    """Flips of one bit and of two of one half that make the difference in the routing bits and any elsewhere."""
    free = [b for b in range(64) if not route >> b & 1]
    weight = difference.bit_count()
    if weight == 0:
        return [1 << b for b in free], [1 << a | 1 << b for a, b in combinations(free, 2) if (a < 32) == (b < 32)]
    if weight == 1:
        left = difference <= LEFT
        return [difference], [difference | 1 << b for b in free if (b < 32) == left]
    return [], [difference]


def _links(fps: np.ndarray, route: int, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in fps that meet in the cell: members of a point with one within one bit of it."""
    differ = (fps ^ np.uint64(cell)) & np.uint64(route)
    odd = np.bitwise_count(fps) % 2 == 1
    near_points, near_owner, far_points, far_owner = [], [], [], []
    for d in np.unique(differ[np.bitwise_count(differ) <= 2]):
        d = int(d)
        if d.bit_count() == 2 and not (d <= LEFT or d & LEFT == 0):
            continue
        here = np.flatnonzero(differ == np.uint64(d))
        even = here[~odd[here]]
        one, two = (np.array(x, dtype=np.uint64) for x in _flips(d, route))
        if d == 0 and len(even):
            near_points.append(fps[even])
            near_owner.append(even)
        if len(one):
            near_points.append((fps[here][:, None] ^ one).ravel())
            near_owner.append(np.repeat(here, len(one)))
        if len(two) and len(even):
            far_points.append((fps[even][:, None] ^ two).ravel())
            far_owner.append(np.repeat(even, len(two)))
    if not near_points:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near = sum(map(len, near_points))
    points = np.concatenate(near_points + far_points)
    owner = np.concatenate(near_owner + far_owner).astype(np.int64)
    order = np.argsort(points, kind="stable")  # of equal points, those within one bit come first
    points = points[order]
    first = np.flatnonzero(np.concatenate(([True], points[1:] != points[:-1])))
    run = np.diff(np.append(first, len(points)))
    centre_at = np.repeat(first, run)
    linked = (np.arange(len(points)) != centre_at) & (order[centre_at] < near)
    a, b = owner[order[centre_at[linked]]], owner[order[linked]]
    holds = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
    pairs = np.unique(a[holds] * len(fps) + b[holds])
    return pairs // len(fps), pairs % len(fps)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each place is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def cell_links(fps: np.ndarray, bits: list[int], cell: int, most: int = POINTS_PER_CELL) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, fingerprint it is connected to) of all links that meet in the cell."""
    fps = np.unique(fps)
    more = max(0, min(len(ROUTE) - len(bits), int(np.ceil(np.log2(max(1, len(fps) * MEAN_POINTS / 2 / most))))))
    extra = ROUTE[len(bits) : len(bits) + more]
    label = np.arange(len(fps))
    for part in range(1 << more):
        route = sum(1 << b for b in bits + extra)
        inner = cell | sum(1 << b for k, b in enumerate(extra) if part >> k & 1)
        here = np.flatnonzero(np.bitwise_count((fps ^ np.uint64(inner)) & np.uint64(route)) <= 2)
        a, b = _links(fps[here], route, inner)
        old = np.flatnonzero(label != np.arange(len(fps)))
        label = _forest(len(fps), np.concatenate((here[a], old)), np.concatenate((here[b], label[old])))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def near_links(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join up all within the radius of each other."""
    t = max(0, min(24, int(np.ceil(np.log2(max(1, n_nodes * MEAN_POINTS / POINTS_PER_CELL))))))
    bits = ROUTE[:t]
    route = sum(1 << b for b in bits)
    one, two = _routes(bits)
    array = lambda xs: F.array(*[F.lit(_signed(x)).cast("long") for x in xs])
    even = F.bit_count("fp") % 2 == 0
    sent = nodes.select("fp", F.explode(F.when(even, array(one + two)).otherwise(array(one))).alias("d"))
    sent = sent.select("fp", F.col("fp").bitwiseAND(F.lit(_signed(route))).bitwiseXOR(F.col("d")).alias("cell"))

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        fps = part.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = cell_links(fps, bits, key[0].as_py() & (1 << 64) - 1)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return python_on(sent).groupBy("cell").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the links, by large-star and small-star contraction.

    Minima are combined before each shuffle and joined back, so that a node
    with very many links is dealt out by Spark's skew join.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _rooted(nodes: DataFrame) -> DataFrame:
    """nodes (one row a fingerprint) with the root of each one's component."""
    found = components(near_links(nodes.select("fp"), nodes.count()))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "fp").alias("root"))


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of df: doc_id, fp (signed), fingerprint (16 hexadecimal digits), component_id.

    ``component_id`` is the smallest id that links reach, the row's own
    included. Null and empty texts have fingerprint 0 and are linked like
    others. Null ids are no component's smallest id, unless all its ids are
    null. Rows with equal ids are looked at each for itself. Other columns are
    not read. An empty table gives an empty table.
    """
    fps = cut(fingerprints(df, id_col, text_col))
    rooted = _rooted(cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: that of the smallest id, null ids last.

    Of rows that share the smallest id, that of one text stays; of rows that
    are equal in id and text, any one. Ids decide nothing else, so rows that
    share an id or have none, and are nobody's near copies, all stay. An empty
    table gives an empty table.

    Texts are shuffled once: rows equal in id and text become one row before
    they are shuffled, by keys that also find the rows that stay.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key1", "key2")
    nodes = cut(fingerprints(df, id_col, text_col, keyed=True).groupBy("fp").agg(F.min(first).alias("first")))
    key1, key2, stay1, stay2 = unused(df, "key1", "key2", "stay1", "stay2")
    stay = _rooted(nodes).groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.key1").alias(stay1), F.col("first.key2").alias(stay2))
    keys = row_keys(id_col, text_col)
    rows = df.select("*", keys[0].alias(key1), keys[1].alias(key2)).dropDuplicates([key1, key2])
    return rows.join(stay, (F.col(key1) == F.col(stay1)) & (F.col(key2) == F.col(stay2)), "left_semi").drop(key1, key2)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", "fingerprint", "component_id")
