"""Exact nearest neighbours by a block matrix join of int8 tiles.

Vectors are rounded to int8 with a scale each. For x = s q + e the product of
two vectors differs from that of their int8 forms by at most
|s q| |e'| + |e| |y|, so each tile of int8 products bounds all true products.
Candidates whose upper bound falls below a query's k-th best lower bound (or
below what the query has found already) cannot be among its nearest; only the
others are computed again from the original numbers, in double precision, and
go through a heap.

Equal vectors are searched once: all rows of one vector become an entry with its
smallest ids, as many as can matter. So a vector that very many rows share costs
one column of a tile, and its rows are cut to those ids before they are
shuffled. Queries with equal vectors are one query until the end, where each
takes its own row out of what was found.

Queries and candidates are cut into blocks by hash. A task joins one block of
queries with one strip of candidates of the same length, works them off tile by
tile with one heap a query, and returns its best; a last window merges strips.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, python_on

#: Queries of a block and candidates of a strip, fewer if vectors are long, and the numbers that each holds at most.
#: Candidates are sent once to each block and queries once to each strip, so both are large.
QUERY_ROWS, QUERY_NUMBERS = 8192, 1 << 20
STRIP_ROWS, STRIP_NUMBERS = 32768, 1 << 22
#: Rows of a tile's two sides.
TILE_QUERIES = 512
TILE_ROWS = 4096
#: Components that are multiplied at a time: sums of so many int8 products are exact in single precision.
EXACT_COMPONENTS = 1024
#: Numbers that are recomputed at a time.
RECOMPUTED = 1 << 21


def usable(vector: Column) -> Column:
    """No null vector or component, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of s q and of e."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / np.where(scale > 0, scale, 1.0)[:, None])
    rounded = q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((rounded**2).sum(axis=1)), np.sqrt(((x - rounded) ** 2).sum(axis=1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two int8 matrices. Exact: each stretch of components fits single precision, stretches are added in double."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_COMPONENTS):
        out += a[:, at : at + EXACT_COMPONENTS].astype(np.float32) @ b[:, at : at + EXACT_COMPONENTS].astype(np.float32).T
    return out


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def search_strip(queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int, tile_rows: int = TILE_ROWS) -> tuple[list[int], list[int], list[int], list[float]]:
    """The k rows nearest to each query: query places, vector places, row ids, scores.

    ids: of each vector the ids of its rows in order, the k smallest at least. Ties go to smaller ids.
    """
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in queries]
    best = np.full(len(queries), -np.inf)  # the k-th found so far
    qq, qs, qn, qe = quantise(queries)
    q_norm = np.sqrt((queries**2).sum(axis=1))
    step = max(1, RECOMPUTED // max(1, queries.shape[1]))
    for at in range(0, len(vectors), tile_rows):
        y = vectors[at : at + tile_rows]
        yq, ys, yn, ye = quantise(y)
        product = int8_products(qq, yq) * qs[:, None] * ys
        error = (qn[:, None] * ye + qe[:, None] * np.sqrt((y**2).sum(axis=1))) * (1 + 1e-9) + 1e-12 * q_norm[:, None] * yn
        least = best
        if len(y) >= k:
            least = np.maximum(best, np.partition(product - error, len(y) - k, axis=1)[:, len(y) - k])
        a, b = np.nonzero(product + error >= least[:, None])
        for part in range(0, len(a), step):
            i, j = a[part : part + step], b[part : part + step]
            for query, place, score in zip(i.tolist(), (j + at).tolist(), exact(queries[i], y[j]).tolist()):
                heap = heaps[query]
                for found in ids[place]:
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -found, place))
                    elif (score, -found) > heap[0][:2]:
                        heapq.heapreplace(heap, (score, -found, place))
                    else:
                        break  # the vector's other ids are larger
        best = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    rows = [(i, place, -found, score) for i, heap in enumerate(heaps) for score, found, place in heap]
    return tuple(map(list, zip(*rows))) or ([], [], [], [])


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of largest inner product, for each row where is_query holds.

    Every row but the query's own is a candidate, those that share its id or
    its vector too. Rows with equal ids are queries and candidates each for
    itself, so an id may be asked for or found several times. Vectors of each
    length are searched among their like. Vectors that are null, zero, or hold
    null or non-finite components take no part, nor do rows without an id. A
    query without candidates gives no row. Other columns are not read. An
    empty table gives an empty table.
    """
    most = k + 1  # the query's own row may be among them
    v = F.col("v")
    rows = python_on(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(usable(v) & F.col("id").isNotNull())
    rows = rows.select("id", "v", "q", F.size(v).alias("d"), F.xxhash64(F.lit(1), v).alias("k1"), F.xxhash64(F.lit(2), v).alias("k2"))
    key = ["d", "k1", "k2"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    smallest = rows.select("id", "v", *key).withColumn("place", place).where(F.col("place") <= most)
    entries = cut(smallest.groupBy(*key).agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    askers = rows.where("q").select("id", *key)
    asked = cut(askers.select(*key).distinct().join(entries.select(*key, "v"), key))

    def parts(table: DataFrame, rows_at_most: int, numbers: int) -> int:
        n, total = table.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
        return max(1, -(-n // rows_at_most), -(-total // numbers))

    blocks, strips = parts(asked, QUERY_ROWS, QUERY_NUMBERS), parts(entries, STRIP_ROWS, STRIP_NUMBERS)
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    at = lambda c, m: F.pmod(F.col(c), F.lit(m)).cast("int")
    left_side = asked.select(*key, "v", at("k1", blocks).alias("block"), each(strips).alias("strip"))
    right_side = entries.select(*key, "v", "ids", at("k2", strips).alias("strip"), each(blocks).alias("block"))

    def matrix(part: pa.Table, d: int) -> np.ndarray:
        return part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, d)

    out_schema = "d int, k1 long, k2 long, vec_id long, score double, same boolean"

    def run(group: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        d = group[0].as_py()
        out: list[list] = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            queries, vectors, ids = matrix(left, d), matrix(right, d), right.column("ids").to_pylist()
            asking, given = (list(zip(t.column("k1").to_pylist(), t.column("k2").to_pylist())) for t in (left, right))
            for first in range(0, len(queries), TILE_QUERIES):
                for i, j, found, score in zip(*search_strip(queries[first : first + TILE_QUERIES], vectors, ids, most)):
                    for column, value in zip(out, (*asking[first + i], found, score, asking[first + i] == given[j])):
                        column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        columns = [pa.array(c, t) for c, t in zip(out, kinds)]
        return pa.table([pa.array([d] * len(out[0]), pa.int32()), *columns], names=["d", "k1", "k2", "vec_id", "score", "same"])

    tiles = left_side.groupBy("d", "block", "strip").cogroup(right_side.groupBy("d", "block", "strip")).applyInArrow(run, out_schema)
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id", "same"))
    merged = tiles.withColumn("place", best).where(F.col("place") <= most)
    lists = merged.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("found"))
    own = F.array_position(F.transform("found", lambda x: x["same"] & (x["vec_id"] == F.col("id"))), True)
    others = F.slice(F.filter("found", lambda x, i: i + 1 != F.col("own")), 1, k)
    got = askers.join(lists, key).withColumn("own", own)
    got = got.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return got.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


#: DuckDB SQL for the rows of op10. Rows are told apart by number, since ids may repeat.
NEAREST_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e, len(embedding) AS d FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.n <> c.n AND q.d = c.d WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
