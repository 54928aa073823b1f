"""Dense and sparse top-k search, rank fusion, reranking and result records.

Every ranking has a total order: score descending, then id. Scores that decide
on ranks are rounded, so that the order doesn't hang on the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

DIGITS = 9
RRF_K = 60
MISSING_RANK = 1_000_000_000
PREFETCH, FINAL = 50, 5
#: Queries that are sent to all executors at most, and entries of sparse ones; more are searched in blocks, over strips of so many documents.
BROADCAST_QUERIES, BROADCAST_POSTINGS = 2048, 1 << 21
STRIP_ROWS = 32768
#: Scores that are held at a time.
SCORES = 1 << 20


def top_k(hits: DataFrame, k: int, by: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best of each query, with rank. Spark cuts to k before it shuffles."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.col(item))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalised(vector: Column) -> Column:
    """Length one; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dense_hits(vectors: DataFrame, queries: DataFrame, k: int = PREFETCH) -> DataFrame:
    """(query_id, doc_id, score, rank): cosine of (doc_id, vector) with (query_id, vector), exact, top k.

    Up to BROADCAST_QUERIES queries go to the executors as one matrix, after
    their number has been checked; each batch of vectors keeps its k best. More
    queries are dealt into blocks, and vectors into strips, and searched block
    by strip.
    """

    def search(ids: np.ndarray, q: np.ndarray, doc_ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(ids), 64):
            scores = np.zeros((min(64, len(ids) - at), len(v)))
            for j in range(v.shape[1]):
                scores += q[at : at + 64, j][:, None] * v[:, j]
            scores = np.round(scores / (_norms(q[at : at + 64])[:, None] * _norms(v)), DIGITS)
            rows.append(_k_best(scores, ids[at : at + 64], doc_ids, k))
        return _hits(rows)

    ship(vectors.sparkSession)
    given = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("q_vector"))
    blocks = max(1, -(-queries.count() // BROADCAST_QUERIES))
    if blocks == 1:
        got = asked.collect()
        ids = np.array([r["query_id"] for r in got], dtype=np.int64)
        q = np.array([r["q_vector"] for r in got], dtype=float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield search(ids, q, batch.column(0).to_numpy(), _matrix(batch.column(1)))

        return top_k(given.mapInArrow(run, HITS), k)
    pair = lambda left, right: search(left.column("query_id").to_numpy(), _matrix(left.column("q_vector").combine_chunks()), right.column("doc_id").to_numpy(), _matrix(right.column("vector").combine_chunks()))
    return top_k(_block_by_strip(asked, given, blocks, pair), k)


HITS = "query_id long, doc_id long, score double"


def _block_by_strip(asked: DataFrame, given: DataFrame, blocks: int, pair: Callable[[pa.Table, pa.Table], pa.RecordBatch]) -> DataFrame:
    """Hits of all queries in all documents: each block of queries meets each strip of STRIP_ROWS documents, by hash of their ids."""
    strips = max(1, -(-given.count() // STRIP_ROWS))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", number("query_id", blocks)).withColumn("strip", each(strips))
    right = given.withColumn("strip", number("doc_id", strips)).withColumn("block", each(blocks))

    def run(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_batches([pair(a, b) if a.num_rows and b.num_rows else _hits([])])

    return left.groupBy("block", "strip").cogroup(right.groupBy("block", "strip")).applyInArrow(run, HITS)


def _k_best(scores: np.ndarray, ids: np.ndarray, doc_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, document ids, scores) of each row's k best; ties stay until ids decide. Scores of -inf are no hits."""
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    a, b = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    return ids[a], doc_ids[b], scores[a, b]


def _hits(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "doc_id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return np.where(out > 0, np.sqrt(out), 1.0)


class _Postings:
    """Queries by term: for each term of one of them, which ask for it and how much."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids = ids
        order = np.argsort(terms, kind="stable")
        self.terms, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(terms))
        self.query, self.weight = np.repeat(np.arange(len(ids)), lengths)[order], weights[order]

    def hits(self, doc_ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> pa.RecordBatch:
        """The k best documents of each query; those without a shared term are no hits."""
        rows, ends = [], np.cumsum(lengths)
        step = max(1, SCORES // max(1, len(self.ids)))
        for at in range(0, len(doc_ids) if len(self.terms) else 0, step):
            n = min(step, len(doc_ids) - at)
            part = slice(ends[at] - lengths[at], ends[at + n - 1])
            doc = np.repeat(np.arange(n), lengths[at : at + n])
            place = np.minimum(np.searchsorted(self.terms, terms[part]), len(self.terms) - 1)
            known = np.flatnonzero(self.terms[place] == terms[part])
            place, doc, w = place[known], doc[known], weights[part][known]
            many = self.first[place + 1] - self.first[place]
            size = len(self.ids) * n
            scores, met = np.zeros(size), np.zeros(size, bool)
            upto = np.cumsum(many)
            for cut in _cuts(upto):
                posting = np.repeat(self.first[place[cut]] - upto[cut] + many[cut], many[cut]) + np.arange(upto[cut.start] - many[cut.start], upto[cut.stop - 1])
                cell = self.query[posting] * n + np.repeat(doc[cut], many[cut])
                np.add.at(scores, cell, np.repeat(w[cut], many[cut]) * self.weight[posting])
                met[cell] = True
            rows.append(_k_best(np.where(met, np.round(scores, DIGITS), -np.inf).reshape(len(self.ids), n), self.ids, doc_ids[at : at + n], k))
            if len(rows) == 16:
                rows = [_merged(rows, k)]
        return _hits([_merged(rows, k)] if rows else [])


def _cuts(upto: np.ndarray) -> Iterator[slice]:
    """Parts of a running sum that add SCORES at most, or hold one item."""
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SCORES, side="right")))
        yield slice(at, end)
        at = end


def _merged(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among hits, ties by document."""
    ids, docs, scores = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((docs, -scores, ids))
    of = ids[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    best = order[rank < k]
    return ids[best], docs[best], scores[best]


def _csr(table: pa.Table | pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths, terms and weights of sparse rows."""
    column = lambda c: x.combine_chunks() if isinstance(x := table.column(c), pa.ChunkedArray) else x
    indices = column("indices")
    return column(key).to_numpy(), pc.list_value_length(indices).to_numpy().astype(np.int64), indices.flatten().to_numpy(), column("values").flatten().to_numpy()


def sparse_hits(doc_rows: DataFrame, query_rows: DataFrame, k: int = PREFETCH) -> DataFrame:
    """(query_id, doc_id, score, rank) of sparse rows (doc_id or query_id, indices, values): sums over shared terms, top k; documents without a shared term are no hits.

    Documents stay whole rows. Queries go to the executors as postings by term,
    up to BROADCAST_QUERIES queries and BROADCAST_POSTINGS entries, which are
    counted first; each batch of documents keeps its k best. More queries are
    dealt into blocks.
    """
    ship(doc_rows.sparkSession)
    given = doc_rows.select(F.col("doc_id").cast("long").alias("doc_id"), "indices", "values").where(F.size("indices") > 0)
    asked = query_rows.select(F.col("query_id").cast("long").alias("query_id"), "indices", "values").where(F.size("indices") > 0)
    n, entries = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("indices")), F.lit(0))).first()
    blocks = max(1, -(-n // BROADCAST_QUERIES), -(-entries // BROADCAST_POSTINGS))
    if blocks == 1:
        postings = _Postings(*_csr(asked.toArrow(), "query_id"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield postings.hits(*_csr(batch, "doc_id"), k)

        return top_k(given.mapInArrow(run, HITS), k)
    return top_k(_block_by_strip(asked, given, blocks, lambda a, b: _Postings(*_csr(a, "query_id")).hits(*_csr(b, "doc_id"), k)), k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = FINAL, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings; a hit that one of them lacks has the rank of 10^9 there."""
    d = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"))
    part = lambda c: 1 / (F.lit(float(rrf_k)) + F.coalesce(F.col(c), F.lit(MISSING_RANK)))
    both = d.join(s, ["query_id", "doc_id"], "full_outer")
    return top_k(both.withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), DIGITS)), k)


def threshold(hits: DataFrame, limit: float = 0.6, keep: str = "at_most") -> DataFrame:
    """Filter hits by score, after their top k was taken.

    ``at_most`` keeps scores up to the limit, which for cosines are the less
    similar ones; ``at_least`` keeps the others.
    """
    if keep not in ("at_most", "at_least"):
        raise ValueError("keep is at_most or at_least")
    return hits.where(F.col("score") <= limit if keep == "at_most" else F.col("score") >= limit)


def rerank(hits: DataFrame, score: Callable[[Column, Column], Column], k: int = FINAL) -> DataFrame:
    """Order hits (query_id, query, doc_id, text, rank) by a model's score; ties keep their order. ``score`` maps query and text."""
    scored = hits.withColumnRenamed("rank", "input_rank").withColumn("rerank_score", score(F.col("query"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "input_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def overlap_score(query: Column, document: Column) -> Column:
    """A stand-in for a cross-encoder: share of the query's distinct words that the document has. Not a model."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+"))
    return F.round(F.size(F.array_intersect(words(query), words(document))) / F.size(words(query)), 6)


def confidence(reranked: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, confidence, num_sources): mean score, 0.0 without hits, and number of hits."""
    means = reranked.groupBy("query_id").agg(F.avg("rerank_score").alias("m"), F.count("*").alias("n"))
    return queries.select("query_id").join(means, "query_id", "left").select(
        "query_id", F.bround(F.coalesce("m", F.lit(0.0)), 4).alias("confidence"), F.coalesce("n", F.lit(0)).alias("num_sources")
    )
