"""TF-IDF over words and pairs of words: a vocabulary table, and one sparse row a document.

Terms are counted where their text is, a slice of documents at a time: words
become numbers, pairs of words pairs of numbers, and only what is distinct in a
slice becomes text again. So fitting shuffles terms alone, combined before they
move, and weighing shuffles nothing: the vocabulary, which ``max_features``
bounds, goes to the executors as a lookup table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship

BETWEEN_WORDS = r"(?U)\W+"
MIN_DF, MAX_DF, MAX_FEATURES = 2, 0.9, 200_000
#: Bytes of text whose terms are counted at a time.
SLICE_BYTES = 1 << 23
#: Terms that the driver looks at, to find where the most frequent ones end.
SAMPLE = 1 << 16


def document_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, words), and the columns to carry: lower-cased text with a space for all between words. Its words of two characters or more are terms, and so are pairs of neighbours among them. Null text has none."""
    words = F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), BETWEEN_WORDS, " ")
    return docs.select(F.col(id_col).alias("doc_id"), words.alias("words"), *carry)


def _slices(words: pa.StringArray) -> Iterator[tuple[int, pa.StringArray]]:
    """First row and rows of parts with SLICE_BYTES at most, or one row."""
    ends, at = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(words):
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")) - at)
        yield at, words.slice(at, n)
        at += n


def _terms(words: pa.StringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, and the row and the number of the term of each word and each pair."""
    lists = pc.split_pattern(words, " ")
    flat = lists.flatten().dictionary_encode()
    word, known = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    long = pc.greater_equal(pc.utf8_length(known), 2)
    number = np.cumsum(long.to_numpy(zero_copy_only=False)) - 1
    kept = long.to_numpy(zero_copy_only=False)[word]
    row = np.repeat(np.arange(len(words)), pc.list_value_length(lists).to_numpy())[kept]
    word, known = number[word[kept]], known.filter(long)
    inside = row[:-1] == row[1:]
    pairs, pair = np.unique((word[:-1] * len(known) + word[1:])[inside], return_inverse=True)
    first, second = np.divmod(pairs, max(1, len(known)))
    joined = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second)), " ")
    return pa.concat_arrays([known, joined]), np.concatenate([row, row[:-1][inside]]), np.concatenate([word, pair + len(known)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, total) of slices."""
    for batch in batches:
        for _, words in _slices(batch.column(0)):
            terms, row, number = _terms(words)
            if len(terms):
                cell = np.sort(row * len(terms) + number)  # np.unique hashes, which takes far longer
                df = np.bincount(cell[np.append(True, cell[1:] != cell[:-1])] % len(terms), minlength=len(terms))
                yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(np.bincount(number, minlength=len(terms)))], names=["term", "df", "total"])


def fit(rows: DataFrame, n_docs: int, min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int = MAX_FEATURES) -> DataFrame:
    """Vocabulary (term, term_id, df, idf) of rows (doc_id, words): terms in enough and not too many documents, the most frequent ones, in alphabetical order.

    The counts are written once. The one-partition sort and window see a table
    that ``max_features`` bounds. Fewer than min_df / max_df documents have no
    vocabulary.
    """
    ship(rows.sparkSession)
    stats = rows.select("words").mapInArrow(_counted, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    stats = cut(stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs)))
    kept = _frequent(stats, max_features).orderBy(F.desc("total"), "term").limit(max_features)
    ids = F.row_number().over(Window.orderBy("term")) - 1
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    return kept.select("term", ids.alias("term_id"), "df", idf.alias("idf"))


def _frequent(stats: DataFrame, n: int) -> DataFrame:
    """Some more than the n most frequent terms, all of them among these; the whole table if it has fewer.

    Where they end is guessed from the order of some terms, and then counted.
    """
    found = stats.count()
    if found <= n:
        return stats
    some = stats.where(F.pmod(F.xxhash64("term"), F.lit(max(1, found // SAMPLE))) == 0).select("total", "term").collect()
    some = sorted((-r["total"], r["term"]) for r in some)
    at = math.ceil(n * len(some) / found)
    more = 16 + 8 * math.isqrt(at)
    while at + more < len(some):
        least, term = some[at + more]
        most = stats.where((F.col("total") > -least) | ((F.col("total") == -least) & (F.col("term") <= term)))
        if most.count() >= n:
            return most
        more *= 2
    return stats


def sparse_rows(rows: DataFrame, vocabulary: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """(doc_id, indices, values) of rows (doc_id, words), and their other columns: tf idf of length one, in order of term id.

    Unknown terms drop out; a row without known terms has empty arrays. The
    vocabulary is counted before it is sent.
    """
    spark = rows.sparkSession
    ship(spark)
    n = vocabulary.count()
    if n > max_features:
        raise ValueError(f"a vocabulary of {n} terms is larger than max_features")
    others = [c for c in rows.columns if c not in ("doc_id", "words")]
    if not n:
        return rows.select("doc_id", F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values"), *others)
    known = vocabulary.orderBy("term_id").select("term", "idf").toArrow()
    sent = spark.sparkContext.broadcast((known.column("term").combine_chunks(), known.column("idf").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in _slices(batch.column(1)):
                indices, values = _weighed(words, *sent.value)
                part = batch.slice(at, len(words))
                yield pa.RecordBatch.from_arrays([part.column(0), indices, values, *part.columns[2:]], names=["doc_id", "indices", "values", *others])

    lists = [T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    out = T.StructType([rows.schema["doc_id"], *lists, *[rows.schema[c] for c in others]])
    return rows.select("doc_id", "words", *others).mapInArrow(run, out)


def _weighed(words: pa.StringArray, known: pa.Array, idf: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Ids of known terms and their weights."""
    terms, row, number = _terms(words)
    ids = pc.fill_null(pc.index_in(terms.cast(known.type), value_set=known), -1).to_numpy()[number]
    cell, tf = np.unique((row * len(known) + ids)[ids >= 0], return_counts=True)
    row, ids = np.divmod(cell, len(known))
    weight = tf * idf[ids]
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(words)))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight / norm[row]))


def long_form(sparse: DataFrame) -> DataFrame:
    """(doc_id, term_id, weight) of sparse rows."""
    return sparse.select("doc_id", F.inline(F.arrays_zip(F.col("indices").alias("term_id"), F.col("values").alias("weight"))))


def save_model(vocabulary: DataFrame, path: str) -> None:
    """Write a vocabulary, as (term, term_id, df, idf)."""
    vocabulary.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """A stored vocabulary; texts are weighed with it as they come, without the corpus."""
    return spark.read.schema("term string, term_id int, df long, idf double").parquet(path)
