"""Whole plans: ingest of documents into a collection, and hybrid answers to questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..operators import search, sessions, tfidf
from ..session import cut


def vocabulary_of(docs: DataFrame, min_df: int = tfidf.MIN_DF) -> DataFrame:
    """Vocabulary of docs (doc_id, text). It is bounded, written once and read by all that follows."""
    return cut(tfidf.fit(tfidf.document_terms(docs), docs.count(), min_df))


def sparse_model(docs: DataFrame, min_df: int = tfidf.MIN_DF) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, sparse rows) of docs (doc_id, text)."""
    vocabulary = vocabulary_of(docs, min_df)
    return vocabulary, tfidf.sparse_rows(tfidf.document_terms(docs), vocabulary)


def store_vocabulary(docs: DataFrame, path: str) -> None:
    tfidf.save_model(tfidf.fit(tfidf.document_terms(docs), docs.count()), path)


def store_rows(docs: DataFrame, vocabulary: DataFrame, path: str) -> None:
    tfidf.sparse_rows(tfidf.document_terms(docs), vocabulary).write.mode("overwrite").parquet(path)


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, indices array<int>, values array<double>").parquet(path)


def store_sparse_model(docs: DataFrame, path: str) -> None:
    """Write the vocabulary and the sparse rows of docs below a path."""
    store_vocabulary(docs, f"{path}/vocabulary")
    store_rows(docs, tfidf.load_model(docs.sparkSession, f"{path}/vocabulary"), f"{path}/rows")


def load_sparse_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, sparse rows) that store_sparse_model wrote."""
    return tfidf.load_model(spark, f"{path}/vocabulary"), load_rows(spark, f"{path}/rows")


def query_rows(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, indices, values) of queries (query_id, text)."""
    return tfidf.sparse_rows(tfidf.document_terms(queries, "query_id"), vocabulary).withColumnRenamed("doc_id", "query_id")


def hybrid(model: tuple[DataFrame, DataFrame], doc_vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, config: Config = Config()) -> DataFrame:
    """Dense and sparse top ``config.prefetch``, fused to ``config.final``: query_id, doc_id, dense_rank, sparse_rank, score, rank."""
    vocabulary, rows = model
    sparse = search.sparse_hits(rows, query_rows(queries, vocabulary), config.prefetch)
    dense = search.dense_hits(doc_vectors, query_vectors, config.prefetch)
    return search.fuse(dense, sparse, config.final, config.rrf_k)


def retrieve(
    model: tuple[DataFrame, DataFrame] | None, doc_vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, config: Config = Config(), keep: str = "at_most"
) -> DataFrame:
    """(query_id, doc_id, score, rank): hybrid search if there is a sparse model, else dense search alone, its top ``config.final`` filtered by ``config.score_threshold``."""
    if model is not None:
        return hybrid(model, doc_vectors, queries, query_vectors, config).select("query_id", "doc_id", "score", "rank")
    return search.threshold(search.dense_hits(doc_vectors, query_vectors, config.final), config.score_threshold, keep)


def answers(docs: DataFrame, hits: DataFrame, queries: DataFrame, k: int = search.FINAL) -> DataFrame:
    """One row a query: sources in order (page_content, metadata), confidence, num_sources and the prompt. Payloads without text count as empty."""
    named = queries.select("query_id", F.col("text").alias("query"))
    rows = hits.select("query_id", "doc_id", "rank").join(named, "query_id").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    ranked = search.rerank(rows, search.overlap_score, k)
    listed = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text")))
    per_query = ranked.groupBy("query_id").agg(listed.alias("s"))
    out = named.join(per_query, "query_id", "left").join(search.confidence(ranked, named), "query_id")
    s = F.coalesce("s", F.array().cast("array<struct<rank:int,doc_id:bigint,text:string>>"))
    return out.select(
        "query_id", "confidence", "num_sources",
        F.transform(s, lambda x: F.struct(x["text"].alias("page_content"), F.create_map(F.lit("doc_id"), x["doc_id"].cast("string")).alias("metadata"))).alias("sources"),
        text.prompt(F.lit("Answer from the context."), F.array_join(F.transform(s, lambda x: x["text"]), "\n\n"), F.col("query")).alias("prompt"),
    )


def stream_answers(answered: DataFrame, generate: Callable[[Column], Column], retrieval_ms: Column, total_ms: Column) -> DataFrame:
    """Events of rows that ``answers`` gives. ``generate`` maps a prompt to the answer's text: the place of a language model."""
    said = answered.select("query_id", "sources", "confidence", "num_sources", generate(F.col("prompt")).alias("answer"), retrieval_ms.alias("retrieval_ms"), total_ms.alias("total_ms"))
    return sessions.answer_events(said)
