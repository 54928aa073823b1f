"""Ingest plans: files to blocks, chunks, a stage, and points in a collection; uploads to dense points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..operators import chunking, embedding, tfidf
from ..session import cut
from ..sources import readers, writers

MakeEncoder = Callable[[], embedding.Encoder]


def blocks_of_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, block_no, text, page) of lines (doc_id, page, line_no, line): paragraphs between blank lines, never over pages, normalised; those that are empty then go."""
    paras = chunking.paragraphs_of_lines(lines).withColumn("text", text.normalise(F.col("text"))).where(F.length("text") > 0)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "first_line")) - 1
    return paras.select("doc_id", number.alias("block_no"), "text", "page")


def file_blocks(files: DataFrame) -> DataFrame:
    """Blocks of loaded files (see load_files), with source_file. doc_id is the path and part of a document."""
    read = files.where("error is null").select(F.concat_ws("#", "path", "part").alias("doc_id"), "page_content").dropDuplicates(["doc_id"])
    return blocks_of_lines(readers.page_lines(read))


def chunk_files(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Typed chunks of loaded files, with source_file."""
    chunks = chunking.chunk(file_blocks(files), config.window_tokens, config.window_overlap, config.procedure_tokens, config.least_tokens)
    return chunks.withColumn("source_file", text.basename(F.regexp_replace("doc_id", r"#\d+$", "")))


def stage_chunks(chunks: DataFrame, stage: str, make_encoder: MakeEncoder | None = None, config: Config = Config(), with_sparse: bool = True, min_df: int = tfidf.MIN_DF) -> None:
    """Write below ``stage`` the chunks, the vocabulary if sparse rows are wanted, and the points.

    A chunk goes with its vectors through one pass, so that no join has to bring
    them together.
    """
    spark = chunks.sparkSession
    writers.save_stage(chunks, f"{stage}/chunks")
    chunks = writers.load_stage(spark, f"{stage}/chunks")
    parts = tuple(c for c in (*writers.PAYLOAD, "source_file") if c in chunks.columns)
    rows = embedding.embed(chunks, *([make_encoder] if make_encoder else []), batch=config.embed_batch, carry=parts)
    sparse = F.lit(None).cast("struct<indices:array<int>,values:array<double>>")
    if with_sparse:
        tfidf.save_model(tfidf.fit(tfidf.document_terms(chunks, "id"), chunks.count(), min_df), f"{stage}/vocabulary")
        terms = tfidf.document_terms(rows, "id", carry=("vector", *parts))
        rows = tfidf.sparse_rows(terms, tfidf.load_model(spark, f"{stage}/vocabulary")).withColumnRenamed("doc_id", "id")
        sparse = F.struct("indices", "values")
    writers.save_stage(rows.select("id", F.struct(*parts).alias("payload"), F.col("vector").alias("dense"), sparse.alias("sparse")), f"{stage}/points")


def points_of_stage(spark: SparkSession, stage: str) -> DataFrame:
    """(id, payload, dense, sparse) of a stage, one of each id; a chunk without known terms has a sparse row without entries, a stage without sparse rows has nulls."""
    points = writers.load_stage(spark, f"{stage}/points")
    return writers.last_of(points, "id") if writers.has_repeats(points, "id") else points


def ingest(
    chunks: DataFrame | None, stage: str, collection: str, spark: SparkSession, make_encoder: MakeEncoder | None = None, config: Config = Config(),
    with_sparse: bool = True, stage_only: bool = False, upsert_only: bool = False, recreate: bool = False,
) -> DataFrame | None:
    """Stage chunks, then upsert their points into a collection, whose new version is returned.

    ``stage_only`` stops before the upsert, ``upsert_only`` starts from a stage
    that is there; so a job goes on where it was stopped. ``recreate`` forgets
    what the collection had.
    """
    if not upsert_only:
        stage_chunks(chunks, stage, make_encoder, config, with_sparse)
    if stage_only:
        return None
    points = points_of_stage(spark, stage)
    old = None if recreate else writers.read_collection(spark, collection)
    if old is not None and writers.lacks_any(points, old, "id"):
        points = writers.upsert(old, points, "id", unique=True)
    return writers.write_collection(points, collection)


def upload(spark: SparkSession, paths: list[str], make_encoder: MakeEncoder | None = None, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(points, errors) of files: load, split by characters (``config.chunk_size``, ``chunk_overlap``), embed. A file that can't be read is an error row."""
    files = cut(readers.load_files(spark, paths))
    split = text.character_chunks(config.chunk_size, config.chunk_overlap)
    pieces = files.where("error is null").select("file_ordinal", "path", "part", F.posexplode(split("page_content")).alias("chunk_no", "text"))
    pieces = pieces.withColumn("id", text.stable_id(F.col("file_ordinal"), F.col("path"), F.col("part"), F.col("chunk_no")))
    dense = embedding.embed(pieces, *([make_encoder] if make_encoder else []), batch=config.embed_batch)
    points = pieces.select("id", "file_ordinal", "part", "chunk_no", text.basename(F.col("path")).alias("source_file"), "text").join(dense, "id")
    return points, files.where("error is not null").select("file_ordinal", "path", "error")
