"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times in the
mix. A running sum of the expected copies along the source, shifted by one
random offset, crosses integers; a document is emitted once for each integer
crossed at its place. Documents lie along the source in order of size class,
then of a hash, so each stretch of the sum takes its share of every size.

The running sum is not one sorted pass: a source is cut into cells (size class
and slice of the hash range), cells are counted with map-side combining, the
counts are summed up over the small table of cells, and ranks are taken within
cells. A source that holds most rows is spread over all its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_text, power_of_two, unused, word_count

#: Rows that a cell should hold at most, if hashes spread evenly.
ROWS_PER_CELL = 4096
#: Hash values lie below 2 ** HASH_BITS (15 hexadecimal digits).
HASH_BITS = 60


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _size_class(size: Column) -> list[Column]:
    """Binary length and leading bits: sizes of a class differ by an eighth at most."""
    bits = F.bin(size)
    return [F.length(bits), F.substring(bits, 1, 4)]


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, limit: float) -> DataFrame:
    """Add ``target`` to a table (source, source_size): one row a source.

    Weights repeat along the sources in code point order, null last. A target
    stops at ``limit`` times the source's size and the excess is shared out
    again by weight. That is a water level: with sources in order of the level
    at which they stop, it is the highest level that what is left allows the others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(limit)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    rest = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return (
        ranked.withColumn("level", level)
        .withColumn("water", found)
        .withColumn("target", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def _placed(
    df: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep_text: bool = True,
) -> tuple[DataFrame, list[str]]:
    """All columns of df (but the text, if it isn't kept) and those of its size, source_size, target and copies, whose names come second."""
    kept = [c for c in df.columns if keep_text or c != text_col]
    names = unused(df, "id", "size", "source", "key", "part", "length", "lead", "cell", "n", "words", "before", "source_size", "target", "rank", "copies")
    ident, size, source, key, part, length, lead, cell, n, s, before, source_size, target, rank, copies = names
    c = F.col
    sized = df.select(
        *[F.col(f"`{x}`") for x in kept],
        F.col(f"`{id_col}`").alias(ident),
        word_count(F.col(f"`{text_col}`")).alias(size),
        F.col(f"`{source_col}`").alias(source),
        _hash60(F.concat(F.lit(f"{seed}:"), id_text(F.col(f"`{id_col}`")))).alias(key),
    )
    if not keep_text:
        sized = cut(sized)
    slices = power_of_two(min(4096, max(1, sized.count() / ROWS_PER_CELL)))
    found = _size_class(c(size))
    sized = sized.withColumns({length: found[0], lead: found[1], part: F.shiftright(c(key), HASH_BITS - (slices.bit_length() - 1))})
    # places and cells are found by one key without nulls, so that rows are shuffled once for both
    sized = sized.withColumn(cell, F.struct(c(source).isNull().alias("none"), F.coalesce(source, F.lit("")).alias("s"), c(length).alias("l"), c(lead).alias("b"), c(part).alias("p")))

    counted = cut(sized.groupBy(c(source).alias("source"), cell).agg(F.count("*").alias(n), F.sum(size).alias(s)))
    targets = source_targets(counted.groupBy("source").agg(F.sum(s).alias("source_size")), weights, share, limit)
    targets = targets.select(c("source").alias("t_source"), c("source_size").alias(source_size), c("target").alias(target))
    along = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.select("source", c(cell).alias("c_cell"), F.coalesce(F.sum(n).over(along), F.lit(0)).alias(before))
    cells = cells.join(targets, c("source").eqNullSafe(c("t_source")))
    (c_cell,) = unused(sized, "c_cell")
    cells = cells.select(c("c_cell").alias(c_cell), before, source_size, target)

    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(c(source), F.lit("")))), 1, 4), 16, 10).cast("double") / 65536
    order = Window.partitionBy(cell).orderBy(key, c(ident).asc_nulls_first())
    placed = sized.withColumn(rank, F.row_number().over(order)).join(cells, c(cell) == c(c_cell))
    rate = F.when(c(source_size) > 0, c(target) / c(source_size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    over = rate - whole
    place = c(before) + c(rank)
    crossed = F.floor(offset + over * place) - F.floor(offset + over * (place - 1))
    placed = placed.withColumn(copies, F.least(whole + crossed, F.ceil(rate)).cast("long"))
    made = [size, source_size, target, copies]
    return placed.select(*[F.col(f"`{x}`") for x in kept], *made), made


def mix_sources(df: DataFrame, keep_text: bool = True, **options) -> DataFrame:
    """All rows of df with size, source_size, target, copies and taken.

    ``copies`` says how often the mix takes the row, ``taken`` how many words
    that is. The columns of df stay, unless they have one of these five names,
    which are replaced; with ``keep_text`` false the text goes too, and rows
    without texts are written once and read from then on, so texts are read
    once. Null text has size 0; rows without a source form the last source; a
    null id counts as the empty text; equal rows get places one after the
    other, in no special order, and so the same rows come out of every run. A
    source whose documents are all empty has target 0. An empty table gives an
    empty table. Options: weights, share, limit, seed and names of columns, as
    in _placed.
    """
    placed, inner = _placed(df, keep_text=keep_text, **options)
    size, source_size, target, copies = map(F.col, inner)
    made = {"size": size, "source_size": source_size, "target": target, "copies": copies, "taken": copies * size}
    kept = [F.col(f"`{x}`") for x in placed.columns[: -len(inner)] if x.lower() not in made]
    return placed.select(*kept, *[v.alias(k) for k, v in made.items()])


def take_mix(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of df as often as mix_sources says, with df's columns."""
    placed, inner = _placed(df, **options)
    copies = F.col(inner[-1])
    (copy,) = unused(placed, "copy")
    return placed.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop(copy, *inner)


#: DuckDB SQL for the rows of op1: the same sums in one window over each source.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([5, 2, 1])[((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size,
         coalesce(least(cap, max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight), cap) AS target
  FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY s.source ORDER BY len(bin(size)), substr(bin(size), 1, 4), key, doc_id NULLS FIRST) AS place,
         ('0x' || substr(md5('17/' || coalesce(s.source, '')), 1, 4))::BIGINT / 65536.0::DOUBLE AS u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, least(floor(rate) + floor(u + (rate - floor(rate)) * place) - floor(u + (rate - floor(rate)) * (place - 1)), ceil(rate))::BIGINT AS copies
  FROM placed)
SELECT doc_id, size, source_size, target, size * copies AS taken FROM taking
"""


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")
