"""Sections and typed chunks from text blocks.

Blocks are (doc_id, block_no, text, page). All state that runs along a document
is a window over (doc_id, ...), so a document is the unit of distribution; the
one rule that no window can say, packing that starts anew, is a fold over the
paragraphs of one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structure, text
from ..session import cut

WIDTH, OVERLAP, PROCEDURE_TOKENS, LEAST_TOKENS = 1000, 150, 450, 20


def paragraphs_of_lines(lines: DataFrame) -> DataFrame:
    """Blocks of consecutive non-blank lines; lines: doc_id, page, line_no, line. Blocks never span pages."""
    along = Window.partitionBy("doc_id", "page").orderBy("line_no")
    blank = text.strip(F.col("line")) == ""
    marked = lines.withColumn("blank", blank).withColumn("g", F.sum(F.col("blank").cast("int")).over(along)).where(~F.col("blank"))
    grouped = marked.groupBy("doc_id", "page", "g").agg(F.min("line_no").alias("first_line"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return grouped.select("doc_id", "page", "first_line", F.array_join(F.col("ls.line"), "\n").alias("text"))


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks with is_heading, level, section_no, title and section_path.

    A heading at level k closes all at k and deeper. So the last heading of a
    level is on the path if no heading of a smaller level came after it.
    """
    along = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = blocks.withColumn("is_heading", structure.is_heading_block(F.col("text")))
    head = head.withColumn("level", F.when(F.col("is_heading"), structure.heading_level(F.col("text"))))
    head = head.withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(along))
    for k in (1, 2, 3):
        last = F.last(F.when(F.col("level") == k, F.struct(F.col("block_no").alias("at"), text.strip(F.col("text")).alias("title"))), ignorenulls=True)
        head = head.withColumn(f"h{k}", last.over(along))
    after = lambda k, *before: F.col(f"h{k}.at") > F.greatest(*[F.coalesce(F.col(f"h{b}.at"), F.lit(-1)) for b in before], F.lit(-1))
    path = F.filter(
        F.array(F.col("h1.title"), F.when(after(2, 1), F.col("h2.title")), F.when(after(3, 1, 2), F.col("h3.title"))), lambda t: t.isNotNull()
    )
    return head.withColumn("section_path", path).drop("h1", "h2", "h3")


def section_table(sectioned: DataFrame) -> DataFrame:
    """One row a section: level, title, first page and last page of the heading and its own blocks."""
    return sectioned.groupBy("doc_id", "section_no").agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("is_heading"), text.strip(F.col("text")))).alias("title"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.count_if(~F.col("is_heading")).alias("n_blocks"),
    )


def typed_paragraphs(sectioned: DataFrame) -> DataFrame:
    """Paragraphs of blocks that are no headings, with type and the run of one type that they belong to."""
    split = F.filter(F.transform(F.split(F.col("text"), r"\n[ \t]*\n"), text.strip), lambda p: p != "")
    out = sectioned.where(~F.col("is_heading")).select("doc_id", "section_no", "section_path", "block_no", "page", F.posexplode_outer(split).alias("part_no", "para")).where("part_no is not null")  # without outer, Spark makes the parts twice, to filter
    out = out.withColumn("type", structure.paragraph_type(F.col("para")))
    along = Window.partitionBy("doc_id", "section_no").orderBy("block_no", "part_no")
    before = F.lag("type").over(along)
    out = out.withColumn("changed", (before.isNull() | (before != F.col("type"))).cast("int"))
    out = out.withColumn("run", F.sum("changed").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.drop("changed").withColumn("para_no", F.row_number().over(along))


RUN = ("doc_id", "section_no", "run")


def _joined(paras: DataFrame) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_no", "para"))), lambda p: p["para"]), "\n\n")


def table_chunks(paras: DataFrame) -> DataFrame:
    """Each run of tables is one chunk."""
    return paras.where("type = 'table'").groupBy(*RUN).agg(
        F.lit(0).alias("ordinal"), F.first("section_path").alias("section_path"), _joined(paras).alias("text"), F.min("page").alias("page_start"), F.max("page").alias("page_end")
    )


def pack_tokens(tokens: Column, most: int = PROCEDURE_TOKENS) -> Column:
    """Ordinal of the chunk of each paragraph: a new one starts where the next would exceed ``most``."""
    start = F.struct(F.array().cast("array<int>").alias("ordinals"), F.lit(0).alias("current"), F.lit(0).alias("used"))

    def step(acc, n):
        fresh = (acc["used"] > 0) & (acc["used"] + n > most)
        current = acc["current"] + fresh.cast("int")
        return F.struct(
            F.concat(acc["ordinals"], F.array(current)).alias("ordinals"), current.alias("current"), F.when(fresh, n).otherwise(acc["used"] + n).alias("used")
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["ordinals"])


def procedure_chunks(paras: DataFrame, most: int = PROCEDURE_TOKENS) -> DataFrame:
    """Runs of procedures, packed greedily; a paragraph that is too long stands alone."""
    own = paras.where("type = 'procedure'").withColumn("tokens", text.token_count(F.col("para")))
    runs = own.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct("para_no", "tokens", "page", "para"))).alias("ps"), F.first("section_path").alias("section_path"))
    runs = runs.withColumn("ordinals", pack_tokens(F.col("ps.tokens"), most))
    rows = runs.select(*RUN, "section_path", F.explode(F.arrays_zip("ps", "ordinals")).alias("z"))
    rows = rows.select(*RUN, "section_path", F.col("z.ordinals").alias("ordinal"), "z.ps.para_no", "z.ps.para", "z.ps.page")
    return rows.groupBy(*RUN, "ordinal").agg(
        F.first("section_path").alias("section_path"), _joined(rows).alias("text"), F.min("page").alias("page_start"), F.max("page").alias("page_end")
    )


def concept_windows(paras: DataFrame, width: int = WIDTH, overlap: int = OVERLAP) -> DataFrame:
    """Runs of concepts in overlapping token windows; a chunk has every paragraph that its window meets, whole.

    Paragraphs know where they start in the run, so each finds its windows by
    arithmetic and no join is needed.
    """
    if overlap >= width:
        raise ValueError("overlap must be smaller than the width")
    step = width - overlap
    along = Window.partitionBy(*RUN).orderBy("para_no")
    whole = Window.partitionBy(*RUN)
    own = paras.where("type = 'concept'").withColumn("n", text.space_tokens(F.col("para")))
    own = own.withColumn("b", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = own.withColumn("a", F.col("b") - F.col("n")).withColumn("total", F.sum("n").over(whole))
    own = own.withColumn("p0", F.min("page").over(whole)).withColumn("p1", F.max("page").over(whole))
    last = F.when(F.col("total") <= width, 0).otherwise(F.ceil((F.col("total") - width) / step))
    # window k covers [k step, k step + width)
    first_hit = F.greatest(F.lit(0), F.floor((F.col("a") - width) / step) + 1)
    last_hit = F.least(last, F.ceil(F.col("b") / step) - 1)
    hits = own.where(F.col("n") > 0).select("*", F.when(first_hit <= last_hit, F.sequence(first_hit, last_hit)).alias("ks"))
    rows = hits.select(*RUN, "section_path", "para_no", "para", "p0", "p1", F.explode(F.col("ks").cast("array<int>")).alias("ordinal"))
    return rows.groupBy(*RUN, "ordinal").agg(
        F.first("section_path").alias("section_path"), _joined(rows).alias("text"), F.min("p0").alias("page_start"), F.max("p1").alias("page_end")
    )


def chunk(blocks: DataFrame, width: int = WIDTH, overlap: int = OVERLAP, procedure_tokens: int = PROCEDURE_TOKENS, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """Typed chunks of blocks: id, doc_id, section_no, run, ordinal, type, text, section_path, page_start, page_end, flags.

    The typed paragraphs are written once; the three kinds go on from there.
    """
    paras = cut(typed_paragraphs(sections(blocks)))
    kinds = {"table": table_chunks(paras), "procedure": procedure_chunks(paras, procedure_tokens), "concept": concept_windows(paras, width, overlap)}
    out = None
    for kind, rows in kinds.items():
        rows = rows.withColumn("type", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    out = out.where((text.strip(F.col("text")) != "") & (text.token_count(F.col("text")) >= least_tokens))
    return out.select(
        text.stable_id(F.col("doc_id"), F.col("section_no"), F.col("run"), F.col("ordinal")).alias("id"),
        *RUN, "ordinal", "type", "text", "section_path", "page_start", "page_end",
        F.create_map(F.concat(F.lit("is_"), F.col("type")), F.lit(True)).alias("flags"),
    )


def to_documents(chunks: DataFrame, source_file: Column) -> DataFrame:
    """(page_content, metadata) with metadata as text by name."""
    meta = F.create_map(
        F.lit("section_path"), text.section_display(F.col("section_path")), F.lit("page_start"), F.col("page_start").cast("string"),
        F.lit("page_end"), F.col("page_end").cast("string"), F.lit("source_file"), text.basename(source_file),
    )
    return chunks.select("id", F.col("text").alias("page_content"), meta.alias("metadata"))


def summary(chunks: DataFrame, n: int = 8) -> DataFrame:
    """The first chunks in order, with lengths, the first three path items and pages."""
    return chunks.orderBy("doc_id", "section_no", "run", "ordinal", "type").limit(n).select(
        "id", F.length("text").alias("n_chars"), text.token_count(F.col("text")).alias("n_tokens"), "type",
        F.slice("section_path", 1, 3).alias("path"), F.concat_ws("-", "page_start", "page_end").alias("pages"),
    )
