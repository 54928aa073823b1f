"""Readers: text, CSV, PDF, DOCX and XLSX files, stages, collections, JSON.

Files are read by Spark, so they may lie in any store it knows. Formats without
a Spark reader are parsed from ``binaryFile`` rows in Arrow batches; a file that
can't be parsed gives a row with an error, not a failed job.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from itertools import zip_longest
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension, unify_lines
from ..session import ship

LOADERS = {".pdf": "pdf", ".txt": "text", ".csv": "csv", ".docx": "docx", ".xlsx": "xlsx"}
#: A first text shorter than this is tried again, and what is still shorter than the other goes to OCR.
ENOUGH, LEAST = 2000, 500


def loader_of(path: Column) -> Column:
    """Name of the loader for a path's suffix; null if there is none."""
    return F.create_map(*[F.lit(x) for pair in LOADERS.items() for x in pair])[extension(path)]


def load_error(path: Column) -> Column:
    return F.when(loader_of(path).isNull(), F.concat(F.lit("Unsupported file type: "), extension(path)))


def with_metadata(documents: DataFrame, path: Column, at: Column) -> DataFrame:
    """Add source_file, file_type and processed_at (seconds)."""
    return documents.withColumns({"source_file": basename(path), "file_type": extension(path), "processed_at": F.unix_micros(at) / 1e6})


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, page_content."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("page_content"))


def load_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row a record: page_content with a line ``name: value`` for each column."""
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"')
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in rows.columns]
    return rows.select("*", F.concat_ws("\n", *lines).alias("page_content"))


def _docx(data: bytes) -> str:
    """Paragraphs of a word-processing document, one a line."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    space = root.tag.partition("}")[0] + "}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def _xlsx(data: bytes) -> str:
    """Rows of all sheets, cells joined by tabs."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        space = root.tag.partition("}")[0] + "}"
        shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in root.iter(f"{space}si")]
    lines = []
    for name in names:
        root = ElementTree.fromstring(book.read(name))
        space = root.tag.partition("}")[0] + "}"
        for row in root.iter(f"{space}row"):
            cells = []
            for c in row.iter(f"{space}c"):
                value = c.find(f"{space}v")
                inline = "".join(t.text or "" for t in c.iter(f"{space}t"))
                raw = (value.text or "") if value is not None else inline
                cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw)
            lines.append("\t".join(cells))
    return "\n".join(lines)


_TEXT_OPERATOR = re.compile(rb"\((?:\\.|[^\\()])*\)|T\*|'|T[dD]|ET")
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf(data: bytes) -> str:
    """Strings that the content streams of a simple PDF show; pages are parted by form feeds.

    Reads literal strings in plain or deflated streams. Other encodings need a
    parser library, which plugs in as ``parse``.
    """
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.DOTALL):
        body = m[1]
        if b"FlateDecode" in data[max(0, m.start() - 200) : m.start()]:
            body = zlib.decompress(body)
        if b"BT" not in body:
            continue
        out: list[bytes] = []
        for token in _TEXT_OPERATOR.findall(body):
            if token[:1] == b"(":
                out.append(_ESCAPE.sub(lambda e: _NAMED.get(e[1], e[1] if e[1][:1] in b"()\\" else bytes([int(e[1], 8) & 255])), token[1:-1]))
            elif out and out[-1] != b"\n":
                out.append(b"\n")
        pages.append(b"".join(out).decode("latin-1").rstrip("\n"))
    return "\f".join(pages)


def _csv(data: bytes) -> list[str]:
    """A document for each record: a line ``name: value`` for each column. Quoted values may hold line feeds."""
    rows = csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""))
    names = next(rows, [])
    return ["\n".join(f"{n}: {v}" for n, v in zip_longest(names, row[: len(names)], fillvalue="")) for row in rows if row]


PARSERS = {"pdf": _pdf, "docx": _docx, "xlsx": _xlsx, "csv": _csv, "text": lambda b: b.decode("utf-8", "replace")}


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers give it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def load_files(spark: SparkSession, paths: list[str], parsers: dict | None = None) -> DataFrame:
    """One row a document: file_ordinal, path, part, page_content, error.

    file_ordinal is the place of the file in ``paths``; a path that is named
    twice is loaded twice. A file is one document but for CSV files, of which
    each record is one; part numbers them. Pages are parted by form feeds. A
    file that can't be read is one row with an error.
    """
    ship(spark)
    parse = PARSERS | (parsers or {})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data, loader, error in zip(part["path"], part["content"], part["loader"], part["error"]):
                texts: list[str] = []
                if error is None:
                    try:
                        got = parse[loader](bytes(data))
                        texts = [got] if isinstance(got, str) else got
                        error = None if any(t.strip() for t in texts) else "no text"
                    except Exception as e:  # a broken file is a row, not a failed job
                        error = f"{type(e).__name__}: {e}"
                rows += [(path, i, t, None) for i, t in enumerate(texts)] if error is None else [(path, 0, None, error)]
            yield pd.DataFrame(rows, columns=["path", "part", "page_content", "error"])

    named = [_qualified(spark, p) for p in paths]
    order = spark.createDataFrame(list(enumerate(named)), "file_ordinal int, given string")
    files = spark.read.format("binaryFile").load(sorted(set(named))).select("path", "content", loader_of(F.col("path")).alias("loader"), load_error(F.col("path")).alias("error"))
    got = files.mapInPandas(run, "path string, part int, page_content string, error string")
    return got.join(order, F.col("path") == F.col("given")).select("file_ordinal", "path", "part", "page_content", "error")


def page_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, line) of documents (doc_id, page_content): pages are parted by form feeds and count from 1; lines lose what is blank at their right."""
    pages = documents.select("doc_id", F.posexplode(F.split("page_content", "\f")).alias("p", "t"))
    lines = F.posexplode(F.split(unify_lines(F.col("t")), "\n"))
    return pages.select("doc_id", (F.col("p") + 1).alias("page"), lines.alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))


def choose_text(candidates: DataFrame, key: str = "path", ocr_available: bool = True) -> DataFrame:
    """The text of each file from candidates (key, strategy, text): fast, then layout, then ocr.

    Layout is looked at if the fast text is short, OCR if the best so far is
    shorter still; each is kept if it is strictly longer. Of several texts of a
    strategy the longest counts. No text is an error.
    """
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    longest = F.max_by("text", F.struct(F.length("text"), "text"))
    wide = candidates.groupBy(key).pivot("strategy", ["fast", "layout", "ocr"]).agg(longest)
    second = (size("fast") < ENOUGH) & (size("layout") > size("fast"))
    wide = wide.withColumn("text", F.when(second, F.col("layout")).otherwise(F.coalesce("fast", F.lit("")))).withColumn("strategy", F.when(second, "layout").otherwise("fast"))
    third = F.lit(ocr_available) & (size("text") < LEAST) & (size("ocr") > size("text"))
    chosen = wide.select(key, F.when(third, F.col("ocr")).otherwise(F.col("text")).alias("text"), F.when(third, F.lit("ocr")).otherwise(F.col("strategy")).alias("strategy"))
    return chosen.withColumn("error", F.when(F.length("text") == 0, F.lit("no text")))


def count_of(counters: DataFrame, key: int, id_col: str = "id", count_col: str = "count") -> DataFrame:
    """(count) of one stored counter; no row if there is none."""
    return counters.where(F.col(id_col) == F.lit(key)).select(F.col(count_col).alias("count"))


def collection_info(points: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: points_count, vector_size."""
    return points.agg(F.count("*").alias("points_count"), F.max(F.size(vector)).cast("long").alias("vector_size"))


def parse_json(column: Column, schema: str) -> Column:
    """A JSON text by schema; null where it can't be read."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})
