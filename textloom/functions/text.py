"""Text normalisation and small text functions as column expressions.

Everything is built in but NFKC, for which Spark has no function; that one is
an Arrow UDF over the standard library. Patterns carry (?U) where letters and
digits of all languages count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns whose meaning results depend on.
HYPHEN_BREAK = r"(?U)(\w)-\n(\w)"
BLANKS = r"[ \t]+"
AROUND_NEWLINE = r"[ \t]*\n[ \t]*"
OUTER_SPACE = r"(?U)^\s+|\s+$"
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
THINK = r"<think>([\s\S]*?)</think>"
# Texts that users see.
GREETING = ("Hello, ", "! How can I assist you today?")
CARD_TITLE = "🚨 Incorrect Answer Reported"
CARD = ("👤 **User:** ", "\n\n❓ **Question:**\n```\n", "\n```\n\n💬 **Answer:**\n```\n", "\n```\n\n📊 **Report Count:** ")
STREAM_FAILED = "Sorry, an error occurred while streaming. Please try again."
UNDOUBLE_SHARE = 0.35
UNDOUBLE_LEAST = 6


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def dehyphenate(text: Column) -> Column:
    """Join words that a hyphen breaks at a line's end."""
    return F.regexp_replace(text, HYPHEN_BREAK, "$1$2")


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def trim_newlines(text: Column) -> Column:
    return F.regexp_replace(text, AROUND_NEWLINE, "\n")


def unify_lines(text: Column) -> Column:
    """Line feeds for all characters that end lines."""
    return F.regexp_replace(text, LINE_ENDS, "\n")


def undouble(line: Column) -> Column:
    """Collapse equal pairs if a line of six characters or more is full of them."""
    pairs = F.regexp_count(line, F.lit(r"(?s)(.)(?=\1)"))
    doubled = (F.length(line) >= UNDOUBLE_LEAST) & (pairs >= F.length(line) * F.lit(UNDOUBLE_SHARE))
    return F.when(doubled, F.regexp_replace(line, r"(?s)(.)\1", "$1")).otherwise(line)


def undouble_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(unify_lines(text), "\n"), undouble), "\n")


def normalise(text: Column, compose: bool = True) -> Column:
    """All steps in their order: NFKC, hyphens, blanks, newlines, doubled lines, blanks, strip."""
    text = nfkc(text) if compose else text
    return strip(collapse_blanks(undouble_lines(trim_newlines(collapse_blanks(dehyphenate(text))))))


def token_count(text: Column) -> Column:
    """A quarter of the characters, rounded up, and at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def space_tokens(text: Column) -> Column:
    """Number of runs between white space."""
    stripped = strip(text)
    return F.when(F.length(stripped) > 0, F.size(F.split(stripped, r"(?U)\s+"))).otherwise(0)


def thinking(text: Column) -> Column:
    """Bodies of all closed think tags, trimmed and joined by blank lines."""
    bodies = F.regexp_extract_all(text, F.lit(THINK), F.lit(1))
    return F.array_join(F.transform(bodies, strip), "\n\n")


def visible(text: Column) -> Column:
    """What remains without closed think tags."""
    return strip(F.regexp_replace(text, THINK, ""))


def preview(text: Column, n: int = 300) -> Column:
    return F.concat(F.left(F.coalesce(text, F.lit("")), F.lit(n)), F.lit("..."))


def title_of(text: Column, n: int = 40) -> Column:
    """First line, cut after n characters with an ellipsis."""
    line = F.split_part(strip(text), F.lit("\n"), F.lit(1))
    return F.when(F.length(line) > n, F.concat(F.left(line, F.lit(n)), F.lit("…"))).otherwise(line)


def display_name(name: Column, default: str = "User") -> Column:
    return F.coalesce(F.nullif(strip(name), F.lit("")), F.lit(default))


def greeting(name: Column) -> Column:
    return F.concat(F.lit(GREETING[0]), display_name(name), F.lit(GREETING[1]))


def initial(name: Column) -> Column:
    return F.upper(F.left(display_name(name), F.lit(1)))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, or the empty text."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stable_id(*parts: Column) -> Column:
    """A reproducible id for what the parts name."""
    return F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)


def section_display(path: Column) -> Column:
    return F.array_join(path, " > ")


def page_label(first: Column, last: Column) -> Column:
    return F.format_string("[p%d-%d]", first, last)


def rerank_input(query: Column, document: Column) -> Column:
    return F.concat(query, F.lit(" [SEP] "), document)


def prompt(system: Column, context: Column, question: Column) -> Column:
    return F.concat(system, F.lit("\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def report_card(username: Column, question: Column, answer: Column, count: Column) -> Column:
    """(title, text) of the message about an answer that a user reports."""
    said = zip(CARD, (display_name(username, "anonymous"), question, answer, count.cast("string")))
    parts = [x for label, value in said for x in (F.lit(label), value)]
    return F.struct(F.lit(CARD_TITLE).alias("title"), F.concat(*parts).alias("text"))


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with one decimal, half away from zero."""
    return F.round(ms.cast("decimal(20,3)") / 1000, 1).cast("double")


def split_recursively(text: str, size: int = 2000, overlap: int = 300, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Split at the first separator that occurs, deeper where parts are too long, and merge parts up to size.

    Pieces overlap by whole parts of at most ``overlap`` characters together.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, deeper = separators[k], separators[k + 1 :]
    parts = list(text) if separator == "" else [p for p in text.split(separator) if p]
    out: list[str] = []
    window: list[str] = []
    used = 0

    def flush() -> None:
        if window:
            piece = separator.join(window).strip()
            if piece:
                out.append(piece)

    for part in parts:
        if len(part) > size and deeper:
            flush()
            window, used = [], 0
            out.extend(split_recursively(part, size, overlap, deeper))
            continue
        joined = used + len(part) + (len(separator) if window else 0)
        if joined > size and window:
            flush()
            while window and (used > overlap or used + len(part) + len(separator) > size):
                used -= len(window[0]) + (len(separator) if len(window) > 1 else 0)
                window.pop(0)
        used += len(part) + (len(separator) if window else 0)
        window.append(part)
    flush()
    return out


def character_chunks(size: int = 2000, overlap: int = 300) -> Callable[[Column | str], Column]:
    """split_recursively with these sizes, for a text column."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [] if s is None else split_recursively(s, size, overlap))

    return split
