"""Predicates on lines and paragraphs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Patterns that decide on structure, for stripped lines unless noted.
NUMBERED = r"(?U)^\d+(\.\d+){0,3}\s+\S"
ALL_CAPS = r"^[A-Z0-9 \-_/]{3,}$"
TITLE_LIKE = r"^[A-Z][^.!?]{2,120}$"
BULLET = r"(?U)^\s*([•\-\*\u2022\u25E6\u00B7]|\d+[\.\)])\s+"
PROCEDURE = r"(?iU)\b(Procedure|Steps|Step|To (configure|set up|enable|create))\b"
COLUMNS = r"(?U)\s{2,}|\t"
LONGEST_HEADING = 140


def is_heading(line: Column) -> Column:
    """Rules in order: blank or too long, numbered, sentence, capitals, title."""
    s = strip(line)
    return (
        F.when((s == "") | (F.length(s) > LONGEST_HEADING), False)
        .when(s.rlike(NUMBERED), True)
        .when(s.endswith("."), False)
        .when(s.rlike(ALL_CAPS), True)
        .otherwise(s.rlike(TITLE_LIKE))
    )


def heading_level(title: Column) -> Column:
    """1 to 3, by the dots of a numbered heading; capitals 1, others 2."""
    s = strip(title)
    number = F.regexp_extract(s, r"(?U)^(\d+(?:\.\d+){0,3})\s", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(s.rlike(NUMBERED), F.least(F.lit(3), dots + 1)).when(s.rlike(ALL_CAPS), 1).otherwise(2).cast("int")


def is_heading_block(text: Column) -> Column:
    return ~F.contains(text, F.lit("\n")) & is_heading(text)


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def is_procedure(text: Column) -> Column:
    """Three bullet lines, or a word that announces steps."""
    return (F.size(F.filter(F.split(text, "\n"), is_bullet)) >= 3) | text.rlike(PROCEDURE)


def is_table(text: Column) -> Column:
    """Three lines of two columns or more, parted by a tab or two blanks. Lines are looked at where there are three."""
    rows = F.filter(F.split(text, "\n"), lambda x: (strip(x) != "") & (F.size(F.filter(F.split(strip(x), COLUMNS), lambda c: c != "")) >= 2))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(breaks < 2, False).otherwise(F.size(rows) >= 3)


def paragraph_type(text: Column) -> Column:
    return F.when(is_table(text), "table").when(is_procedure(text), "procedure").otherwise("concept")
