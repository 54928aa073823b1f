"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a condition over the text and its measures. The measures are
results by themselves, so every text gets them; what a rule alone needs (words
with a letter, distinct words, shapes of lines) it works out inside its
condition. On a bounded sample the operator times every rule, several times over,
and sees how much it rejects; rules then run in order of rejection per cost in
one CASE, so a text that an early rule rejects costs no more rules. The order
changes the work, never the verdict.

Repeated windows are found without a sorted table of windows: a window becomes
one number, hash bits above and place below, so a sort of plain numbers brings
windows with equal hash bits together. Those alone are compared by whole hashes.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused, word_count

#: Rows of the sample from which rules are ordered, how often each is worked off in a run, and runs of which the median counts.
SAMPLE_ROWS, SAMPLE_TIMES, RUNS = 1000, 4, 3
SPACE = " \t\n\x0b\x0c\r"
ITEM, BROKEN = r"^[\x20\x09-\x0D]*[-*•]", r"(\.\.\.|…)[\x20\x09-\x0D]*\z"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A text fails if ``fails`` holds for its row, which has the text and its measures."""

    name: str
    fails: Column


def base_rules() -> list[Rule]:
    """Too short, or mostly words of repeated three-word windows."""
    c = F.col
    return [
        Rule("too_few_words", c("n_words") < 50),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
    ]


def letter_words(text: Column) -> Column:
    """Number of words with a letter; null text has none. Without all else, they are the words that are left: linear for any text."""
    return word_count(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", ""))


def method_rules(text: str = "text", words: str = "words", lines: str = "lines") -> list[Rule]:
    """Bounds that plain prose keeps.

    Of measures: word length, symbols, repeated lines. Worked out here: words
    with a letter, distinct words (a tenth of all, or a hundred), and lines that
    are list items or break off. text, words, lines: names of these columns.
    """
    c = F.col
    like = lambda pattern: F.size(F.filter(c(f"`{lines}`"), lambda x: x.rlike(pattern)))
    return [
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        Rule("symbols", 10 * c("n_symbols") > 3 * c("n_words")),
        Rule("repeated_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        Rule("few_letters", 100 * letter_words(c(f"`{text}`")) < 60 * c("n_words")),
        Rule("few_distinct_words", 10 * F.size(F.array_distinct(c(f"`{words}`"))) < F.least(c("n_words"), F.lit(1000))),
        Rule("list_items", (c("n_lines") >= 10) & (10 * like(ITEM) > 9 * c("n_lines"))),
        Rule("broken_lines", (c("n_lines") >= 10) & (10 * like(BROKEN) > 3 * c("n_lines"))),
    ]


def _split(text: Column) -> Column:
    """The words of a text: all white space becomes blanks, at which plain splitting is fast."""
    for x in SPACE[1:]:
        text = F.replace(text, F.lit(x), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _after(xs: Column, n: int) -> Column:
    return F.slice(xs, n + 1, F.size(xs))


def _windows(hashes: Column) -> Column:
    """Hashes of the three-word windows, from a column of word hashes."""
    two = F.zip_with(hashes, _after(hashes, 1), lambda x, y: F.xxhash64(x, y))
    three = F.zip_with(two, _after(hashes, 2), lambda x, y: F.xxhash64(x, y))
    return F.slice(three, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))


def _packed(windows: Column, low: Column) -> Column:
    """Of each window its hash bits above ``low`` and its place in the bits of ``low``, in order."""
    return F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))


def _candidates(packed: Column, low: Column) -> Column:
    """Places of windows that share their hash bits with the next in order or the one before; all that are found twice are among them."""
    place = lambda x: x.bitwiseAND(low).cast("int")
    alike = lambda x, y: F.bitwise_not(low).bitwiseAND(x.bitwiseXOR(y)) == 0
    pairs = F.zip_with(packed, _after(packed, 1), lambda x, y: F.when(alike(x, y), F.array(place(x), place(y))))
    return F.array_distinct(F.flatten(F.array_compact(pairs)))


def _repeated(placed: Column) -> Column:
    """Sorted places of the windows that are found twice or more; placed: a column of (hash, place) in order."""
    twice = lambda x, j: F.coalesce(x["h"] == F.get(placed, j + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(placed, j - 1)["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(placed, twice), lambda x: x["i"]))


def _measured(df: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """df with its measures and inner columns, whose names come second: text, words and lines first."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in MEASURES]
    names = unused(df, "text", "words", "lines", "low", "hashes", "windows", "packed", "candidates", "placed", "repeated")
    text, words, lines, low, hashes, windows, packed, candidates, placed, repeated = names
    t, ws = F.col(text), F.col(words)
    out = df.select(*kept, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    out = out.withColumns({
        words: _split(t),
        lines: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
    })
    out = out.withColumns({
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        low: F.expr(f"shiftleft(1L, length(bin(size(`{words}`)))) - 1"),
        hashes: F.transform(ws, lambda w: F.xxhash64(w)),
    })
    out = out.withColumn(windows, _windows(F.col(hashes)))
    out = out.withColumn(packed, _packed(F.col(windows), F.col(low)))
    out = out.withColumn(candidates, _candidates(F.col(packed), F.col(low)))
    pairs = F.transform(F.col(candidates), lambda i: F.struct(F.get(F.col(windows), i).alias("h"), i.alias("i")))
    out = out.withColumn(placed, F.sort_array(pairs))
    out = out.withColumn(repeated, _repeated(F.col(placed)))
    r = F.col(repeated)
    gaps = F.zip_with(r, F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda a, b: a + b).cast("long")), names


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures to df's columns.

    Lines are split at line feeds; a window is named by a 64-bit hash of its
    words within its own text. Null text counts as empty. Columns of df that
    have a measure's name are replaced.
    """
    out, inner = _measured(df, text_col)
    return out.drop(*inner)


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by share of rejected sample rows per second that the rule adds to reading the sample (of which a fiftieth is the least that counts)."""
    sample = cut(sample)
    rows = max(1, sample.count())
    (again,) = unused(sample, "again")
    timed = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_TIMES))).alias(again))

    def seconds_and_rejected(column: Column) -> tuple[float, int]:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected = timed.agg(F.coalesce(F.sum(column.cast("int")), F.lit(0)).alias("n")).first()["n"]
            took.append(time.perf_counter() - began)
        return median(took), rejected

    idle, _ = seconds_and_rejected(F.lit(False))
    worth = {}
    for rule in rules:
        seconds, rejected = seconds_and_rejected(rule.fails)
        worth[rule.name] = rejected / (rows * SAMPLE_TIMES) / max(seconds - idle, idle / 50)
    return sorted(rules, key=lambda rule: (-worth[rule.name], rule.name))


def cascade_of(rules: list[Rule]) -> Column:
    """Whether one of the rules holds; rules after the first that does are not worked out."""
    fails = F.lit(False)
    for rule in reversed(rules):
        fails = F.when(rule.fails, F.lit(True)).otherwise(fails)
    return fails


def quality_rules(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """df with its measures, ``base_failed`` and ``kept``; every row stays.

    rules: in place of method_rules, over df's columns and the measures. Columns
    of df that have a measure's name or one of these two are replaced. Empty and
    null texts have no words and fail the base rules. Equal rows get equal
    verdicts. An empty table gives an empty table.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in (*MEASURES, "base_failed", "kept")])
    base = base_rules()
    measured, inner = _measured(df, text_col)
    rules = method_rules(*inner[:3]) if rules is None else rules
    sample = cut(df.sample(min(1.0, sample_rows / max(1, df.count())), seed=seed))
    cascade = order_rules(_measured(sample, text_col)[0].drop(*inner[3:]), base + rules)
    judged = measured.withColumns({"base_failed": base[0].fails | base[1].fails, "kept": ~cascade_of(cascade)})
    return judged.drop(*inner)


#: DuckDB SQL for the rows of op6. Windows are compared as words, not as hashes.
RULES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM docs),
spots AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM split WHERE len(ws) >= 3),
wins AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM spots),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM wins) WHERE c > 1),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(regexp_extract_all(t, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*'))::BIGINT AS n_letter_words,
         len(list_distinct(ws)) AS n_distinct_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_items,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS n_broken,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_letter_words < 60 * n_words OR 10 * n_distinct_words < least(n_words, 1000)
            OR (n_lines >= 10 AND (10 * n_items > 9 * n_lines OR 10 * n_broken > 3 * n_lines))) AS kept
FROM judged
"""


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
