"""Literal cases of text functions, headings, paths and counts, and properties against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import structure, text
from textloom.operators import chunking
from textloom.plans.pages import page_blocks
from textloom.session import ship


def values(spark, inputs, expression):
    ship(spark)
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, s string")
    return [r[0] for r in rows.select("i", expression(F.col("s")).alias("o")).orderBy("i").select("o").collect()]


def test_normalise(spark):
    cases = {
        "EEnnaabbllee": "Enable", "book keeper": "book keeper", "1111111": "1111", "------": "---", "aabb": "aabb", "trans-\nfer": "transfer",
        "trans-\n  fer": "trans-\nfer", "a-\nb-\nc": "ab-\nc", "FIPS   mode\t on": "FIPS mode on", "ﬁle Ｎｏ１": "file No1", "  a \n  b  ": "a\nb", "": "",
    }
    assert values(spark, cases, text.normalise) == list(cases.values())


def test_undouble_equals_its_definition(spark):
    def plain(line):
        pairs = sum(a == b for a, b in zip(line, line[1:]))
        if len(line) < 6 or pairs < 0.35 * len(line):
            return line
        out, i = [], 0
        while i < len(line):
            out.append(line[i])
            i += 2 if i + 1 < len(line) and line[i] == line[i + 1] else 1
        return "".join(out)

    rng = random.Random(5)
    lines = ["".join(rng.choice("aab é😀") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert values(spark, lines, text.undouble) == [plain(x) for x in lines]


def test_heading_levels(spark):
    cases = {
        "1 Overview": 1, "1.2 Install Server": 2, "1.2.3.4 Deep": 3, "1.2.3.4.5 Deeper": None, "1. Click Save": None, "3 users are connected.": 1,
        "NETWORK SETTINGS": 1, "123": 1, "42": None, "---": 1, "Installing the server": 2, "Use TLS 1.2": None, "Überblick": None, "END.": None, "FAQ?": None,
        "Abc": 2, "Ab": None, "A" * 140: 1, "A" * 141: None, "A" + "b" * 120: 2, "A" + "b" * 121: None, "   ": None,
    }
    got = values(spark, cases, lambda s: F.when(structure.is_heading(s), structure.heading_level(s)))
    assert got == list(cases.values())


TITLES = {1: "HEAD {}", 2: "1.2 Head {}", 3: "1.2.3 Head {}"}


def test_section_paths_equal_a_stack(spark):
    rng = random.Random(2)
    docs = [[1, 2, 3], [1, 3, 2], [2, 1, 3], [3, 3]] + [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows, want = [], {}
    for d, levels in enumerate(docs):
        stack = []
        for i, level in enumerate(levels):
            title = TITLES[level].format(i)
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
            rows.append((d, i, title, 1))
            want[d, i] = [t for _, t in stack]
    got = chunking.sections(spark.createDataFrame(rows, "doc_id long, block_no int, text string, page int")).collect()
    assert {(r.doc_id, r.block_no): r.section_path for r in got} == want


def paras(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, para_no int, para string, type string, page int")
    return frame.select("*", F.lit(0).alias("section_no"), F.lit(1).alias("run"), F.array().cast("array<string>").alias("section_path"))


def test_concept_windows_equal_a_loop(spark):
    rng = random.Random(4)
    docs = {d: [rng.randint(1, 900) for _ in range(rng.randint(1, 9))] for d in range(12)} | {100: [1000], 101: [1001], 102: [1850], 103: [1851], 104: [2700]}
    rows = [(d, i, " ".join(["w"] * n), "concept", i) for d, ns in docs.items() for i, n in enumerate(ns)]
    want = {}
    for d, ns in docs.items():
        start, k, total = 0, 0, sum(ns)
        while True:
            at, inside = 0, []
            for i, n in enumerate(ns):
                if at + n > start and at < start + 1000:
                    inside.append(i)
                at += n
            want[d, k] = "\n\n".join(" ".join(["w"] * ns[i]) for i in inside)
            if start + 1000 >= total:
                break
            start, k = start + 850, k + 1
    got = chunking.concept_windows(paras(spark, rows)).collect()
    assert {(r.doc_id, r.ordinal): r.text for r in got} == want
    assert {(r.page_start, r.page_end) for r in got if r.doc_id == 0} == {(0, len(docs[0]) - 1)}
    with pytest.raises(ValueError):
        chunking.concept_windows(paras(spark, rows), 100, 100)


def test_procedure_packing(spark):
    docs = {1: [200, 200, 100, 460, 10], 2: [450, 1], 3: [5]}
    rows = [(d, i, "x" * (4 * n), "procedure", i) for d, ns in docs.items() for i, n in enumerate(ns)]
    got = chunking.procedure_chunks(paras(spark, rows)).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.page_start, r.page_end) for r in got] == [(1, 0, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 0, 0), (2, 1, 1), (3, 0, 0)]


def test_counts_and_think(spark):
    assert values(spark, ["x" * n for n in (0, 4, 5, 76, 77, 80)], text.token_count) == [1, 1, 2, 19, 20, 20]
    assert values(spark, ["", " a  b\n c "], text.space_tokens) == [0, 3]
    think = "x<think> a </think>y<think>b\nc</think>z"
    assert values(spark, [think, "<think>open"], text.visible) == ["xyz", "<think>open"]
    assert values(spark, [think, "<think>open"], text.thinking) == ["a\n\nb\nc", ""]


def test_tables_and_lists(spark):
    grid = "a  b\nc\td\ne   f"
    assert values(spark, [grid, "- a\n- b\n- c", "To set up a thing", "prose\nonly"], structure.paragraph_type) == ["table", "procedure", "procedure", "concept"]


def test_character_chunks():
    rng = random.Random(9)
    for _ in range(50):
        words = ["w" * rng.randint(1, 60) for _ in range(rng.randint(1, 300))]
        whole = "".join(w + rng.choice([" ", "\n", "\n\n"]) for w in words)
        pieces = text.split_recursively(whole, 200, 30)
        assert all(len(p) <= 200 for p in pieces)
        assert set(whole.split()) == set(" ".join(pieces).split())
    assert text.split_recursively("x" * 450, 200, 0) == ["x" * 200, "x" * 200, "x" * 50]
    with pytest.raises(ValueError):
        text.split_recursively("x", 10, 10)


def test_empty_blocks(spark):
    none = spark.createDataFrame([], "doc_id long, block_no int, text string, page int")
    assert chunking.chunk(none).count() == 0
    blank = spark.createDataFrame([(1, 0, " \n ", 1)], "doc_id long, block_no int, text string, page int")
    assert chunking.chunk(blank).count() == 0


def test_chunks_type_their_paragraphs_once(spark):
    """The three kinds of chunks go on from written paragraphs; before, each found headings and types again."""
    pages = spark.createDataFrame([(1, "<p>" + "</p><p>".join(f"Words of paragraph {i}. " * 9 for i in range(8)) + "</p>"), (2, None), (3, "none")], "page_id long, html string")
    chunks = chunking.chunk(page_blocks(pages))
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "section_no" in plan and "isHeading" not in plan and "is_heading" not in plan
    assert {r.doc_id for r in chunks.collect()} == {1}


def test_page_blocks_find_paragraphs_once(spark):
    """A generator that is no outer one makes Spark find them a second time, to filter."""
    pages = spark.createDataFrame([(1, "<p>a. b</p><p>c</p>"), (2, None), (3, "none")], "page_id long, html string")
    blocks = page_blocks(pages)
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [(r.doc_id, r.block_no, r.text) for r in blocks.orderBy("doc_id", "block_no").collect()] == [(1, 0, "1 Topic 0"), (1, 3, "a. b"), (1, 5, "- c"), (1, 7, "c")]
