"""Each stage of the pipeline against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import line_crf, packing, simhash

from test_operators import water

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, before string, copies string, key1 string, size string, score string, bucket string, row string"
EXTRA = ["x"] * 7


def passages(rng):
    line = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(rng.choice([2, 5, 9, 20, 30, 55])))
    return [line() for _ in range(40)]


def documents():
    """Good and bad documents, shared passages, near copies, null and repeated ids, null and empty texts, equal rows."""
    rng = random.Random(31)
    pool, texts = passages(rng), []
    for i in range(60):
        own = [" ".join(f"word{rng.randint(0, 500)}" for _ in range(rng.randint(8, 25))) + "." for _ in range(rng.randint(2, 6))]
        at, take = rng.randrange(40), rng.randint(1, 4)
        where = rng.randint(0, len(own))
        lines = own[:where] + (pool[at : at + take] if i % 2 else []) + own[where:]
        texts.append("\n".join(dict.fromkeys(lines)))
    junk = ["\n".join("| # $ | %% *" for _ in range(rng.randint(2, 9))) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts + junk)]
    rows += [(200 + i, texts[i].replace("word1 ", "other ", 1)) for i in range(0, 20, 4)]  # near copies
    rows += [(None, texts[1]), (None, texts[2]), (None, None), (300, None), (301, ""), (302, " \n"), (3, texts[9]), (3, texts[3]), (3, texts[3]), (303, "w " * 30_000)]
    return [(i, t, "en", rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t), *EXTRA) for i, t in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(80)] + [(None, 1, 0), (7, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = line_crf.learn(docs, labels, line_crf.third(F.col("id")) != 1)
    every = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter(x for x in every if model.document_scores([(x[1] or "").encode()])[0] >= 0.5)
    got = rows_of(STAGES["quality"](spark, docs, sf_dir))
    assert got == want
    assert all((i, t) in got for i, t in every if i is not None and i < 60) and not any(60 <= i < 80 for i, _ in got if i is not None)


def test_line_dedup(spark, docs, sf_dir):
    size = lambda ls: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls)
    every = [(r.doc_id, r.text) for r in docs.collect()]
    left, seen = {}, set()
    for doc_id, text in sorted({x for x in every if x[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        left[doc_id, text] = None  # texts that share an id may come first in either order
    ids = Counter(i for i, _ in left)
    got = defaultdict(list)
    for r in STAGES["line_dedup"](spark, docs, sf_dir).collect():
        got[r.doc_id].append(r.text)
        assert r.n_chars == (None if r.text is None else len(r.text))
    for doc_id, text in left:
        lines = text.split("\n")
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if size(lines[a:b]) >= (16 if b - a > 1 else 50)]
        gone = {k for a, b in runs if tuple(lines[a:b]) in seen for k in range(a, b)}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if ids[doc_id] == 1 and lines[0] != "| # $ | %% *":  # junk repeats its own lines
            assert set(got[doc_id]) == ({kept} if kept.strip() or not gone else set()), doc_id
        seen |= {tuple(lines[a:b]) for a, b in runs}
    assert Counter(got[300]) == Counter([None]) and got[301] == [""] and got[302] == [" \n"]


def test_near_dedup(spark, docs, sf_dir):
    every = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [simhash.fingerprint((t or "").encode()) for _, t in every]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = defaultdict(list)
    for x, k in zip(every, label):
        groups[k].append(x)
    got = rows_of(STAGES["near_dedup"](spark, docs, sf_dir))
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        (kept,) = [x for x in set(members) if x in got]
        assert kept[0] == min((i for i, _ in members if i is not None), default=None)


def test_mix(spark, docs, sf_dir):
    """Against one sorted pass over each source: a copy for each integer that the sum of expected copies crosses."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    md5 = lambda t, n: int(hashlib.md5(t.encode()).hexdigest()[:n], 16)
    by = defaultdict(list)
    for r in docs.collect():
        n = words(r.text)
        by[r.source].append((len(f"{n:b}"), f"{n:b}"[:4], md5(f"17:{'' if r.doc_id is None else r.doc_id}", 15), n, r.doc_id))
    order = sorted((k for k in by if k is not None)) + [None]
    sizes = [sum(x[3] for x in by[k]) for k in order]
    want = Counter()
    for k, size, target in zip(order, sizes, water(sizes)):
        rate, u = target / size, md5(f"17/{k or ''}", 4) / 65536
        for place, (bits, lead, _, _, doc_id) in enumerate(sorted(by[k], key=lambda x: x[:3]), 1):
            over = rate - math.floor(rate)
            n = math.floor(rate) + math.floor(u + over * place) - math.floor(u + over * (place - 1))
            want[doc_id, k, bits, lead] += min(n, math.ceil(rate))
    got = Counter((r.doc_id, r.source, len(f"{words(r.text):b}"), f"{words(r.text):b}"[:4]) for r in STAGES["mix"](spark, docs, sf_dir).collect())
    assert got == +want


def test_pack(spark, docs, sf_dir):
    encode = packing.encoder("byte_bpe_50k").encode
    got = STAGES["pack"](spark, docs, sf_dir).collect()
    every = [(r.doc_id, len(encode(r.text or "")) + 1) for r in docs.collect()]
    assert sum(r.length for r in got) == sum(n for _, n in every) and Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in every)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and sum(n for _, n in parts) <= 1024


def test_stages_return_the_columns_and_take_empty_tables(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns), name
        assert name == "pack" or stage(spark, docs, sf_dir).columns == docs.columns


def test_the_whole_pipeline_on_odd_rows(spark, sf_dir):
    assert np.all([r.length > 0 for r in corpus_pipeline.run(spark, sf_dir).collect()])
