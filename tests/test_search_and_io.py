"""Search and fusion against plain definitions, files, keyed updates and the answer stream."""

import io
import json
import random
import re
import threading
import tracemalloc
import zipfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.functions.text import STREAM_FAILED
from textloom.operators import search, sessions, tfidf
from textloom.plans import retrieval
from textloom.plans.ingest import blocks_of_lines
from textloom.sources import readers, writers
from textloom.streaming import answers as streams


def test_dense_hits_in_one_matrix_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v, q = rng.integers(-3, 4, (300, 8)), rng.integers(-3, 4, (9, 8))
    v[0], q[:, 0] = 0, 1
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "doc_id long, vector array<float>")
    queries = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id long, vector array<float>")
    norm = lambda x: np.where((n := np.sqrt((x**2).sum(1))) > 0, n, 1)
    scores = np.round((q @ v.T) / norm(q)[:, None] / norm(v), 9)
    want = {(a, int(b), k + 1) for a in range(9) for k, b in enumerate(np.lexsort((np.arange(300), -scores[a]))[:7])}
    for most, strip in ((2048, 32768), (4, 50)):
        monkeypatch.setattr(search, "BROADCAST_QUERIES", most)
        monkeypatch.setattr(search, "STRIP_ROWS", strip)
        assert {(r.query_id, r.doc_id, r.rank) for r in search.dense_hits(vectors, queries, 7).collect()} == want


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def test_fusion(spark):
    a, b = hits(spark, [(1, 7, 0.9, 1), (1, 8, 0.8, 2)]), hits(spark, [(1, 7, 5.0, 1), (1, 9, 4.0, 2)])
    got = search.fuse(a, b).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [7, 8, 9]
    assert got[0].score == round(2 / 61, 9)
    swapped = search.fuse(b, a).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in swapped] == [(r.doc_id, r.score) for r in got]
    one = search.fuse(hits(spark, [(1, 7, 0.9, 1)]), hits(spark, [])).first()
    assert abs(one.score - 1 / 61) < 2e-9


def test_thresholds_and_confidence(spark):
    h = hits(spark, [(1, 7, 0.9, 1), (1, 8, 0.5, 2)])
    assert [r.doc_id for r in search.threshold(h).collect()] == [8]
    assert [r.doc_id for r in search.threshold(h, keep="at_least").collect()] == [7]
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    scored = h.withColumn("rerank_score", F.col("score"))
    assert {tuple(r) for r in search.confidence(scored, asked).collect()} == {(1, 0.7, 2), (2, 0.0, 0)}


def test_tfidf_drops_unknown_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox runs red"), (2, "red fox sleeps"), (3, "blue bird"), (4, None)], "doc_id long, text string")
    rows = tfidf.document_terms(docs)
    vocabulary = tfidf.fit(rows, 4)
    assert [(r.term, r.df) for r in vocabulary.orderBy("term_id").collect()] == [("fox", 2), ("red", 2), ("red fox", 2)]
    tfidf.save_model(vocabulary, str(tmp_path / "model"))
    stored = tfidf.load_model(spark, str(tmp_path / "model"))
    got = {r.doc_id: (r.indices, r["values"]) for r in tfidf.sparse_rows(rows, stored).collect()}
    assert got[3] == got[4] == ([], []) and got[1][0] == [0, 1, 2] and got[1][1][1] == 2 * got[1][1][0]
    assert all(abs(sum(x * x for x in got[i][1]) - 1) < 1e-9 for i in (1, 2))
    with pytest.raises(ValueError):
        tfidf.sparse_rows(rows, stored, max_features=2)
    assert tfidf.sparse_rows(rows, stored.limit(0)).where("size(indices) > 0").count() == 0


def test_sparse_hits_in_postings_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    make = lambda n, key: [(i, *(list(map(list, zip(*sorted((int(t), float(rng.integers(1, 4))) for t in rng.choice(30, rng.integers(0, 6), replace=False))))) or [[], []])) for i in range(n)]
    docs, asked = make(300, "doc_id"), make(9, "query_id")
    want = set()
    for q, terms, weights in asked:
        scores = [(-sum(w * dict(zip(terms, weights)).get(t, 0) for t, w in zip(ts, ws)), i) for i, ts, ws in docs if set(ts) & set(terms)]
        want |= {(q, i, k + 1, -s) for k, (s, i) in enumerate(sorted(scores)[:7])}
    frames = [spark.createDataFrame(rows, f"{key} long, indices array<int>, values array<double>") for rows, key in ((docs, "doc_id"), (asked, "query_id"))]
    for most, strip, scores in ((2048, 32768, 1 << 20), (2048, 32768, 20), (4, 50, 1 << 20)):
        for name, value in (("BROADCAST_QUERIES", most), ("STRIP_ROWS", strip), ("SCORES", scores)):
            monkeypatch.setattr(search, name, value)
        assert {(r.query_id, r.doc_id, r.rank, r.score) for r in search.sparse_hits(*frames, 7).collect()} == want
    assert search.sparse_hits(frames[0], frames[1].limit(0)).count() == 0 and search.sparse_hits(frames[0].limit(0), frames[1]).count() == 0


def test_retrieval_without_a_sparse_model_is_dense_and_filtered(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "doc_id long, vector array<float>")
    asked = spark.createDataFrame([(1, "red", [1.0, 0.0])], "query_id long, text string, vector array<float>")
    docs = spark.createDataFrame([(1, "red fox"), (2, "red bird"), (3, "blue fox")], "doc_id long, text string")
    config = Config(final=2, score_threshold=0.8)
    found = lambda **x: [r.doc_id for r in retrieval.retrieve(None, vectors, asked, asked, config, **x).orderBy("rank").collect()]
    assert found() == [3] and found(keep="at_least") == [1]
    both = retrieval.retrieve(retrieval.sparse_model(docs, min_df=1), vectors, asked, asked, config).orderBy("rank").collect()
    assert [r.doc_id for r in both] == [1, 2] and both[0].score > both[1].score


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_load_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    stream = zlib.compress(rb"BT (Hello \(PDF\)) Tj T* (second) Tj ET")
    files = {
        "b.docx": _zip({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:p><w:r><w:t>there</w:t></w:r></w:p></w:body></w:document>"}),
        "a.XLSX": _zip({"xl/worksheets/sheet1.xml": f'<worksheet {x}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>', "xl/sharedStrings.xml": f"<sst {x}><si><t>n</t></si></sst>"}),
        "c.pdf": b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>>\nstream\n" + stream + b"\nendstream",
        "d.txt": "plain ü".encode(), "e.zip": b"?", "f.docx": b"broken",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = readers.load_files(spark, [str(tmp_path / n) for n in files]).orderBy("file_ordinal").collect()
    assert [r.page_content for r in got] == ["Hi\nthere", "n\t7", "Hello (PDF)\nsecond", "plain ü", None, None]
    assert [r.part for r in got] == [0] * 6
    assert [bool(r.error) for r in got] == [False] * 4 + [True] * 2


def test_files_are_numbered_by_their_whole_path(spark, tmp_path):
    names = []
    for folder, body in (("y", "why"), ("x", "ex")):
        (tmp_path / folder).mkdir()
        names.append(str(tmp_path / folder / "same.txt"))
        (tmp_path / folder / "same.txt").write_text(body)
    (tmp_path / "t b.csv").write_text('a,b\n1,"two\nlines"\n\n3\n')
    (tmp_path / "empty.csv").write_text("a,b\n")
    names += [str(tmp_path / "t b.csv"), names[0], str(tmp_path / "empty.csv")]
    got = readers.load_files(spark, names).orderBy("file_ordinal", "part").collect()
    assert [(r.file_ordinal, r.part, r.page_content) for r in got] == [(0, 0, "why"), (1, 0, "ex"), (2, 0, "a: 1\nb: two\nlines"), (2, 1, "a: 3\nb: "), (3, 0, "why"), (4, 0, None)]
    assert got[-1].error == "no text"


def test_page_lines_and_blocks(spark):
    docs = spark.createDataFrame([("d", "1 Top  \r\n\r\nEEnnaabbllee\nit trans-\nfers\fnext page\n   \n\u00a0x \u00a0"), ("e", "\f\n")], "doc_id string, page_content string")
    got = [(r.doc_id, r.block_no, r.page, r.text) for r in blocks_of_lines(readers.page_lines(docs)).orderBy("doc_id", "block_no").collect()]
    assert got == [("d", 0, 1, "1 Top"), ("d", 1, 1, "Enable\nit transfers"), ("d", 2, 2, "next page"), ("d", 3, 2, "x")]


def test_choose_text_of_repeated_strategies(spark):
    rows = spark.createDataFrame([("p", "fast", "ab"), ("p", "fast", "abc"), ("p", "layout", "ab"), ("q", "fast", None)], "path string, strategy string, text string")
    assert {tuple(r) for r in readers.choose_text(rows).collect()} == {("p", "abc", "fast", None), ("q", "", "fast", "no text")}


def test_points_are_sent_in_batches(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Store(BaseHTTPRequestHandler):
        def do_PUT(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["points"])
            self.send_response(500 if self.path == "/bad" else 200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    points = spark.range(600).coalesce(1).select(F.col("id"), F.array(F.lit(0.5), F.lit(None)).alias("dense"), F.struct(F.create_map(F.lit("a"), F.lit(True)).alias("flags")).alias("payload"))
    assert sorted(r.batch_rows for r in writers.send_points(points, lambda: writers.rest_client(f"{url}/ok")).collect()) == [88, 256, 256]
    assert sorted(p["id"] for batch in got for p in batch) == list(range(600)) and got[0][0]["dense"] == [0.5, None]
    with pytest.raises(Exception, match="500"):
        writers.send_points(points, lambda: writers.rest_client(f"{url}/bad")).collect()
    server.shutdown()


def test_upsert_is_repeatable(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = writers.upsert(old, new, "k")
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in writers.upsert(once, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in writers.insert_or_ignore(old, new, "k").collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_upsert_of_nested_rows_keeps_the_latest(spark):
    rows = lambda *xs: spark.createDataFrame([(k, {v: True}, [1.0], n) for k, v, n in xs], "k long, flags map<string,boolean>, dense array<float>, n int")
    old, new = rows((1, "a", 0), (2, "b", 0), (None, "x", 0)), rows((2, "z", 1), (2, "c", 3), (2, "y", 2), (3, "d", 0))
    got = {(r.k, *r.flags) for r in writers.upsert(old, new, "k", F.col("n")).collect()}
    assert got == {(1, "a"), (2, "c"), (3, "d"), (None, "x")}
    assert {(r.k, *r.flags) for r in writers.insert_or_ignore(old, new, "k").collect()} == {(1, "a"), (2, "b"), (3, "d"), (None, "x")}


def _events(spark):
    turns = spark.createDataFrame([(i, 1, "assistant", " ".join(f'w"{j}' for j in range(i))) for i in range(1, 20)], "conv_id long, turn long, role string, text string")
    events = sessions.answer_events(sessions.turn_answers(turns))
    bad = F.col("query_id").isin("3-1", "7-1", "11-1")
    failed = events.where(bad & (F.col("seq") == 0)).select("query_id", F.lit(2).alias("seq"), F.lit("error").alias("event"), F.lit("oops").alias("data"))
    return events.where(~bad | (F.col("seq") < 2)).unionByName(failed)


def test_stream_equals_batch(spark, tmp_path):
    events = _events(spark)
    events.unionByName(events.where("event = 'token'")).repartition(6).write.parquet(str(tmp_path / "events"))  # tokens come twice
    streams.run_available(streams.fold_stream(streams.read_events(spark, str(tmp_path / "events"), 1)), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = {tuple(r) for r in sessions.fold_answers(events).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    assert {(r.query_id, r.content) for r in sessions.fold_answers(events).where("error").collect()} == {(f"{i}-1", STREAM_FAILED) for i in (3, 7, 11)}


def test_frames_and_defaults(spark):
    rows = [("a", 0, "sources", "not json"), ("a", 1, "token", '{"token":"x "}'), ("a", 2, "token", '{"token":"y"}'), ("b", 0, "sources", '{"sources":[{"page_content":"p"}],"num_sources":1,"confidence_score":0.25}')]
    events = spark.createDataFrame(rows, "query_id string, seq int, event string, data string")
    a, b = sessions.fold_answers(events).orderBy("query_id").collect()
    assert (a.content, a.sources, a.num_sources, a.confidence, a.ended, a.error) == ("x y", "[]", 0, None, False, False)
    assert (b.content, b.sources, b.num_sources, b.confidence) == ("", '[{"page_content":"p"}]', 1, 0.25)
    assert writers.server_events(events).where("seq = 2").first().frame == 'event: token\ndata: {"token":"y"}\n\n'


class State:
    """What gather needs of a group's state."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_answers_that_stop_are_given_up():
    part = lambda *rows: iter([pd.DataFrame(rows, columns=["seq", "event", "data"])])
    state = State()
    assert not list(streams.gather(("q",), part((0, "sources", "{}"), (2, "end", "{}")), state, 500)) and state.timeout == 500
    state.hasTimedOut = True
    (row,) = streams.gather(("q",), iter([]), state, 500)
    assert [e["seq"] for e in row["events"][0]] == [0, 2] and not state.exists
    state = State()
    assert len(list(streams.gather(("q",), part((0, "error", "x")), state, 500))) == 1
    assert not list(streams.gather(("q",), part((1, "token", "x"), (0, "error", "x")), state, 500))  # late events
    state.hasTimedOut = True
    assert not list(streams.gather(("q",), iter([]), state, 500)) and not state.exists


def test_buckets_gather_as_answers_do_one_by_one():
    rng = random.Random(5)
    events = []
    for i in range(60):
        n = rng.randint(1, 12)
        last = rng.choice(["end", "end", "error", "token"])  # some never end
        events += [(f"q{i}" if i else None, s, "token" if s < n else last, f"{i}.{s}") for s in range(n + 1) if rng.random() > 0.02]
    events += rng.sample(events, 50)  # come twice, some of them late
    rng.shuffle(events)
    frame = lambda rows: pd.DataFrame(rows, columns=["query_id", "seq", "event", "data"])
    bucket, states, got, plain = State(), {}, [], []
    for trigger in (events[:200], events[200:201], events[201:]):
        parts = [frame(trigger[:90]), frame(trigger[90:])]
        for out in streams.gather_many((0,), iter(p for p in parts if len(p)), bucket):
            got += [(r.query_id, sorted(zip(map(int, r.seq), r.event, r.data))) for r in out.itertuples()]
        for q in dict.fromkeys(e[0] for e in trigger):
            for out in streams.gather((q,), iter([frame([e for e in trigger if e[0] == q])]), states.setdefault(q, State())):
                plain += [(q, sorted((e["seq"], e["event"], e["data"]) for e in r)) for r in out["events"]]
    assert sorted(got, key=str) == sorted(plain, key=str) and len(got) > 20 and bucket.exists
    done = State()
    assert len(list(streams.gather_many((0,), iter([frame([("a", 0, "sources", "{}"), ("a", 1, "end", "{}")])]), done))) == 1 and not done.exists


def test_stream_keeps_answers_by_buckets(spark, tmp_path, monkeypatch):
    """Before, each answer was a group of its own, whose call took longer than its events."""
    monkeypatch.setattr(streams, "BUCKETS", 2)
    events = _events(spark)
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    run = streams.run_available(streams.fold_stream(streams.read_events(spark, str(tmp_path / "events"), 1)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 2
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {tuple(r) for r in sessions.fold_answers(events).collect()}


def test_report_numbers_keep_reports_without_a_time(spark):
    rows = spark.sql("select * from values (1, timestamp'2024-01-02 10:00:00'), (2, null), (3, timestamp'2024-01-01 00:00:00'), (4, null) as t(k, at)")
    assert {r.k: r.report_no for r in sessions.report_numbers(rows, "at", "k").collect()} == {2: 1, 4: 2, 3: 3, 1: 4}


def test_report_states(spark):
    cases = {"idle": "fail ok fail", "sending": "report report", "error": "report fail ok", "done": "report fail report report ok report fail"}
    rows = [(k, i, a) for k, acts in cases.items() for i, a in enumerate(acts.split())] + [("none", 0, "other")]
    got = sessions.report_states(spark.createDataFrame(rows, "k string, at int, act string"), "k", "act", "at", "at").collect()
    assert {(r.k, r.state, r.sent) for r in got} == {("idle", "idle", 0), ("sending", "sending", 1), ("error", "error", 1), ("done", "done", 2), ("none", "idle", 0)}


def test_sessions_fall_back_to_the_newest(spark):
    chats = spark.createDataFrame([(1,), (4,), (9,)], "conv_id long")
    assert [sessions.active_session(chats, *x).first().active for x in ((4, 1), (4, 4), (9, 9))] == [4, 9, 4]
    assert sessions.active_session(chats.where("conv_id = 1"), 1, 1).first().active is None


def test_vocabulary_is_cut_without_one_task_seeing_many_terms(spark, monkeypatch):
    """Against plain counts, with ties at the cut; the table that is sorted at last is bounded by max_features, not by the number of tasks."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{x}é" if x % 3 else f"W{x}-a" for x in rng.zipf(1.3, 40) % 3000)) for i in range(400)] + [(400, None), (401, "ab á cd")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    monkeypatch.setattr(tfidf, "SLICE_BYTES", 3000)
    monkeypatch.setattr(tfidf, "SAMPLE", 200)
    df, total = Counter(), Counter()
    for _, text in docs:
        words = [w for w in re.split(r"[^\ẃ]+", (text or "").lower()) if len(w) > 1]
        found = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
        df.update(found.keys())
        total.update(found)
    order = sorted((t for t in df if 2 <= df[t] <= 0.9 * len(docs)), key=lambda t: (-total[t], t))
    rows = tfidf.document_terms(frame)
    for n in (7, 300, len(order), 10**6):
        got = [(r.term, r.term_id, r.df) for r in tfidf.fit(rows, len(docs), max_features=n).orderBy("term_id").collect()]
        assert got == [(t, k, df[t]) for k, t in enumerate(sorted(order[:n]))]
    counts = spark.createDataFrame([(f"t{i:05}", 2, 2 + i % 3) for i in range(20000)], "term string, df long, total long")
    assert 100 <= tfidf._frequent(counts, 100).count() < 8000


def test_postings_of_common_terms_are_met_in_parts():
    """100 queries and 1000 documents that share 50 terms: five million meetings, of which few are held at a time."""
    n, m, terms = 100, 1000, 50
    rows = lambda k: (np.arange(k), np.full(k, terms), np.tile(np.arange(terms, dtype=np.int32), k), np.linspace(1, 2, k).repeat(terms))
    postings = search._Postings(*rows(n))
    tracemalloc.start()
    got = postings.hits(*rows(m), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    assert {(q, d) for q, d in zip(got.column(0).to_pylist(), got.column(1).to_pylist())} == {(q, d) for q in range(n) for d in (m - 1, m - 2, m - 3)}
