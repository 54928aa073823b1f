"""Settings, adaptive batches and uploads."""

import zlib

import numpy as np
import pytest

from textloom.__main__ import main
from textloom.config import Config
from textloom.operators import embedding
from textloom.plans.ingest import ingest, points_of_stage, upload
from textloom.session import shared_folder
from textloom.sources.writers import lacks_any, read_collection


def test_config_reads_the_environment():
    assert Config.from_env({}) == Config()
    assert Config.from_env({"TEXTLOOM_RRF_K": "10", "TEXTLOOM_SCORE_THRESHOLD": "0.5", "TEXTLOOM_FINAL": ""}) == Config(rrf_k=10, score_threshold=0.5)


def test_batches_adapt_to_memory():
    seen = []

    def encode(texts):
        if len(texts) > 3:
            raise MemoryError
        seen.append(len(texts))
        return np.ones((len(texts), 2))

    assert embedding.adaptive_batches([str(i) for i in range(10)], encode, 8).shape == (10, 2)
    assert sum(seen) == 10 and max(seen) == 2

    def never(texts):
        raise MemoryError

    with pytest.raises(MemoryError):
        embedding.adaptive_batches(["a"], never, 4)


def test_vectors_have_length_one(spark):
    rows = spark.createDataFrame([("a", "some words"), ("b", None), ("c", "")], "id string, text string")
    got = {r.id: r.vector for r in embedding.embed(rows).collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and not any(got["b"]) and not any(got["c"])


def test_upload_keeps_order_and_errors(spark, tmp_path):
    (tmp_path / "b.txt").write_text("w " * 3000)
    (tmp_path / "a.zip").write_bytes(b"x")
    points, errors = upload(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.zip")])
    rows = points.orderBy("chunk_no").collect()
    assert len(rows) == 4 and {r.source_file for r in rows} == {"b.txt"} and all(len(r.text) <= 2000 for r in rows)
    assert [r.error for r in errors.collect()] == ["Unsupported file type: .zip"]


def test_upload_uses_its_settings_and_reads_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "w.txt").write_text("word " * 50)
    points, errors = upload(spark, [str(tmp_path / "w.txt"), str(tmp_path / "t.csv")], config=Config(chunk_size=40, chunk_overlap=10))
    rows = points.orderBy("file_ordinal", "part", "chunk_no").collect()
    assert errors.count() == 0 and [r.text for r in rows if r.file_ordinal == 1] == ["a: 1\nb: x", "a: 2\nb: y"]
    assert len([r for r in rows if r.file_ordinal == 0]) > 6 and all(len(r.text) <= 40 for r in rows) and len({r.id for r in rows}) == len(rows)


def test_command_line_stages_and_upserts(spark, tmp_path, capsys):
    text = "1 Setup\n\n" + "some words about the set up of things. " * 20 + "\f2 Use\n\n" + "other words about the use of things. " * 20
    (tmp_path / "guide.txt").write_text(text)
    stage, collection = str(tmp_path / "stage"), str(tmp_path / "points")
    assert main(["ingest", str(tmp_path / "guide.txt"), "--stage", stage, "--stage-only", "--with-sparse"], spark) == 0
    assert "1 Setup" in capsys.readouterr().out and read_collection(spark, collection) is None
    for _ in range(2):
        assert main(["ingest", "--stage", stage, "--collection", collection, "--upsert-only"], spark) == 0
        assert capsys.readouterr().out == "2 points\n"
    rows = read_collection(spark, collection).orderBy("payload.page_start").collect()
    assert [(r.payload.source_file, r.payload.page_start, r.payload.section_path) for r in rows] == [("guide.txt", 1, ["1 Setup"]), ("guide.txt", 2, ["2 Use"])]
    assert all(abs(sum(x * x for x in r.dense) - 1) < 1e-6 for r in rows) and all(len(r.sparse.indices) == len(r.sparse["values"]) for r in rows)
    (tmp_path / "new.txt").write_text("fresh words that replace it all. " * 20)
    assert main(["ingest", str(tmp_path / "new.txt"), "--stage", stage, "--collection", collection, "--recreate"], spark) == 0
    assert [(r.payload.source_file, r.sparse) for r in read_collection(spark, collection).collect()] == [("new.txt", None)]
    (tmp_path / "x.zip").write_bytes(b"x")
    assert main(["ingest", str(tmp_path / "x.zip"), "--stage", stage, "--stage-only"], spark) == 1
    assert "Unsupported file type: .zip" in capsys.readouterr().err
    for wrong in (["ingest", "--stage", stage], ["ingest", "--stage", stage, "--stage-only", "--upsert-only"]):
        with pytest.raises(SystemExit):
            main(wrong, spark)


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda k, d: d)})})
    with pytest.raises(RuntimeError):
        shared_folder(session)
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_encoder_counts_signed_words():
    rows = embedding.hashing_encoder(["Some some\x1cwords", "", "\u00c9t\u00e9\u2003x"])
    plain = np.zeros((3, 64))
    for row, words in zip(plain, (["some", "some", "words"], [], ["\u00e9t\u00e9", "x"])):
        for h in (zlib.crc32(w.encode()) for w in words):
            row[h % 64] += 1 if h >> 16 & 1 else -1
    assert (rows == plain).all() and embedding.hashing_encoder([]).shape == (0, 64)


def _chunks(spark, *rows):
    return spark.createDataFrame([(i, t, ["1 A"], 1, 2, {"is_concept": True}) for i, t in rows], "id string, text string, section_path array<string>, page_start int, page_end int, flags map<string,boolean>")


def test_points_come_from_the_stage_without_a_join_and_once(spark, tmp_path):
    """Before, chunks, vectors and sparse rows were joined, twice; and the first version of a collection kept repeated ids."""
    stage, collection = str(tmp_path / "stage"), str(tmp_path / "points")
    chunks = _chunks(spark, ("a", "red red fox"), ("b", "red fox runs"), ("c", None), ("d", "lone"))
    first = ingest(chunks, stage, collection, spark)
    assert "Join" not in points_of_stage(spark, stage)._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.id: r for r in first.collect()}
    assert len(rows) == 4 and rows["c"].payload.text is None and not any(rows["c"].dense) and rows["c"].sparse.indices == []
    assert rows["a"].sparse.indices == rows["b"].sparse.indices == [0, 1, 2] and rows["a"].payload.flags == {"is_concept": True} and len(rows["a"].dense) == 64
    again = _chunks(spark, ("a", "new"), ("a", "new"), ("e", "more"))
    assert not lacks_any(first, first, "id") and lacks_any(again, first, "id")
    got = ingest(again, stage, collection, spark, with_sparse=False)
    assert sorted((r.id, r.payload.text, r.sparse is None) for r in got.collect()) == [("a", "new", True), ("b", "red fox runs", False), ("c", None, False), ("d", "lone", False), ("e", "more", True)]
    got = ingest(again, stage, str(tmp_path / "other"), spark, with_sparse=False)
    assert sorted((r.id, r.payload.text) for r in got.collect()) == [("a", "new"), ("e", "more")]
