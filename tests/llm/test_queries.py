"""The registered queries on the smallest tables: SQL where there is some, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from textloom.llm import packing, queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return db


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_returns_whole_table(spark, name):
    assert queries.queries()[name](spark, SF).count() >= spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        assert name == "pack" or docs.columns == columns
    assert 0 < len(rows["quality"]) < spark.read.parquet(f"{SF}/documents.parquet").count()
    kept = {r.doc_id for r in rows["quality"]}
    assert {r.doc_id for r in rows["line_dedup"]} <= kept
    fps = [simhash.fingerprint((r.text or "").encode()) for r in rows["near_dedup"]]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    assert {r.doc_id for r in rows["mix"]} <= {r.doc_id for r in rows["near_dedup"]}
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"])
    encode = packing.encoder("byte_bpe_50k").encode
    assert sum(r.length for r in rows["pack"]) == sum(len(encode(r.text)) + 1 for r in rows["mix"])
    assert corpus_pipeline.run(spark, SF).count() == len(rows["pack"])
