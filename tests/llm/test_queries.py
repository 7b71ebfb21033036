"""Registered queries against their SQL, and the pipeline's stages."""

import hashlib
import os

import duckdb
import pytest

import corpus_pipeline
from linkwright.llm import minhash
from linkwright.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_one_query_per_operator_and_the_pipeline():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    rel = sql.execute(ORACLE[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(map(repr, rel.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == want


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, sizes = docs.columns, [docs.count()]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == cols
        sizes.append(docs.count())
        kept.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    assert kept[2].keys() == kept[1].keys() and kept[2] != kept[1]
    assert set(kept[3]) <= set(kept[2]) and sizes[4] > len(kept[3])  # some twice
    near = minhash.near_duplicates(stage_input(spark, kept[1]))
    assert near.where("not kept").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == sizes[4]
    assert all(r.decoded_sha256 == hashlib.sha256(kept[3][r.doc_id].encode()).hexdigest() for r in out)


def stage_input(spark, texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")


def test_pipeline_runs(spark):
    assert QUERIES["pipeline"](spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_dedup_stage_keeps_one_row_of_repeated_and_nameless_documents(spark):
    import corpus_pipeline

    from .data import frame, sentence

    a, b, c = (sentence(900 + i, 80) for i in range(3))
    near = a.split()
    near[40] = "changed"
    rows = [(7, a, "en", "b", 2), (7, a, "en", "a", 1), (7, a, "en", "a", 1), (8, " ".join(near), "en", "a", 1),
            (None, a, "en", "a", 1), (None, b, "en", "z", 1), (None, b, "en", "a", 1), (9, c, "en", "a", 1),
            (None, c + " end", "en", "a", 1), (None, None, None, None, 1), (None, None, None, None, 1),
            (10, "", "en", "a", 1), (10, "", "en", "a", 1)]
    got = sorted((tuple(r) for r in corpus_pipeline.dedup_stage(spark, frame(spark, rows), "").collect()), key=repr)
    assert got == sorted([(7, a, "en", "a", 1), (9, c, "en", "a", 1), (None, b, "en", "a", 1), *rows[9:]], key=repr)
    plain = [(1, a, "en", "a", 1), (2, a, "en", "a", 1), (3, b, "en", "a", 1)]
    got = corpus_pipeline.dedup_stage(spark, frame(spark, plain), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 3]
