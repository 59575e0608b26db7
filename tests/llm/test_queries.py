"""The registered queries over the smallest tables."""

import os

import pytest

from tests.oracle import duck_rows, spark_rows

import corpus_pipeline
from weftline.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(Q.QUERIES[name](spark, SF)) == duck_rows(Q.ORACLE_SQL[name], SF)


COUNT = {"op8_chroma_audio": "embeddings", "op2_warc_in_zip": "pages"}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL) - {"op5_paragraph_dedup"}))
def test_one_row_per_input_row(spark, name):
    table = COUNT.get(name, "documents")
    assert Q.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs = corpus_pipeline.stored(out)
            counts.append(docs.count())
            assert docs.where("n_chars <> length(text)").count() == 0
        else:
            assert out.count() == counts[-1]
    assert counts[0] == counts[1] == counts[2] > counts[3]


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the cat sat on the mat today", "en", "a", 28), (3, "123", "en", "b", 3), (4, "the cat sat on the mat today", "en", "a", 28), (4, "the cat sat on the mat today", "en", "a", 28), (5, "the dog " * 20000, "en", None, 160000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        spark.createDataFrame([], docs.schema).count()
    assert {r["doc_id"] for r in docs.collect()} <= {None, 4, 5}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
