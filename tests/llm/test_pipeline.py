"""The pipeline's stages: each works on what its predecessor kept, and does what its operator says."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ruleweave.llm import decontaminate, quality, simhash
from ruleweave.llm.common import materialize, read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        out[name] = docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(spark, steps):
    columns = read(spark, SF, "documents").columns
    frames = list(steps.values())
    assert all(f.columns == columns for f in frames[:-1])
    assert frames[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    counts = [f.count() for f in frames]
    assert 0 < counts[2] <= counts[1] <= counts[0] < 200 and counts[3] == counts[4]


def test_each_stage_judges_its_input(spark, steps):
    first, second, third, fourth, last = steps.values()
    good = quality.classify(read(spark, SF, "documents"), read(spark, SF, "labels")).where("keep").select("row.*")
    assert ids(first) == ids(good)
    assert ids(second) == sorted(r.doc_id for r in simhash.near_duplicates(first).where("doc_id = component_id").collect())
    leaking = {r.doc_id for r in decontaminate.leaks(second, read(spark, SF, "benchmark")).collect()}
    assert ids(third) == [i for i in ids(second) if i not in leaking]
    assert set(ids(fourth)) <= set(ids(third)) and max(pd.Series(ids(fourth)).value_counts()) <= 2
    assert ids(last) == ids(fourth)
    assert last.agg(F.min("start")).first()[0] == 0


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, list(steps.values())[-1].collect()))


def test_stages_take_odd_rows(spark):
    schema = read(spark, SF, "documents").schema
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", None, None, 0), (3, "x y z " * 5000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0
