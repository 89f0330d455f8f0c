"""The pipeline and the registered SQL on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import decontam, registry, stages
from folioscan.llm.common import materialise

from .helpers import DOCS, awkward, clashing, nothing, sentence

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@here
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    key = lambda r: [str(v) for v in r]
    assert sorted(map(tuple, df.collect()), key=key) == sorted((tuple(r[k] for k in at) for r in cur.fetchall()), key=key)


@here
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            index = decontam.Index([(r["item_id"], r["text"]) for r in items], decontam.Lemma())
            assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.collect() if not index.hits(r["text"]))
        docs = materialise(out, "t") if name != "tokens" else out
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0 and sizes[4] == sizes[5]


@here
@pytest.mark.parametrize("make", [awkward, nothing])
def test_stages_take_awkward_and_empty_tables(spark, make):
    for name, stage in corpus_pipeline.STAGES:
        docs = clashing(make(spark)).withColumn("row", F.lit("x")).withColumn("kept", F.lit("y")).withColumn("a.b", F.create_map(F.lit(1), F.lit("z")))
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns and all(r["size"] == r["row"] == "x" and r["kept"] == "y" and r["a.b"] == {1: "z"} for r in out.collect())
        assert out.count() <= 2 * docs.count()
        if name == "near_duplicates" and make is awkward:
            assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 9, 10]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    texts = [(None, sentence(1)), (None, sentence(1)), (5, sentence(1)), (None, sentence(2)), (None, sentence(2) + " more"), (1, sentence(3)), (7, sentence(3)), (7, sentence(4)), (8, sentence(5)), (8, sentence(5)), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in texts], DOCS)
    kept = sorted(((r["doc_id"], r["text"]) for r in stages.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    left = [r for r in kept if r[1] not in (sentence(2), sentence(2) + " more")]
    assert left == sorted([(5, sentence(1)), (1, sentence(3)), (7, sentence(4)), (8, sentence(5)), (None, None)], key=str)
    assert len(kept) == 6


@here
def test_run_leaves_only_what_it_needs(spark):
    from folioscan.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF).collect()
    left = {p.split("-", 2)[2] for p in set(os.listdir(folder)) - before if p.startswith("folioscan-")}
    assert out and {f"stage-{n}" for n, _ in corpus_pipeline.STAGES[:-1]} | {"tokens"} >= left >= {"stage-mixing", "tokens"}
