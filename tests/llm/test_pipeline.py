"""Stages against the operators' own rules, and the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark):
    from fjordgraph.llm import pii
    from fjordgraph.storage import cut

    from .test_table_ops import brute_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("kept"))
    extra = spark.createDataFrame([(90001, None, "en", "s", 0, "k"), (90002, " 12 ", "en", "s", 4, "k")], docs.schema)
    docs = cut(docs.unionByName(extra), "docs")
    (_, one), (_, two), (_, three), (_, four) = corpus_pipeline.STAGES
    a = cut(one(spark, docs, SF), "a")
    assert a.columns == docs.columns and a.count() == docs.count() - 2
    b = cut(two(spark, a, SF), "b")
    want = brute_classes([(r.doc_id, r.text) for r in a.collect()])
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == sorted(set(want.values()))
    c = cut(three(spark, b, SF), "c")
    s = pii.Surrogates(pii.environment_key(otherwise=corpus_pipeline.TEST_KEY))
    before = {r.doc_id: r.text for r in b.collect()}
    after = {r.doc_id: r for r in c.collect()}
    assert c.columns == docs.columns and set(after) == set(before)
    assert all(after[k].text == pii.replace(t, s)[0] and after[k].n_chars == len(after[k].text) for k, t in before.items())
    packed = four(spark, c, SF)
    total = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert total.count() == len(after) and total.where("n <> t").count() == 0
    assert four(spark, c.where("false"), SF).collect() == []
