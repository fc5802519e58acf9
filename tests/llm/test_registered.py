"""Registered queries against their SQL, and the pipeline against plain functions."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fjordgraph.llm import langid, packing, pii, queries, sql

from .test_table_ops import brute_classes

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def shown(rows, names):
    keys = sorted(names)
    cell = lambda v: "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[names.index(k)]) for k in keys) for r in rows)


@pytest.mark.parametrize("name", list(sql.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as from read_parquet('{SF}/{t}.parquet')")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(sql.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(rel.fetchall(), list(rel.columns))


def test_pipeline_equals_plain_functions(spark, tmp_path, monkeypatch):
    """run() over a table with nulls, copies and personal data, document by document."""
    monkeypatch.setenv("FJORDGRAPH_PII_KEY", "k")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(90001, None, "en", "s", 0), (90002, " 12 ", "en", "s", 4), (90003, docs.where("text is not null").first().text, "en", "s", 5), (90004, "Mr. John Smith met Anna Mueller. " * 3 + "the and of", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scorer = langid.Scorer(langid.fit(docs))
    stay = [(r.doc_id, r.text) for r in docs.collect() for lang, p in [scorer.score(r.text)] if lang != langid.UNDETERMINED and p >= corpus_pipeline.MIN_SCORE]
    classes = brute_classes(stay)
    s, w = pii.Surrogates("k"), packing.WordTokenizer(queries.public_tokenizers.path("word_bpe_49k.json"))
    want = {d: w.encode(pii.replace(t, s)[0]) + b"\2\0\0\0" for d, t in stay if classes[d] == d}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert got == want and 90001 not in got and len(got) > 50
    lengths = Counter()
    for r in rows:
        lengths[r.sequence_id] += r.length
    assert sum(n < 512 for n in lengths.values()) < 10
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where(F.lit(False)), str(tmp_path)).collect() == []
