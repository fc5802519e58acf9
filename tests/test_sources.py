"""Logs, archives, shards and merges of one's own."""

import glob
import random
import zipfile
from functools import reduce
from math import gcd

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordgraph.functions import tables
from fjordgraph.operators import graph as g
from fjordgraph.operators.pregel import merged_by, pregel
from fjordgraph.sources import archives, records
from fjordgraph.sources import edges as io

from . import plain


def test_log_lines_keep_their_order(spark, tmp_path):
    """Files of many splits: the order is that of the lines."""
    rng = random.Random(1)
    want, longest = {}, {}
    for f in range(3):
        lines = []
        for k in range(3000):
            kind = rng.randrange(4)
            lines.append([f'RESULT {{"k": {k}}}', f"RESULT {{{k}", f"  x 'duration': {rng.randrange(10**6)}, 'end': 3", "é" * rng.randrange(60)][kind])
        (tmp_path / f"run{f}.log").write_text("\n".join(lines) + ("\n" if f else ""))
        want[f] = max(k for k, x in enumerate(lines) if x.endswith("}"))
        longest[f] = max(int(x.split(": ")[1].split(",")[0]) for x in lines if "duration" in x)
    (tmp_path / "none.log").write_text("nothing here\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        log = records.read_log(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 20
        number = lambda r: int(r.file.rsplit("run", 1)[1][:-4])
        assert {number(r): r.k for r in records.last_json_lines(log, "k long", "RESULT ").collect()} == want
        assert {number(r): r.duration for r in records.longest_durations(log).where("file like '%run%'").collect()} == longest
        one = [r.value for r in log.where("file like '%run1.log'").orderBy("at").collect()]
        assert one == (tmp_path / "run1.log").read_text().splitlines()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert records.last_json_lines(log.where("false"), "k long").collect() == []


def test_zip_members(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randrange(1, 200), rng.randrange(1, 50), rng.randrange(1, 11) / 2) for _ in range(25_000)]
    with zipfile.ZipFile(tmp_path / "ml.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ml/ratings.csv", "userId,movieId,rating,timestamp\n" + "".join(f"{u},{i},{r},7\n" for u, i, r in rows) + "x,y\n")
        z.writestr("ml/movies.csv", "1,a\n")
        z.writestr("ml/empty/", "")
    got = [tuple(r) for r in tables.read_ratings(spark, str(tmp_path / "ml.zip")).collect()]
    assert sorted(got) == sorted(rows)
    some = tables.read_ratings(spark, str(tmp_path / "ml.zip"), share=0.3)
    users = {r.user for r in some.select("user").distinct().collect()}
    assert 30 < len(users) < 90 and some.count() == sum(u in users for u, _, _ in rows)
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{u},{i},{r},7\n" for u, i, r in rows))
    assert {r.user for r in tables.read_ratings(spark, str(tmp_path / "r.csv"), share=0.3).select("user").distinct().collect()} == users
    lines = archives.read_zip_lines(spark, str(tmp_path / "ml.zip"), r"ml/m.*").collect()
    assert [(r.member, r.line_no, r.value) for r in lines] == [("ml/movies.csv", 0, "1,a")]
    every = archives.read_zip_lines(spark, str(tmp_path / "ml.zip"), r".*ratings\.csv")
    assert every.agg(F.max("line_no"), F.count_distinct("line_no")).first()[:] == (25_001, 25_002)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="not a zip"):
        archives.read_zip_lines(spark, str(tmp_path / "bad.zip")).collect()


def test_large_shards_are_written_by_several_tasks(spark, tmp_path):
    """One part has nine tenths of the rows; every row is in the folder of its part."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 > 0, 4 * F.col("id")).otherwise(F.col("id")).alias("src"), F.sha2(F.col("id").cast("string"), 256).alias("dst"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        io.write_sharded(rows, str(tmp_path / "s"), 4)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(glob.glob(str(tmp_path / "s" / "part=0" / "*.txt"))) > 4
    back = spark.read.text(str(tmp_path / "s")).select(F.split("value", "\t")[0].cast("long").alias("src"), "part")
    assert back.count() == 200_000 and back.where("src % 4 <> part").count() == 0


def test_owners_are_partitions(spark):
    rng = random.Random(3)
    graph = g.Graph(spark.createDataFrame([(rng.randrange(50), rng.randrange(50)) for _ in range(300)], "src long, dst long"), 50)
    owned = g.owned_edges(graph, 7)
    assert "RepartitionById" in owned._jdf.queryExecution().toString() or owned.rdd.getNumPartitions() == 7
    parts = owned.rdd.mapPartitionsWithIndex(lambda k, rows: [(k, [(r.owner, r.src, r.dst) for r in rows])]).collect()
    assert len(parts) == 7 and all(o == k for k, rows in parts for o, _, _ in rows)
    assert all([x[1:] for x in rows] == sorted(x[1:] for x in rows) for _, rows in parts) and sum(len(r) for _, r in parts) == 300


def test_messages_merged_by_a_function(spark):
    rng = random.Random(4)
    rows = [(0, rng.randrange(1, 10**6) * 6) for _ in range(30_000)] + [(rng.randrange(1, 9), rng.randrange(1, 10**6)) for _ in range(500)]
    sent = spark.createDataFrame(rows, "id long, msg long").repartition(5)
    got = {r.id: r.msg for r in merged_by(sent, lambda s: int(np.gcd.reduce(s.to_numpy()))).collect()}
    assert got == {k: reduce(gcd, [m for i, m in rows if i == k]) for k in {i for i, _ in rows}}
    assert merged_by(sent.where("false"), min).collect() == []


def test_the_function_is_called_once_a_vertex(spark):
    """Not for messages one by one, if vertices have a few each."""
    calls = spark.sparkContext.accumulator(0)

    def least(s):
        calls.add(1)
        return int(s.min())

    sent = spark.range(20_000).select((F.col("id") % 2000).alias("id"), (F.col("id") + 5).alias("msg")).repartition(5)
    assert {r.id: r.msg for r in merged_by(sent, least).collect()} == {i: i + 5 for i in range(2000)}
    assert 2000 <= calls.value < 3000


def test_pregel_with_a_function(spark):
    rows = [(0, 1), (1, 2), (2, 3), (0, 3), (5, 6)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    start = spark.range(7).select("id", F.when(F.col("id") == 0, 0).cast("long").alias("d"))
    out, info = pregel(start, edges, lambda s: int(s.min()), {"d": F.least("d", "msg")}, to_dst=F.col("src_d") + 1, reads=("src",))
    assert {r.id: r.d for r in out.collect()} == plain.bfs(rows, 7, 0) and info.converged


def test_faults_of_edge_lines(spark, tmp_path):
    lines = ["# c", "", "1 2", "1 2 0.5", "1", "x 2", "1 y", "-1 2", "1 2 z", "1 2 nan", "1 2 inf", "1 2 -3", "1 2 3 4", " 4\t5 "]
    (tmp_path / "e").write_text("\n".join(lines))
    got = {r.line: r.fault for r in io.edge_faults(spark, str(tmp_path / "e")).collect()}
    assert got == {"1": "columns", "x 2": "source", "1 y": "destination", "-1 2": "outside", "1 2 z": "weight", "1 2 nan": "not finite", "1 2 inf": "not finite", "1 2 -3": "negative"}
    (tmp_path / "s").write_text("1 2 3\n1 2 a\n1 2 4294967296\n1 2 -7\n")
    assert {r.line: r.fault for r in io.edge_faults(spark, str(tmp_path / "s"), "label").collect()} == {"1 2 a": "label", "1 2 4294967296": "too large"}
    for bad in ("nan", "inf", "-3"):
        (tmp_path / bad).write_text(f"1 2 {bad}\n")
        with pytest.raises(Exception, match="not negative"):
            io.read_weighted_edges(spark, str(tmp_path / bad)).collect()
