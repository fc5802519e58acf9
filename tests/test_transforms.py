import json

import pytest
from pyspark.sql import functions as F

from fjordgraph.functions import analytics, generate, reports, tables, validate
from fjordgraph.operators import graph as g
from fjordgraph.sources import edges as io
from fjordgraph.sources import records

from . import plain


def test_owned_range_covers_all(spark):
    for n, parts in ((10, 3), (7, 7), (3, 5), (16, 4)):
        got = [r.o for r in spark.range(n).orderBy("id").select(g.owned_range(n, parts, F.col("id")).alias("o")).collect()]
        sizes = [got.count(k) for k in range(parts)]
        assert got == sorted(got) and sizes == [n // parts + (k < n % parts) for k in range(parts)]


def test_dense_labels_and_digest(spark):
    df = spark.createDataFrame([(0, 9), (1, 4), (2, 9), (3, 7)], "id long, label long")
    assert {r.id: r.label for r in g.dense_labels(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 2}
    h = 0xCBF29CE484222325
    for x in (0, 1, 0, 2):
        h = ((h ^ x) * 0x100000001B3) % (1 << 64)
    assert reports.serial_digest(df) == f"{h:016x}"


def test_text_round_trips(spark, tmp_path):
    path = str(tmp_path / "e")
    lines = ["# c", "", "0\t1", "1 2 0.5", "x y", "7", "3\t99", "2\t0\tz"]
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(path)
    assert {(r.src, r.dst) for r in io.read_edges(spark, path, 4).collect()} == {(0, 1), (1, 2), (2, 0)}
    assert {(r.src, r.dst, r.weight) for r in io.read_weighted_edges(spark, path, 4).collect()} == {(0, 1, 1.0), (1, 2, 0.5), (2, 0, 1.0)}
    with pytest.raises(Exception, match="malformed line"):
        io.read_seeded_edges(spark, path, strict=True)[0].collect()
    neg = str(tmp_path / "neg")
    spark.createDataFrame([("0\t1\t-2",)], "v string").write.text(neg)
    with pytest.raises(Exception, match="not negative"):
        io.read_weighted_edges(spark, neg).collect()
    assert io.read_seeded_edges(spark, neg)[1].count() == 0
    assert io.file_sizes(spark, path).where("length > 0").count() >= 1


def test_graph_json_and_results(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    s = spark.createDataFrame([(2, 7)], "id long, label long")
    io.write_graph_json(e, s, 5, str(tmp_path / "j"))
    edges, seeds, n = io.read_graph_json(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 2)] and [tuple(r) for r in seeds.collect()] == [(2, 7)] and n == 5
    r = spark.createDataFrame([(1, None), (0, 2.5)], "id long, d double")
    io.write_result(r, str(tmp_path / "r"), "d", io.UNREACHABLE)
    assert {x.id: x.value for x in io.read_result(spark, str(tmp_path / "r"), "double").collect()} == {0: 2.5, 1: None}
    assert io.result_document(r, "d", {"n": 2}).first().json == '{"n":2,"d":[2.5]}' or "d" in io.result_document(r, "d", {"n": 2}).first().json


def test_large_graphs_are_several_documents(spark, tmp_path, monkeypatch):
    """No document is large, copies of one edge included, and all together are the graph."""
    monkeypatch.setattr(io, "DOCUMENT", 100, raising=False)
    monkeypatch.setattr(io, "COPIES", 10, raising=False)
    rows = [(i, i + 1) for i in range(500)] + [(7, 7)] * 500
    e = spark.createDataFrame(rows, "src long, dst long")
    s = spark.range(0, 400, 2).select("id", (F.col("id") % 3).alias("label"))
    io.write_graph_json(e, s, 501, str(tmp_path / "j"))
    docs = [json.loads(f.read_text()) for f in (tmp_path / "j").glob("*.json")]
    assert len(docs) == 10 and max(len(d["edges"]) for d in docs) < 250
    edges, seeds, n = io.read_graph_json(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, edges.collect())) == sorted(rows) and n == 501
    assert {tuple(r) for r in seeds.collect()} == {(i, i % 3) for i in range(0, 400, 2)}
    io.write_graph_json(e.where("false"), s.where("false"), 3, str(tmp_path / "none"))
    edges, seeds, n = io.read_graph_json(spark, str(tmp_path / "none"))
    assert (edges.count(), seeds.count(), n) == (0, 0, 3)


def test_run_records(spark, tmp_path):
    d = tmp_path / "runs"
    d.mkdir()
    (d / "bfs_rayon_n1000_t4_rep2.json").write_text('{"algorithm": "bfs", "backend": "rayon", "status": "passed", "result": {"raw": {"execution_time_ms": 3.5}}}')
    r = records.read_runs(spark, str(d)).first()
    assert (r.nodes, r.threads, r.rep, r.ranks, r.result.raw.execution_time_ms) == (1000, 4, 2, None, 3.5)


def test_validators(spark):
    a = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "id long, label long")
    b = spark.createDataFrame([(0, 5), (1, 5), (2, 6)], "id long, label long")
    c = spark.createDataFrame([(0, 5), (1, 6), (2, 6)], "id long, label long")
    assert not validate.partition_conflicts(a, b).collect() and validate.partition_conflicts(a, c).count() == 2
    assert validate.mismatches(a, b, "label").count() == 3 and not validate.mismatches(a, a, "label").collect()
    inf = spark.createDataFrame([(0, float("inf")), (1, None)], "id long, v double")
    assert not validate.far_apart(inf, inf, "v").collect()


def test_phase_breakdown_of_two_workers(spark):
    w = lambda i, **k: (0, i, [(x, str(v)) for x, v in k.items()])
    rows = [
        w(0, worker_start=110, get_input=112, get_input_end=140, iter_0_start=150, iter_0_compute=170, iter_0_reduce=180, iter_0_broadcast=190, worker_end=220),
        w(1, worker_start=115, get_input=118, get_input_end=147, iter_0_start=152, iter_0_compute=165, iter_0_reduce=181, iter_0_broadcast=191, worker_end=230, bad="x"),
    ]
    df = spark.createDataFrame(rows, "run long, worker_id int, timestamps array<struct<key: string, value: string>>")
    sub = spark.createDataFrame([(0, 100, 240)], "run long, submit_ms long, finish_ms long")
    r = analytics.phase_breakdown(analytics.trace_events(df), sub).first()
    assert (r.cold_start_ms, r.stagger_ms, r.load_ms, r.compute_ms, r.reduce_ms, r.broadcast_ms, r.warm_total_ms, r.span_ms, r.iterations, r.write_ms) == (10, 5, 35, 20, 11, 10, 120, 80, 1, None)


def test_probes(spark):
    ev = spark.createDataFrame([(0, 0, "ptp_start", 0), (0, 0, "ptp_end", 2000), (0, 1, "ptp_start", 500), (0, 1, "ptp_end", 2500), (0, 0, "iter_0_start", 5), (0, 1, "iter_0_broadcast_end", 9)], "run long, worker_id int, key string, ms long")
    assert analytics.point_to_point(ev, 1 << 20, 4).first().throughput_mb_s == 2.0
    assert analytics.point_to_point(ev, 1 << 20, 5, pairs=True).first().throughput_mb_s == 2.0
    assert analytics.collective_latency(ev, "broadcast").first().latency_median_ms == 4
    a = spark.createDataFrame([("x", 5)], "counter string, value long")
    assert [tuple(r) for r in analytics.counter_deltas(a, spark.createDataFrame([("x", 9), ("y", 1)], "counter string, value long")).orderBy("counter").collect()] == [("x", 4), ("y", 1)]


def test_generators(spark):
    edges = [tuple(r) for r in generate.random_digraph(spark, 50, 4).collect()]
    assert len(edges) == 200 and all(u != v and 0 <= v < 50 for u, v in edges)
    assert edges == [tuple(r) for r in generate.random_digraph(spark, 50, 4).collect()]
    for n, d in ((20, 5), (7, 30), (2, 1), (1, 3)):
        k = [tuple(r) for r in generate.distinct_digraph(spark, n, d).collect()]
        assert len(set(k)) == len(k) == n * min(d, n - 1) and all(u != v and 0 <= v < n for u, v in k)
    assert all(0.1 <= w <= 3 for *_, w in generate.xorshift_weights(edges, 3, 3.0))
    for n in (5, 20, 200):
        k = [tuple(r) for r in generate.small_world(spark, n).collect()]
        assert len(set(k)) == len(k) == 2 * n and all(0 <= u < v < n for u, v in k)
    assert generate.erdos_renyi(spark, 12, 1.0).count() == 66 and generate.erdos_renyi(spark, 12, 0.0).count() == 0
    near = generate.planted_communities(spark, 200, 4, 0.6, 0.02).selectExpr("src div 50 = dst div 50 same").groupBy("same").count()
    near = {r.same: r["count"] for r in near.collect()}
    assert abs(near[True] / (4 * 1225) - 0.6) < 0.05 and abs(near[False] / 15000 - 0.02) < 0.005
    u = [r.u for r in spark.range(20_000).select(generate.uniform(5, "id").alias("u")).collect()]
    assert abs(sum(u) / len(u) - 0.5) < 0.01 and abs(sum(x * x for x in u) / len(u) - 1 / 3) < 0.01 and len(set(u)) > 19_000
    assert abs(generate.erdos_renyi(spark, 60).count() / 1770 - 0.3) < 0.05
    seeds = generate.balanced_seeds(spark.range(103), 4, 0.5)
    assert sorted(r["count"] for r in seeds.groupBy("label").count().collect()) == [12, 12, 12, 15]
    r = generate.ratings(spark, 200, 50, 6.0)
    assert r.count() == r.select("user", "item").distinct().count() and 4 < r.count() / 200 < 7
    assert generate.path(spark, 5).count() == 4 and generate.star(spark, 5).count() == 4
    assert len(generate.er_fixture(30, 0.1, 1)) == len(generate.er_fixture(30, 0.1, 1))
    assert sorted(r.place for r in generate.shuffled_subset(spark.range(30), ["id"], 7).collect()) == list(range(7))


def test_tables(spark, tmp_path):
    f = tmp_path / "f.csv"
    f.write_text("1.0," + ",".join("0.5" for _ in range(28)) + "\n0,1,2\n")
    assert tables.read_features(spark, str(f)).count() == 1
    m = tmp_path / "m.csv"
    m.write_text("userId,movieId,rating,timestamp\n7,100,3.5,1\n9,50,4,2\n")
    got = tables.dense_ids(tables.read_ratings(spark, str(m)), "user", "item")
    assert sorted(map(tuple, got.collect())) == [(0, 1, 3.5), (1, 0, 4.0)]
    odd = spark.createDataFrame([("b", None), (None, 2.5), ("a", 7.0), ("b", 2.5)], "k string, x double")
    assert sorted(map(str, map(tuple, tables.dense_ids(odd, "k", "x").collect()))) == sorted(map(str, [(1, None), (None, 0), (0, 1), (1, 0)]))
    assert tables.dense_ids(odd.where("false"), "k").collect() == []
    edges = tables.bin_edges(spark.range(10).select(F.lit(1.0).alias("x")), "x", 4).first().edges
    assert edges == [1.0] + [float("inf")] * 3


def test_ranks_equal_plain_ones(spark):
    import random
    import statistics

    from fjordgraph.operators import ranks

    rng = random.Random(1)
    values = [10**15, -5, *(rng.randrange(60) for _ in range(500))]
    df = spark.createDataFrame([(k % 3 if k % 7 else None, float(v)) for k, v in enumerate(values)], "k int, ms double")
    got = ranks.global_rank(df.select("ms").distinct(), "ms", "r").collect()
    assert [r.ms for r in sorted(got, key=lambda r: r.r)] == sorted(set(map(float, values))) and sorted(r.r for r in got) == list(range(len(got)))
    by = {}
    for k, v in enumerate(values):
        by.setdefault(k % 3 if k % 7 else None, []).append(float(v))
    for r in analytics.summarise(df, ["k"]).collect():
        mine = sorted(x for x in by[r.k] if x > 0)
        assert (r.n_samples, r.median, r.p95) == (len(mine), statistics.median(mine), mine[max(1, round(0.95 * len(mine))) - 1])
    q = ranks.quantiles(df, "ms", [0.0, 0.25, 0.5, 1.0]).first().q
    assert q[0] == -5 and q[2] == statistics.median(values) and q[3] == 10**15
    assert ranks.quantiles(df.where("false"), "ms", [0.5]).first().q is None


def test_metamorphic_relabelling(spark):
    from fjordgraph.operators.traversal import bfs

    rows = [(0, 1), (1, 2), (0, 3), (3, 4), (5, 0)]
    e = spark.createDataFrame(rows, "src long, dst long")
    m = spark.createDataFrame([(i, (i * 5 + 2) % 7) for i in range(7)], "id long, new_id long")
    got = {r.id: r.level for r in bfs(g.Graph(g.relabel(e, m), 7), 2)[0].collect()}
    want = plain.bfs(rows, 7, 0)
    assert got == {(i * 5 + 2) % 7: v for i, v in want.items()}
