"""Certificates, comparisons of partitions and digests."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fjordgraph.functions import certificates, generate, reports, validate
from fjordgraph.operators.graph import Graph
from fjordgraph.operators.pagerank import pagerank

from . import plain


def graph_of(spark, rows, n):
    return Graph(spark.createDataFrame(rows, "src long, dst long" + ", weight double" * (len(rows[0]) > 2)), n)


def told(df):
    return sorted((r.id, r.rule) for r in df.collect())


def vector(spark, values, name, kind):
    return spark.createDataFrame([(k, v) for k, v in values.items()] if isinstance(values, dict) else values, f"id long, {name} {kind}")


def test_bfs_certificate(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    g, right = graph_of(spark, rows, 30), plain.bfs(rows, 30, 0)
    check = lambda x, cap=None: told(certificates.bfs_violations(g, vector(spark, x, "level", "int"), 0, cap))
    assert check(right) == []
    capped = plain.bfs(rows, 30, 0, 2)
    assert check(capped, 2) == [] and check(capped) and check(right, 2)
    deep = max((v, k) for k, v in right.items() if v is not None)[1]
    for bad in ({deep: right[deep] + 1}, {deep: right[deep] - 1}, {deep: None}, {0: 1}, {0: None}, {next(k for k, v in right.items() if v is None): 3}):
        (at,) = bad
        assert at in {k for k, _ in check(right | bad)}, bad
    rows = list(right.items())
    assert check(rows[1:]) != [] and (0, "missing") in check(rows[1:])
    assert (99, "extra") in check([*rows, (99, 1)]) and (5, "repeated") in check([*rows, (5, right[5])])


def test_no_wrong_levels_pass(spark):
    """Every other vector over few values is refused."""
    g = graph_of(spark, [(0, 1), (1, 2), (2, 1), (3, 4), (4, 3)], 5)
    right = (0, 1, 2, None, None)
    assert not told(certificates.bfs_violations(g, vector(spark, dict(enumerate(right)), "level", "int"), 0))
    for bad in ((0, 1, 2, 1, 2), (0, 1, 2, 2, 2), (0, 1, 2, 0, 1), (0, 2, 1, None, None), (0, 1, None, None, None), (1, 2, 3, None, None), (0, 1, 2, None, 0)):
        assert told(certificates.bfs_violations(g, vector(spark, dict(enumerate(bad)), "level", "int"), 0)), bad


def test_sssp_certificate(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(25), rng.randrange(25), float(rng.randrange(0, 4))) for _ in range(45)]
    g, right = graph_of(spark, rows, 25), plain.dijkstra(rows, 25, 0)
    right = {k: None if v is None or math.isinf(v) else v for k, v in (right.items() if isinstance(right, dict) else enumerate(right))}
    check = lambda x: told(certificates.sssp_violations(g, vector(spark, x, "distance", "double"), 0))
    assert check(right) == []
    far = max((v, k) for k, v in right.items() if v is not None)[1]
    for d in (0.5, -0.5, None):
        assert far in {k for k, _ in check(right | {far: None if d is None else right[far] + d})}


def test_sssp_circles_of_weight_0_hold_nobody(spark):
    """Values that rest on each other alone fulfil every edge, and are refused."""
    rows = [(0, 1, 2.0), (1, 2, 0.0), (2, 3, 0.0), (3, 2, 0.0), (4, 5, 0.0), (5, 4, 0.0), (5, 6, 1.0)]
    g = graph_of(spark, rows, 7)
    check = lambda x: told(certificates.sssp_violations(g, vector(spark, dict(enumerate(x)), "distance", "double"), 0))
    assert check((0.0, 2.0, 2.0, 2.0, None, None, None)) == []
    assert check((0.0, 2.0, 2.0, 2.0, 7.0, 7.0, 8.0)) == [(4, "support"), (5, "support")]
    assert check((0.0, 2.0, 1.0, 1.0, None, None, None))


def test_pagerank_residual(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(18)) for _ in range(60)]
    g = graph_of(spark, rows, 20)
    end, _ = pagerank(g, 300, tol=1e-14)
    early, _ = pagerank(g, 3, tol=0.0)
    true = {r.id: r["rank"] for r in end.collect()}
    one = certificates.pagerank_residual(g, early).first()
    off = sum(abs(r["rank"] - true[r.id]) for r in early.collect())
    assert 0 < off <= one.error_bound + 1e-12 and abs(one.total - 1) < 1e-9 and one.unlike == 0
    fine = certificates.pagerank_residual(g, end).first()
    assert fine.residual < 1e-12 and certificates.pagerank_residual(g, end.where("id > 0")).first().unlike == 1
    moved = end.withColumn("rank", F.when(F.col("id") == 3, F.col("rank") + 0.01).otherwise(F.col("rank")))
    assert certificates.pagerank_residual(g, moved).first().residual > 0.001


def plain_comparison(a, b):
    ids = sorted(set(a) & set(b))
    pairs = list(combinations(ids, 2))
    same = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    pa, pb = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    chance = pa * pb / len(pairs)
    rand = 1.0 if (pa + pb) / 2 == chance else (same - chance) / ((pa + pb) / 2 - chance)
    n, ca, cb, cells = len(ids), Counter(a[i] for i in ids), Counter(b[i] for i in ids), Counter((a[i], b[i]) for i in ids)
    return rand, -sum(c / n * (math.log(c / ca[x]) + math.log(c / cb[y])) for (x, y), c in cells.items())


@pytest.mark.parametrize("ka,kb", [(1, 1), (3, 4), (40, 2), (40, 40)])
def test_comparison_equals_brute_force(spark, ka, kb):
    rng = random.Random(ka * 100 + kb)
    a = {i: rng.choice([None, *range(ka - 1)]) for i in range(60)}
    b = {i: rng.randrange(kb) for i in range(5, 66)}
    one = validate.compare_partitions(vector(spark, a, "label", "long"), vector(spark, b, "label", "long")).first()
    rand, variation = plain_comparison(a, b)
    assert abs(one.adjusted_rand - rand) < 1e-9 and abs(one.variation - variation) < 1e-9
    assert (one.ids, one.only_a, one.only_b) == (55, 5, 6)


def test_comparison_of_equal_and_of_none(spark):
    a = vector(spark, {i: i // 7 for i in range(50)}, "label", "long")
    other = a.select("id", (100 - 3 * F.col("label")).alias("label"))
    one = validate.compare_partitions(a, other).first()
    assert (one.adjusted_rand, one.variation, one.moved) == (1.0, 0.0, 0) and validate.partition_differences(a, other).collect() == []
    none = a.where("false")
    assert validate.compare_partitions(none, none).first().ids == 0
    two = a.withColumn("label", F.when(F.col("id") == 6, 1).otherwise(F.col("label")))
    assert validate.partition_differences(a, two).collect() == [(6, 0, 1)] and validate.compare_partitions(a, two).first().moved == 1


def test_digest_tells_partitions_apart(spark):
    rng = random.Random(4)
    base = {i: rng.randrange(9) for i in range(300)}
    digest = lambda x: reports.partition_digest(vector(spark, x, "label", "long")).first().digest
    first = digest(base)
    assert first == digest({k: 1000 - 7 * v for k, v in base.items()}) == digest(dict(sorted(base.items(), reverse=True)))
    seen = {first, digest({}), digest({0: 5}), digest({0: 5, 1: 5}), digest({0: 5, 1: 6})}
    for k in range(3):
        seen.add(digest(base | {17 + k: base[17 + k] + 1 if base[17 + k] < 8 else 0}))
    assert len(seen) == 8 and len(first) == 28


def test_subset_is_a_prefix_of_one_shuffle(spark):
    rows = spark.range(200).withColumnRenamed("id", "k")
    every = {r.place: r.k for r in generate.shuffled_subset(rows, ["k"], 200, seed=9).collect()}
    some = {r.place: r.k for r in generate.shuffled_subset(rows.repartition(7), ["k"], 50, seed=9).collect()}
    assert sorted(every) == list(range(200)) and sorted(every.values()) == list(range(200)) and some == {k: every[k] for k in range(50)}
    assert [every[k] for k in range(200)] != sorted(every.values()) and generate.shuffled_subset(rows, ["k"], 500).count() == 200
