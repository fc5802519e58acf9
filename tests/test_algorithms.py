import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fjordgraph.operators import layout, traversal
from fjordgraph.operators.components import connected_components
from fjordgraph.operators.fixpoint import least_values
from fjordgraph.operators.graph import Graph, formula_weight
from fjordgraph.operators.labels import fixed_point_violations, label_propagation, label_propagation_undirected
from fjordgraph.operators.louvain import local_move, louvain, modularity
from fjordgraph.operators.pagerank import pagerank
from fjordgraph.operators.pregel import pregel
from fjordgraph.operators.traversal import bfs, sssp

from . import plain

TRI = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]


def edges_of(spark, rows, weighted=False):
    df = spark.createDataFrame(rows, "src long, dst long" if not weighted else "src long, dst long, weight double")
    return df


def values(df, c):
    return {r["id"]: r[c] for r in df.collect()}


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("rows,n,expected", [(TRI, 5, [0, 1, 1, 2, 3]), ([(0, 1), (2, 3)], 4, [0, 1, None, None]), ([(0, 1), (1, 2), (2, 0)], 3, [0, 1, 2])])
def test_bfs_known(spark, rows, n, expected):
    out, info = bfs(Graph(edges_of(spark, rows), n), 0)
    assert values(out, "level") == dict(enumerate(expected))
    assert info.iterations == max(x for x in expected if x is not None)


def test_bfs_cap_and_stray_source(spark):
    g = Graph(edges_of(spark, [(i, i + 1) for i in range(6)]), 7)
    assert values(bfs(g, 0, max_levels=2)[0], "level") == {0: 0, 1: 1, 2: 2, 3: None, 4: None, 5: None, 6: None}
    assert set(values(bfs(g, 99)[0], "level").values()) == {None}


def test_random_traversals(spark):
    rows = random_edges(3, 40, 70) + [(39, 99), (7, 7)]
    inside = [(u, v) for u, v in rows if v < 40]
    g = Graph(edges_of(spark, rows), 40)
    assert values(bfs(g, 5)[0], "level") == plain.bfs(inside, 40, 5)
    w = [(u, v, 1 + (u * 31 + v * 17 + 7) % 13) for u, v in inside]
    wg = Graph(edges_of(spark, inside).withColumn("weight", formula_weight()), 40)
    got, info = sssp(wg, 5)
    assert values(got, "distance") == plain.dijkstra(w, 40, 5)
    assert info.converged
    assert values(connected_components(edges_of(spark, inside)), "component") == plain.components(inside)


def test_sssp_known_and_bad_weights(spark):
    g = Graph(edges_of(spark, TRI).withColumn("weight", formula_weight()), 5)
    assert values(sssp(g, 0)[0], "distance") == {0: 0.0, 1: 12.0, 2: 3.0, 3: 7.0, 4: 20.0}
    for w in (-1.0, float("inf"), float("nan")):
        with pytest.raises(Exception, match="finite and not negative"):
            Graph(edges_of(spark, [(0, 1, w)], True), 2).edges.collect()
    assert Graph(edges_of(spark, [(0, 1, None)], True), 2).edges.first().weight == 1.0


def test_pagerank(spark):
    for n in (2, 3):
        out, info = pagerank(Graph(edges_of(spark, [(i, (i + 1) % n) for i in range(n)]), n))
        assert all(abs(v - 1 / n) < 1e-9 for v in values(out, "rank").values()) and info.converged
    rows = [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (0, 3)]
    got = values(pagerank(Graph(edges_of(spark, rows), 5), max_iter=8, tol=0.0)[0], "rank")
    want = plain.pagerank(rows, 5, 8)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want) and abs(sum(got.values()) - 1) < 1e-12


def test_labels(spark):
    seeds = spark.createDataFrame([(0, 5), (1, 3), (1, 4), (3, -2)], "id long, label long")
    tie = Graph(edges_of(spark, [(2, 0), (2, 1)]), 4)
    out, info = label_propagation(tie, seeds)
    assert values(out, "label") == {0: 5, 1: 3, 2: 3, 3: None} and info.converged and info.iterations == 2
    assert not fixed_point_violations(tie, out, seeds).collect()
    rows = random_edges(8, 30, 80)
    for s in (None, {0: 1, 7: 2, 9: 2}):
        df = None if s is None else spark.createDataFrame(list(s.items()), "id long, label long")
        got, i = label_propagation(Graph(edges_of(spark, rows), 30), df, max_iter=4)
        want, k, done = plain.labels(rows, 30, s, 4)
        assert values(got, "label") == want and (i.iterations, i.converged) == (k, done)


def test_label_swap_never_settles(spark):
    _, info = label_propagation(Graph(edges_of(spark, [(0, 1), (1, 0)]), 2), max_iter=5)
    assert info.iterations == 5 and not info.converged


def test_undirected_labels(spark):
    seeds = spark.createDataFrame([(0, 1), (9, 2)], "id long, label long")
    out, info = label_propagation_undirected(edges_of(spark, [(0, 1), (1, 0), (1, 2), (9, 8)]), seeds)
    assert values(out, "label") == {0: 1, 1: 1, 2: 1, 8: 2, 9: 2} and info.converged


def test_components_edge_cases(spark):
    rows = [(3, 3), (None, 1), (5, 4), (4, 5), (5, 6)]
    assert values(connected_components(edges_of(spark, rows)), "component") == {3: 3, 4: 4, 5: 4, 6: 4}
    assert connected_components(edges_of(spark, [])).collect() == []
    star = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)]
    assert values(connected_components(edges_of(spark, star)), "component") == plain.components(star)


def test_pregel_equals_bfs(spark):
    rows = random_edges(4, 20, 30)
    g = Graph(edges_of(spark, rows), 20)
    start = g.vertices.select("id", F.when(F.col("id") == 0, 0).alias("d"))
    out, info = pregel(start, g.edges, F.min("msg"), {"d": F.least("d", "msg")}, to_dst=F.col("src_d") + 1)
    assert values(out, "d") == plain.bfs(rows, 20, 0) and info.converged


def test_louvain_two_cliques(spark):
    clique = lambda a: [(a + i, a + j, 1.0) for i in range(5) for j in range(i)]
    e = edges_of(spark, [*clique(0), *clique(5), (0, 5, 1.0)], True)
    alone = spark.createDataFrame([(i,) for i in range(12)], "id long")
    out, info = louvain(e, vertices=alone)
    got = values(out, "community")
    assert got == {i: i // 5 for i in range(10)} | {10: 2, 11: 3} and info.converged
    q = modularity(e, out).first().modularity
    m2 = 2 * 21
    assert abs(q - 2 * (20 / m2 - (21 / m2) ** 2)) < 1e-12


def test_louvain_finds_planted_communities(spark):
    """As good as the partition that the graph was made from, and no move left."""
    rng = random.Random(4)
    rows = [(u, v, 1.0) for u in range(60) for v in range(u + 1, 60) if rng.random() < (0.5 if u // 15 == v // 15 else 0.03)]
    e = edges_of(spark, rows, True)
    out, _ = louvain(e)
    planted = spark.range(60).select("id", (F.col("id") / 15).cast("long").alias("community"))
    assert modularity(e, out).first().modularity >= modularity(e, planted).first().modularity - 1e-9
    assert values(louvain(edges_of(spark, [(3, 3, 2.0)], True))[0], "community") == {3: 0}


def no_gaining_move(e, found):
    """In SQL, over the result: the most that any vertex would gain by moving alone."""
    con = duckdb.connect()
    con.register("e", pd.DataFrame([tuple(r) for r in e.collect()], columns=["src", "dst", "weight"]))
    con.register("c", pd.DataFrame([tuple(r) for r in found.collect()], columns=["id", "community"]))
    return con.sql("""with ends as (select src u, dst v, weight w from e union all select dst, src, weight from e where src <> dst),
        d as (select u id, sum(w) d from ends group by 1), m as (select sum(2 * weight) m2 from e), t as (select community, sum(d) t from d join c using (id) group by 1),
        own as (select id, community, d, t, coalesce((select sum(w) from ends x join c y on y.id = x.v where x.u = d.id and x.v <> x.u and y.community = c.community), 0) w from d join c using (id) join t using (community)),
        links as (select u id, c.community, sum(w) w from ends join c on c.id = v where u <> v group by 1, 2)
        select max((l.w - o.d * t.t / m2) - (o.w - o.d * (o.t - o.d) / m2)) from links l join own o using (id) join t on t.community = l.community, m where l.community <> o.community""").fetchall()[0][0]


def test_modularity_rises_from_sweep_to_sweep(spark, monkeypatch):
    """Also on a graph whose vertices are communities, with loops and many movers."""
    from fjordgraph.operators import louvain as lv

    rng = random.Random(11)
    rows = {(min(u, v), max(u, v)): float(rng.randrange(1, 9)) for u, v in ((rng.randrange(50), rng.randrange(50)) for _ in range(260))}
    rows |= {(0, v): 3.0 for v in range(1, 50)}
    e = edges_of(spark, [(u, v, w) for (u, v), w in rows.items()], True)
    seen, placed = [], lv._placed

    def spy(layout_, members, moves=None):
        out = placed(layout_, members, moves)
        if out[1]["moved"] or moves is None:
            seen.append(modularity(e, out[0]).first().modularity)
        return out

    monkeypatch.setattr(lv, "_placed", spy)
    local_move(e)
    assert len(seen) > 4 and all(b > a for a, b in zip(seen, seen[1:], strict=False))
    _, info = louvain(e)
    passes = [m["modularity"] for m in info.metrics]
    assert passes == sorted(passes)


@pytest.mark.parametrize("seed,n,p", [(1, 60, 0.1), (2, 40, 0.5), (3, 90, 0.03)])
def test_local_move_rises_until_no_move_gains(spark, seed, n, p):
    rng = random.Random(seed)
    rows = [(u, v, float(rng.randrange(1, 5))) for u in range(n) for v in range(u, n) if rng.random() < p]
    e = edges_of(spark, rows, True)
    log: list = []
    found = local_move(e, log)
    assert all(x["gain"] > 0 and 0 < x["moved"] <= x["would"] for x in log)
    assert (no_gaining_move(e, found) or 0) <= 1e-9
    ids = found.select("id", F.col("id").alias("community"))
    # movers of one sweep take at most half of their gains from each other
    rose = modularity(e, found).first().modularity - modularity(e, ids).first().modularity
    assert sum(x["gain"] / (1 + x["together"]) for x in log) <= rose + 1e-9


@pytest.mark.parametrize("few", [100_000, 0])
def test_local_move_takes_few_sweeps(spark, monkeypatch, few):
    """On a random graph, where vertices want to follow one another; moves broadcast or not."""
    from fjordgraph.operators import louvain as lv

    class Log(list):
        def append(self, x):
            super().append(x)
            assert len(self) <= 20

    monkeypatch.setattr(lv, "FEW", few, raising=False)
    rng = random.Random(7)
    rows = [(u, v, float(rng.randrange(1, 14))) for u in range(150) for v in range(u + 1, 150) if rng.random() < 0.2]
    e = edges_of(spark, rows, True)
    log = Log()
    found = local_move(e, log)
    assert no_gaining_move(e, found) <= 1e-9 and log[-1]["moved"] > 0
    assert modularity(e, found).first().modularity > 0.13


@pytest.mark.parametrize("small", [100_000, 0])
def test_local_move_settles_followers_in_one_sweep(spark, monkeypatch, small):
    """Vertices that wait for one another follow in one sweep, and gains add up exactly;
    links of a task are bounded."""
    from fjordgraph.operators import louvain as lv

    monkeypatch.setattr(lv, "SMALL", small, raising=False)
    rng = random.Random(3)
    rows = [(u, v, float(rng.randrange(1, 14))) for u in range(400) for v in range(u + 1, 400) if rng.random() < 0.08] + [(5, 5, 4.0)]
    e = edges_of(spark, rows, True)

    class Log(list):
        def append(self, x):
            super().append(x)
            assert len(self) <= 12

    log = Log()
    found = local_move(e, log)
    assert no_gaining_move(e, found) <= 1e-9
    assert not log[-1]["together"] and log[-1]["moved"] > 0
    ids = found.select("id", F.col("id").alias("community"))
    rose = modularity(e, found).first().modularity - modularity(e, ids).first().modularity
    assert sum(x["gain"] / (1 + x["together"]) for x in log) <= rose + 1e-9


def exchanged(df):
    """The columns by which each exchange of the plan deals its rows, and its scans of
    bucketed tables."""
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan), plan.count("Bucketed: true")


def test_hubs_are_spread(spark, monkeypatch):
    """A hub with nine tenths of the edges fills no partition, and results stay."""
    monkeypatch.setattr(layout, "HUB_EDGES", 50)
    rng = random.Random(2)
    rows = [(0, 1 + k % 299) for k in range(1800)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    with Graph(edges_of(spark, rows), 300) as g:
        near, hubs, far = g.layout.by("src")
        assert [r.src for r in hubs.collect()] == [0] and near.count() < 250 and near.count() + far.count() == len(rows)
        state = g.layout.begin(spark.range(300).withColumn("x", F.col("id") * 2), "state")
        assert sorted((r.src, r.dst, r.x) for r in g.layout.along(state, "src").collect()) == sorted((u, v, 2 * u) for u, v in rows)
        assert values(bfs(g, 0)[0], "level") == plain.bfs(rows, 300, 0)
        ranks = values(pagerank(g, 5, tol=0.0)[0], "rank")
        want = plain.pagerank(rows, 300, 5)
        assert all(abs(ranks[k] - want[k]) < 1e-12 for k in want)
        assert values(label_propagation(g, max_iter=3)[0], "label") == plain.labels(rows, 300, None, 3)[0]
        assert g.layout.by("src")[0] is near  # three algorithms, one layout


def test_supersteps_shuffle_messages_only(spark, monkeypatch):
    """Neither edges nor states are exchanged in any superstep of any loop."""
    plans = []
    store = layout.Layout.store
    monkeypatch.setattr(layout.Layout, "store", lambda self, df, name, **m: (plans.append((name, *exchanged(df))), store(self, df, name, **m))[1])
    rows = random_edges(5, 40, 120)
    with Graph(edges_of(spark, [(u, v, 1.0 + u % 3) for u, v in rows], True), 40) as g:
        bfs(g, 0)
        sssp(g, 0)
        pagerank(g, 3, tol=0.0)
        label_propagation(g, max_iter=3)
        start = g.vertices.select("id", F.when(F.col("id") == 0, 0).alias("d"))
        pregel(start, g.edges, F.min("msg"), {"d": F.least("d", "msg")}, to_dst=F.col("src_d") + 1, reads=("src",))
        assert len(g.layout._by) == 2
        bfs(Graph(g.edges, vertices=g.vertices, closed=True), 0)
    steps = [p for p in plans if p[2] > 1]
    assert {p[0] for p in steps} == {"bfs", "sssp", "pagerank", "labels", "pregel"}
    for name, keys, scans in steps:
        assert sorted(keys) in ([["id", "id, label"]] if name == "labels" else [["dst"], ["id"]]), (name, keys)
    assert g.layout._by == {} and not g.layout._written


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_bitmaps_are_sets(spark, monkeypatch, broadcast):
    monkeypatch.setattr(traversal, "BROADCAST_BITMAPS", broadcast)
    rng = random.Random(7)
    a, b = ({rng.choice([0, 1, 7, 8, 9, 32767, 32768, 32769, 70_000, 65_536, rng.randrange(100_000)]) for _ in range(60)} for _ in range(2))
    ids = lambda x: spark.createDataFrame([(i,) for i in sorted(x)] * 2, "id long")
    known = traversal.merged(traversal.bitmaps(ids(a)), traversal.bitmaps(ids(b)))
    asked = {*a, *b, *range(0, 100_000, 37), 0, 2, 32766, 99_999}
    assert {r.id for r in traversal.not_in(ids(asked), known, 100_000).collect()} == asked - a - b
    assert {r.id for r in traversal.not_in(ids(asked), known.where("false"), 100_000).collect()} == asked


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_bfs_with_and_without_bitmaps(spark, monkeypatch, broadcast):
    monkeypatch.setattr(traversal, "BROADCAST_BITMAPS", broadcast)
    rows = [(i, i + 1) for i in range(12)] + [(i, i) for i in range(14)] + [(12, 3), (0, 5)] + random_edges(8, 14, 4)
    e = edges_of(spark, rows)
    dense, info = bfs(Graph(e, 14), 0)
    sparse, other = bfs(Graph(e, vertices=spark.range(14)), 0)
    assert values(dense, "level") == values(sparse, "level") == plain.bfs(rows, 14, 0)
    assert info.iterations == other.iterations and [m["changed"] for m in info.metrics] == [m["changed"] for m in other.metrics]
    for cap in (0, 1, 3):
        got = [values(bfs(g, 0, max_levels=cap)[0], "level") for g in (Graph(e, 14), Graph(e, vertices=spark.range(14)))]
        assert got[0] == got[1] == plain.bfs(rows, 14, 0, cap)


def test_a_failed_loop_leaves_no_state(spark):
    rows = random_edges(6, 10, 20)
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(Exception, match="no such"), Graph(edges_of(spark, rows), 10) as g:
        least_values(g.vertices.select("id", F.lit(0).alias("value")), lambda s: s.select("id", F.raise_error(F.lit("no such")).cast("int").alias("value")), None, "t", g.layout)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_edges_leave_a_given_domain(spark):
    """Edges that lead out of the vertices go before anything is counted."""
    e = edges_of(spark, [(0, 1), (1, 7), (7, 0), (1, 0), (1, 0)])
    ids = spark.createDataFrame([(0,), (1,), (4,)], "id long")
    g = Graph(e, vertices=ids)
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(0, 1), (1, 0), (1, 0)]
    ranks = values(pagerank(g, 50)[0], "rank")
    assert set(ranks) == {0, 1, 4} and abs(sum(ranks.values()) - 1) < 1e-9
    assert values(bfs(g, 0)[0], "level") == {0: 0, 1: 1, 4: None}
