"""Proofs of results: what a right result must fulfil, checked without running again.

A certificate is a grouped aggregation over the edges and a join with the result; it
costs about what a superstep does. Violations are rows ``id, rule``, so a right result
has none. A rule names what is wrong at a vertex:

* ``missing``, ``extra``, ``repeated``: ids against the graph's vertices,
* ``source``: the source is not at 0 (or has a value though it is no vertex),
* ``edge``: an edge leads to a smaller value than the vertex has, or to one without any,
* ``predecessor``: no edge leads to the vertex's value,
* ``support``: its value rests on edges of weight 0 only, which lead round in circles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fixpoint import least_values
from ..operators.graph import Graph, out_degree
from ..operators.layout import Layout
from ..storage import cut, drop


def _ids(graph: Graph, result: DataFrame) -> DataFrame:
    """Rules about ids: each vertex has one row, and no one else has."""
    both = graph.vertices.select("id", F.lit(1).alias("v"), F.lit(0).alias("r")).unionAll(result.select("id", F.lit(0), F.lit(1)))
    n = both.groupBy("id").agg(F.sum("v").alias("v"), F.sum("r").alias("r"))
    rule = F.when(F.col("v") == 0, "extra").when(F.col("r") == 0, "missing").when(F.col("r") > 1, "repeated")
    return n.select("id", rule.alias("rule")).where("rule is not null")


def _told(graph: Graph, known: DataFrame, weight: Column) -> DataFrame:
    """``id, told``: the least value that an edge leads to."""
    sent = graph.edges.join(known.select(F.col("id").alias("src"), F.col("value").alias("from")), "src")
    return sent.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("from") + weight).alias("told"))


def _rules(graph: Graph, result: DataFrame, told: DataFrame, source: int, more: Column, less: Column) -> DataFrame:
    every = graph.vertices.join(result, "id").join(told, "id", "left")
    at = F.col("id") == F.lit(source)
    rule = F.when(at, F.when(~F.col("value").eqNullSafe(F.lit(0)), "source"))
    rule = rule.when(F.col("told").isNotNull() & (F.col("value").isNull() | more), "edge")
    rule = rule.when(F.col("value").isNotNull() & (F.col("told").isNull() | less), "predecessor")
    return every.select("id", rule.alias("rule")).where("rule is not null")


def bfs_violations(graph: Graph, levels: DataFrame, source: int, max_levels: int | None = None) -> DataFrame:
    """``id, rule`` for hops ``id, level``; with ``max_levels`` vertices beyond have none.

    Every level but the source's must be one more than the least level with an edge to
    it. As a level cannot rest on itself then, this has one solution.
    """
    r = levels.select("id", F.col("level").alias("value"))
    sends = r.where("value is not null")
    told = _told(graph, sends if max_levels is None else sends.where(F.col("value") < max_levels), F.lit(1))
    return _rules(graph, r, told, source, F.col("value") > F.col("told"), F.col("value") < F.col("told")).unionByName(_ids(graph, r))


def sssp_violations(graph: Graph, distances: DataFrame, source: int, rel: float = 1e-9, absolute: float = 1e-9) -> DataFrame:
    """``id, rule`` for ``id, distance``, within ``max(absolute, rel * magnitude)``.

    Triangle inequality at every edge, and a tight edge at every vertex that is reached.
    Tight edges of weight 0 may form circles that hold each other up; vertices that no
    other tight edge enters are therefore followed back from those that one does.
    """
    weight = F.col("weight") if "weight" in graph.edges.columns else F.lit(1.0)
    r = distances.select("id", F.col("distance").alias("value"))
    known = cut(r.where("value is not null"), "distances")
    off = F.greatest(F.lit(absolute), F.lit(rel) * F.abs(F.col("told")))
    out = _rules(graph, r, _told(graph, known, weight), source, F.col("value") > F.col("told") + off, F.col("value") < F.col("told") - off)
    a = known.select(F.col("id").alias("src"), F.col("value").alias("a"))
    b = known.select(F.col("id").alias("dst"), F.col("value").alias("b"))
    near = F.abs(F.col("a") + weight - F.col("b")) <= F.greatest(F.lit(absolute), F.lit(rel) * F.abs("b"))
    tight = cut(graph.edges.join(a, "src").join(b, "dst").where(near).select("src", "dst", (weight > F.lit(absolute)).alias("real")), "tight")
    held = tight.groupBy(F.col("dst").alias("id")).agg(F.max("real").alias("real"))
    loose, seen = cut(held.where(~F.col("real") & (F.col("id") != source)).select("id"), "loose", n=F.count(F.lit(1)))
    if seen["n"]:
        firm = known.join(loose, "id", "left_anti").select("id", F.lit(0).alias("value"))
        layout = Layout(tight.where("not real").select("src", "dst"))
        step = lambda rows: layout.along(rows, "src").select(F.col("dst").alias("id"), "value")
        reached, _ = least_values(firm, step, None, "support", layout)
        out = out.unionByName(cut(loose.join(reached, "id", "left_anti").select("id", F.lit("support").alias("rule")), "unsupported"))
        drop(reached)
        layout.release()
    drop(loose)
    return out.unionByName(_ids(graph, r))


def pagerank_residual(graph: Graph, ranks: DataFrame, damping: float = 0.85) -> DataFrame:
    """One row ``total, residual, greatest, error_bound, unlike`` for ``id, rank``.

    ``residual`` is the L1 change that one more round would make, and ``greatest`` its
    largest part. A round brings any two vectors closer by ``damping`` in L1, so the
    true ranks are within ``error_bound`` = residual / (1 - damping). ``unlike`` counts
    ids that are missing, extra or repeated; missing ranks count as 0.
    """
    r = cut(graph.vertices.join(ranks.groupBy("id").agg(F.sum("rank").alias("rank")), "id", "left").join(out_degree(graph.edges), "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("degree", F.lit(0)).alias("degree")), "ranks")
    share = r.where("degree > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("share"))
    sent = graph.edges.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("sent"))
    whole = r.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("degree") == 0, F.col("rank")).otherwise(0.0)).alias("loose"), F.sum("rank").alias("total"))
    both = r.join(sent, "id", "left").crossJoin(F.broadcast(whole))
    new = (1.0 - damping) / F.col("n") + damping * (F.coalesce("sent", F.lit(0.0)) + F.col("loose") / F.col("n"))
    change = F.abs(new - F.col("rank"))
    one = both.agg(F.max("total").alias("total"), F.sum(change).alias("residual"), F.max(change).alias("greatest"))
    unlike = _ids(graph, ranks).agg(F.count(F.lit(1)).alias("unlike"))
    return one.crossJoin(F.broadcast(unlike)).select("total", "residual", "greatest", (F.col("residual") / (1.0 - damping)).alias("error_bound"), "unlike")
