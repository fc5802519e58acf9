"""Distributed connected components by repeated contraction.

In a round every vertex points to the least of itself and its neighbours, and
the edges are carried over to where their ends point; edges that become loops
and repeats go. Connected vertices stay connected and no vertex leaves its
component, so when no edge is left the pointers, followed from round to round,
lead every vertex to one representative. A star disappears in one round. "Least"
is by id in the first rounds and by a hash of the id, new in each round, from
then on: along any graph, sorted chains too, the vertices then become fewer by a
constant factor on average, so rounds are logarithmic in their number.

No vertex's neighbours are gathered: a round is a grouped minimum (combined
before the shuffle) and two equi-joins of written tables with it, whose hot keys
adaptive execution can split as both sides are plain exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop

#: Rounds whose order is that of the ids themselves.
BY_ID = 2


def _point(ends: DataFrame, k: int) -> DataFrame:
    """(u, v) -> (id, to): every vertex to the least of itself and its neighbours."""
    if k < BY_ID:
        return ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("to"))
    ranked = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("x"))
    low = ends.groupBy("u").agg(F.min(ranked("v")).alias("low"))
    return low.select(F.col("u").alias("id"), F.least(ranked("u"), F.col("low"))["x"].alias("to"))


def _pairs(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Component of every endpoint in ``edges``, taken as undirected.

    Returns ``(id, component)`` with ``component`` the smallest id reachable.
    Ids may be of any one ordered type. Edges with a null endpoint link nothing
    and are left out, self-loops make a component of one; an empty table gives
    an empty result. Repeated edges change nothing.
    """
    left = {"n": F.count_if(F.col("a") != F.col("b"))}
    given = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null")
    cur, seen = cut(given.select(*_pairs(F.col("x"), F.col("y"))).distinct(), "cc", **left)
    steps: list[DataFrame] = []
    while seen["n"] or not steps:
        if len(steps) >= max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        ends = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(cur.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v")))
        to = cut(_point(ends, len(steps)), "cc-to")
        steps.append(to)
        if not seen["n"]:
            break
        far = cur.where("a <> b").join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        new, seen = cut(far.where("x <> y").select(*_pairs(F.col("x"), F.col("y"))).distinct(), "cc", **left)
        drop(cur)
        cur = new
    drop(cur)
    found = steps[-1].select("id", F.col("to").alias("component"))
    if len(steps) == 1:
        found._fjord_path = steps[0]._fjord_path
        return found
    for to in reversed(steps[:-1]):
        later = found.select(F.col("id").alias("to"), "component")
        found = to.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    found = cut(found, "cc-out")
    if len(steps) > BY_ID:
        least = cut(found.groupBy("component").agg(F.min("id").alias("least")), "cc-least")
        named = cut(found.join(least, "component").select("id", F.col("least").alias("component")), "cc-out")
        drop(found, least)
        found = named
    drop(*steps)
    return found
