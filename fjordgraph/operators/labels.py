"""Label propagation, seeded or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import RunInfo, iterate
from .graph import Graph, clean_seeds, initial_labels, undirected_simple


def majority(votes: DataFrame) -> DataFrame:
    """``id, label`` votes -> ``id, best``: the most frequent, least on ties.

    Votes are counted per label before they meet at the vertex, so a vertex of
    any degree costs one row per label and task.
    """
    counts = votes.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", (-F.col("label")).alias("neg")))
    return counts.groupBy("id").agg(top.alias("top")).select("id", (-F.col("top.neg")).alias("best"))


def _step(graph: Graph, state: DataFrame) -> DataFrame:
    known = state.where("label is not null").select("id", "label")
    best = majority(graph.layout.along(known, "dst").select(F.col("src").alias("id"), "label"))
    new = F.when(F.col("is_seed"), F.col("label")).otherwise(F.coalesce("best", "label"))
    both = state.join(best, "id", "left")
    return both.select("id", new.alias("label"), "is_seed", (~new.eqNullSafe(F.col("label"))).alias("changed"))


def label_propagation(graph: Graph, seeds: DataFrame | None = None, max_iter: int = 50, threshold: int = 0, ratio: float | None = None) -> tuple[DataFrame, RunInfo]:
    """``id, label``: synchronous majority of the out-neighbours' labels.

    Seeds keep their label; without seeds every vertex starts with its id.
    Unlabelled neighbours do not vote, a vertex without a vote keeps what it
    has, and its own label gets no extra vote. Stops after a round with at most
    ``threshold`` changes, or where ``ratio`` is given, with none or with fewer
    changes than that share of the unseeded vertices; ``converged`` tells
    whether it did.
    """
    start = initial_labels(graph, seeds).withColumn("changed", F.lit(False))
    metrics = {"changed": F.count_if("changed"), "free": F.count_if(~F.col("is_seed"))}

    def done(m: dict) -> bool:
        if ratio is None:
            return m["changed"] <= threshold
        return m["changed"] == 0 or (m["changed"] / m["free"] if m["free"] else 0.0) < ratio

    state, info = iterate(start, lambda s, k, m: _step(graph, s), metrics, done, max_iter, "labels", graph.layout)
    graph.release()
    return state.select("id", "label"), info


def label_propagation_undirected(edges: DataFrame, seeds: DataFrame, max_iter: int = 100, ratio: float = 0.01) -> tuple[DataFrame, RunInfo]:
    """The same on a simple undirected graph, with the ratio stop.

    Vertices are the endpoints and the seeds.
    """
    both = undirected_simple(edges)
    ids = both.select(F.col("src").alias("id")).unionAll(clean_seeds(seeds).select("id")).distinct()
    return label_propagation(Graph(both, vertices=ids, closed=True), seeds, max_iter, ratio=ratio)


def label_summary(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count("label").alias("labeled"), F.count_distinct("label").alias("labels"))


def fixed_point_violations(graph: Graph, labels: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Vertices where a converged result breaks a rule: ``id, rule``.

    ``seed``: a seed that lost its label; ``coverage``: an unlabelled vertex
    with a labelled out-neighbour; ``majority``: one whose label is not its
    neighbours' majority.
    """
    seeded = initial_labels(graph, seeds if seeds is not None else graph.spark.createDataFrame([], "id long, label long"))
    now = seeded.select("id", F.col("label").alias("seed"), "is_seed").join(labels, "id", "left")
    known = labels.where("label is not null").select(F.col("id").alias("dst"), F.col("label").alias("vote"))
    best = majority(graph.edges.join(known, "dst").select(F.col("src").alias("id"), F.col("vote").alias("label")))
    all_ = now.join(best, "id", "left")
    rule = F.when(F.col("is_seed"), F.when(~F.col("seed").eqNullSafe(F.col("label")), "seed")).when(F.col("best").isNotNull() & F.col("label").isNull(), "coverage").when(F.col("best") != F.col("label"), "majority")
    return all_.select("id", rule.alias("rule")).where("rule is not null")
