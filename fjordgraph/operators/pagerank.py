"""PageRank by power iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import RunInfo, iterate
from .graph import Graph, out_degree


def contributions(graph: Graph, ranks: DataFrame) -> DataFrame:
    """``id, value``: rank over out-degree, summed at each destination.

    ``ranks`` has ``id, rank, degree``. A graph's repeated edges each count.
    """
    share = ranks.where("degree > 0").select("id", (F.col("rank") / F.col("degree")).alias("share"))
    return graph.layout.along(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("value"))


def pagerank(graph: Graph, max_iter: int = 100, damping: float = 0.85, tol: float = 1e-6, normalised: bool = True) -> tuple[DataFrame, RunInfo]:
    """``id, rank``; ranks sum to 1.

    With ``normalised`` off ranks start at 1, a vertex keeps ``1 - damping`` of
    its own and what dangling vertices hold is lost.

    Ranks start at 1/n, what dangling vertices hold is spread evenly, and the
    loop stops after the first round whose L1 change is below ``tol``. Degrees
    are joined once; the dangling mass of the next round is observed while a
    round is written.
    """
    n = graph.n if graph.n is not None else graph.vertices.count()
    if n == 0:
        return graph.vertices.select("id", F.lit(0.0).alias("rank")), RunInfo(converged=True)
    start = graph.vertices.join(out_degree(graph.edges), "id", "left")
    start = start.select("id", F.lit(1.0 / n if normalised else 1.0).alias("rank"), F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(0.0).alias("moved"))
    metrics = {"delta": F.sum("moved"), "loose": F.sum(F.when(F.col("degree") == 0, F.col("rank")).otherwise(0.0))}

    def step(state: DataFrame, k: int, seen: dict) -> DataFrame:
        base = (1.0 - damping) / n + damping * (seen["loose"] or 0.0) / n if normalised else 1.0 - damping
        sent = state.join(contributions(graph, state), "id", "left")
        new = F.lit(base) + F.lit(damping) * F.coalesce("value", F.lit(0.0))
        return sent.select("id", new.alias("rank"), "degree", F.abs(new - F.col("rank")).alias("moved"))

    state, info = iterate(start, step, metrics, lambda m: m["delta"] < tol, max_iter, "pagerank", graph.layout)
    graph.release()
    return state.select("id", "rank"), info


def rank_summary(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.max("rank").alias("max_rank"), F.sum("rank").alias("sum_rank"))
