"""The superstep loop shared by all iterative operators.

A superstep is one job: the new state is written to the shared folder with its
metrics observed on the way, the old one is deleted, and the metrics alone decide
whether to go on. Lineage is one superstep long at all times. Where the state lies
beside the edges (:mod:`.layout`), messages are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop
from .layout import Layout


@dataclass
class RunInfo:
    """What a run reports besides its table."""

    iterations: int = 0
    converged: bool = False
    metrics: list[dict] = field(default_factory=list)


def iterate(
    state: DataFrame,
    step: Callable[[DataFrame, int, dict], DataFrame],
    metrics: dict[str, Column],
    stop: Callable[[dict], bool],
    max_iter: int | None,
    name: str,
    layout: Layout | None = None,
) -> tuple[DataFrame, RunInfo]:
    """Apply ``step(state, k, last metrics)`` until ``stop`` or ``max_iter``.

    With a ``layout`` the state has a unique ``id`` and is stored beside its edges.
    """
    info = RunInfo()
    first, later = (layout.begin, layout.store) if layout is not None else (cut, cut)
    state, seen = first(state, name, **metrics)
    try:
        while max_iter is None or info.iterations < max_iter:
            info.iterations += 1
            new, seen = later(step(state, info.iterations, seen), name, **metrics)
            drop(state)
            state = new
            info.metrics.append(seen)
            if stop(seen):
                info.converged = True
                break
    except BaseException:
        drop(state)
        raise
    return state, info


def least_values(start: DataFrame, send: Callable[[DataFrame], DataFrame], max_iter: int | None, name: str, layout: Layout, limit: Column | None = None) -> tuple[DataFrame, RunInfo]:
    """Least fixpoint of a monotone rule: semi-naive propagation of minima.

    ``start`` has ``id, value``; ``send(changed)`` turns the rows that changed in
    the last superstep into candidates ``id, value``. Found values lie by their id
    beside the edges, so a superstep combines and shuffles candidates, and nothing
    else. ``limit`` keeps rows from being sent.
    """

    def step(state: DataFrame, k: int, seen: dict) -> DataFrame:
        active = state.where("fresh")
        sent = send((active if limit is None else active.where(limit)).select("id", "value"))
        found = sent.groupBy("id").agg(F.min("value").alias("sent"))
        better = F.col("sent").isNotNull() & (F.col("value").isNull() | (F.col("sent") < F.col("value")))
        both = state.join(found, "id", "full")
        return both.select("id", F.when(better, F.col("sent")).otherwise(F.col("value")).alias("value"), better.alias("fresh"))

    changed = {"changed": F.count_if("fresh")}
    out, info = iterate(start.select("id", "value", F.lit(True).alias("fresh")), step, changed, lambda m: not m["changed"], max_iter, name, layout)
    return out.select("id", "value"), info
