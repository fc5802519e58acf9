"""Vertex programs on DataFrames: ``aggregate_messages`` and ``pregel``.

Expressions see an edge's columns as ``src``, ``dst``, ``weight`` ... and the
state of its ends as ``src_<name>`` and ``dst_<name>``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import RunInfo, iterate
from .layout import Layout


BOTH = ("src", "dst")
#: An aggregate over the column ``msg``, or a function from a series to a value.
Merge = Column | Callable[[pd.Series], object]
#: Messages of a vertex in one batch that are merged before the shuffle.
OFTEN = 32


def merged_by(messages: DataFrame, op: Callable[[pd.Series], object]) -> DataFrame:
    """``id, msg`` merged by a function of one's own, from a series to one value of the
    messages' type. It must not care how messages are grouped and ordered.

    Before the shuffle, only messages of vertices that a batch has often are merged, so
    a vertex with many sends few per batch, and the others cost no call of ``op``. Then
    each task has its vertices' messages one after another and merges them batch by
    batch, so no task holds all messages of a vertex.
    """
    schema = messages.select("id", "msg").schema

    def runs(b: pd.DataFrame) -> pd.DataFrame:
        """One row for each run of equal ids."""
        ids, msg = b["id"].to_numpy(), b["msg"]
        at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return pd.DataFrame({"id": ids[at], "msg": [op(msg.iloc[i:j]) for i, j in zip(at, [*at[1:], len(b)], strict=True)]})

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            often = b["id"].map(b["id"].value_counts()) >= OFTEN if len(b) else None
            if often is not None and often.any():
                yield b[~often]
                b = runs(b[often].sort_values("id", kind="stable"))
            yield b

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            if len(b):
                out = runs(b if kept is None else pd.concat([kept, b], ignore_index=True))
                yield out[:-1]
                kept = out[-1:]
        if kept is not None:
            yield kept

    sent = messages.select("id", "msg").where("id is not null").mapInPandas(ahead, schema)
    return sent.repartition("id").sortWithinPartitions("id").mapInPandas(last, schema)


def triplets(vertices: DataFrame, edges: DataFrame, reads: tuple[str, ...] = BOTH) -> DataFrame:
    """Edges with the attributes of the ends in ``reads``."""
    names = [c for c in vertices.columns if c != "id"]
    for s in reads:
        edges = edges.join(vertices.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in names]), s)
    return edges


def aggregate_messages(vertices: DataFrame, edges: DataFrame, merge: Merge, to_dst: Column | None = None, to_src: Column | None = None, reads: tuple[str, ...] = BOTH) -> DataFrame:
    """``id, msg``: messages along the edges, merged per receiver.

    ``merge`` is an aggregate over the column ``msg``, or a function as
    :func:`merged_by` takes it; null messages are none.
    Messages that use one end's attributes only need one join: ``reads`` says
    which ends they use.
    """
    return _merged(triplets(vertices, edges, reads), merge, to_dst, to_src)


def _triplets(state: DataFrame, layout: Layout, reads: tuple[str, ...]) -> DataFrame:
    """:func:`triplets` over stored edges and a state beside them."""
    names = [c for c in state.columns if c != "id"]
    first, *rest = reads
    near = layout.along(state.select("id", *[F.col(c).alias(f"{first}_{c}") for c in names]), first)
    return triplets(state, near, tuple(rest))


def _merged(t: DataFrame, merge: Merge, to_dst: Column | None, to_src: Column | None) -> DataFrame:
    sent = [t.select(F.col(at).alias("id"), m.alias("msg")) for at, m in (("dst", to_dst), ("src", to_src)) if m is not None]
    if not sent:
        raise ValueError("no message is sent")
    both = sent[0] if len(sent) == 1 else sent[0].unionByName(sent[1])
    sent = both.where("msg is not null")
    return sent.groupBy("id").agg(merge.alias("msg")) if isinstance(merge, Column) else merged_by(sent, merge)


def pregel(vertices: DataFrame, edges: DataFrame, merge: Merge, update: dict[str, Column], to_dst: Column | None = None, to_src: Column | None = None, max_iter: int = 100, changed: Column | None = None, reads: tuple[str, ...] = BOTH) -> tuple[DataFrame, RunInfo]:
    """Run supersteps until no vertex changes.

    ``update`` maps attributes to expressions over the old attributes and
    ``msg`` (null where no message came). ``changed`` compares ``old_<name>`` with
    the new attributes; by default any difference is a change. ``reads`` is as in
    :func:`aggregate_messages`. Edges are stored once, by the end that is read (or the
    source, if both are), with the state beside them; a join with the other end's state
    shuffles what the first one gave.
    """
    if not reads:
        raise ValueError("messages read one end at least")
    layout = Layout(edges)
    names = [c for c in vertices.columns if c != "id"]

    def step(state: DataFrame, k: int, seen: dict) -> DataFrame:
        msgs = _merged(_triplets(state.select("id", *names), layout, reads), merge, to_dst, to_src)
        new = state.select("id", *names).join(msgs, "id", "left")
        new = new.select("id", *[F.col(c).alias(f"old_{c}") for c in names], *[update.get(c, F.col(c)).alias(c) for c in names])
        differs = F.lit(False)
        for c in names:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
        return new.withColumn("__changed", differs if changed is None else changed).drop(*[f"old_{c}" for c in names])

    start = vertices.withColumn("__changed", F.lit(True))
    out, info = iterate(start, step, {"changed": F.count_if("__changed")}, lambda m: m["changed"] == 0, max_iter, "pregel", layout)
    layout.release()
    return out.select("id", *names), info
