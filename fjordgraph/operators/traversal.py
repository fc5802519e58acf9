"""Breadth-first levels and single-source shortest distances.

Over a dense domain ``0 .. n-1`` a breadth-first search keeps what it has visited as
bitmaps, ``n / 8`` bytes in all, and each level as a table of its own: a level reads the
frontier, the edges and the bitmaps, and writes what is new. Other domains keep levels
by id beside the edges, as distances always are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop, shared_dir
from .fixpoint import RunInfo, least_values
from .graph import Graph

#: Bitmaps are broadcast up to so many bytes, and else shuffled by their number.
BROADCAST_BITMAPS = 32 << 20


def _source(graph: Graph, source: int, value) -> DataFrame:
    return graph.vertices.where(F.col("id") == source).select("id", value.alias("value"))


def bfs(graph: Graph, source: int, max_levels: int | None = 500, all_vertices: bool = True) -> tuple[DataFrame, RunInfo]:
    """``id, level``: hops from ``source``, null where it is not reached.

    A vertex at ``max_levels`` is reached but not expanded; without a bound none is cut
    off. A source outside the
    domain reaches nothing. ``iterations`` counts the levels beyond the source
    that were found, without the last round that finds none. With
    ``all_vertices`` off only reached vertices are returned.
    """
    if graph.n is not None:
        levels, info = _bfs_bitmaps(graph, source, max_levels)
    else:
        def send(frontier: DataFrame) -> DataFrame:
            return graph.layout.along(frontier, "src").select(F.col("dst").alias("id"), (F.col("value") + 1).alias("value"))

        limit = F.col("value") < max_levels if max_levels is not None else None
        found, info = least_values(_source(graph, source, F.lit(0)), send, None, "bfs", graph.layout, limit)
        info.iterations -= 1
        levels = found.select("id", F.col("value").alias("level"))
    graph.release()
    return (graph.vertices.join(levels, "id", "left") if all_vertices else levels), info


def bitmaps(ids: DataFrame) -> DataFrame:
    """``bitmap, bits``: the ids as bits of numbered bitmaps; repeats change nothing."""
    return ids.groupBy(F.bitmap_bucket_number("id").alias("bitmap")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def merged(*tables: DataFrame) -> DataFrame:
    """The union of the sets that bitmaps stand for."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))


def not_in(ids: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """``id`` of those that are in no bitmap; ``n`` bounds the ids."""
    near = F.broadcast(sets) if n // 8 <= BROADCAST_BITMAPS else sets
    at = F.bitmap_bit_position("id")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    told = ids.withColumn("bitmap", F.bitmap_bucket_number("id")).join(near, "bitmap", "left")
    return told.where(~F.coalesce(known, F.lit(False))).select("id")


def _bfs_bitmaps(graph: Graph, source: int, max_levels: int | None) -> tuple[DataFrame, RunInfo]:
    """Levels in tables ``level=0``, ``level=1`` ... of one folder."""
    info = RunInfo()
    spark, count = graph.spark, {"changed": F.count(F.lit(1))}
    folder = f"{shared_dir(spark)}/bfs-{uuid.uuid4().hex}"
    frontier, seen = cut(_source(graph, source, F.lit(0)).select("id"), path=f"{folder}/level=0", **count)
    known = cut(bitmaps(frontier), "visited")
    level = 0
    while seen["changed"]:
        if max_levels is not None and level >= max_levels:
            break
        level += 1
        reached = graph.layout.along(frontier, "src").select(F.col("dst").alias("id")).distinct()
        frontier, seen = cut(not_in(reached, known, graph.n), path=f"{folder}/level={level}", **count)
        info.metrics.append(seen)
        if seen["changed"]:
            new = cut(merged(known, bitmaps(frontier)), "visited")
            drop(known)
            known = new
    drop(known)
    info.converged = True
    info.iterations = sum(1 for m in info.metrics if m["changed"])
    found = spark.read.schema("id long, level int").parquet(folder)
    found._fjord_path = folder
    return found.select("id", "level"), info


def sssp(graph: Graph, source: int, max_iter: int | None = 500, all_vertices: bool = True) -> tuple[DataFrame, RunInfo]:
    """``id, distance`` from ``source`` by synchronous relaxation; null where
    unreachable. ``iterations`` counts the last round, which changes nothing.
    ``metrics`` has the number of vertices improved per round.
    """
    weight = F.col("weight") if "weight" in graph.edges.columns else F.lit(1.0)

    def send(changed: DataFrame) -> DataFrame:
        return graph.layout.along(changed, "src").select(F.col("dst").alias("id"), (F.col("value") + weight).alias("value"))

    found, info = least_values(_source(graph, source, F.lit(0.0)), send, max_iter, "sssp", graph.layout)
    graph.release()
    distances = found.select("id", F.col("value").alias("distance"))
    return (graph.vertices.join(distances, "id", "left") if all_vertices else distances), info


def reach_summary(result: DataFrame, value: str) -> DataFrame:
    """``reachable`` and the greatest finite value (0 if there is none)."""
    return result.agg(F.count(value).alias("reachable"), F.coalesce(F.max(value), F.lit(0)).alias(f"max_{value}"))
