"""Edges stored by one of their ends, and states stored beside them.

Edges are written once, bucketed by the end that a loop joins on, and so is the state,
by its id and into as many buckets. A superstep then reads both where they lie: only
messages are shuffled, after they were combined, and the new state falls into the
buckets of the old one. The tables outlive a loop, so that a second one over the same
graph starts with them, and they survive lost executors.

As the buckets of a table cannot be split at run time, edges of hubs are kept apart.
A hub has more edges than ``HUB_SHARE`` of a mean bucket, and ``HUB_EDGES`` at least, so
there are at most a few per bucket, and their rows of the state are broadcast to their
edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop

HUB_SHARE, HUB_EDGES = 1 / 4, 20_000
#: A bucket has about so many edges at most; there are no fewer buckets than
#: ``spark.sql.shuffle.partitions``, or Spark would shuffle both sides of a join anew.
BUCKET_EDGES = 2_000_000


class Layout:
    """The stored edges of one graph; columns beyond both ends stay with them.

    A ``small`` graph is one table, to which states are broadcast.
    """

    def __init__(self, edges: DataFrame, ends: tuple[str, str] = ("src", "dst"), small: bool = False):
        self.edges, self.ends, self.small = edges.coalesce(1) if small else edges, ends, small
        self._written: DataFrame | None = None
        self._count = self.parts = 0
        self._by: dict[str, tuple[DataFrame, DataFrame | None, DataFrame | None]] = {}

    def written(self) -> DataFrame:
        """All edges, stored as they come."""
        if self._written is None:
            self._written, seen = cut(self.edges, "edges", n=F.count(F.lit(1)))
            self._count = seen["n"]
            least = int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            self.parts = 1 if self.small else max(least, -(-self._count // BUCKET_EDGES))
        return self._written

    def by(self, key: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Edges bucketed by ``key`` but for those of hubs; the hubs and their edges, if
        there are any."""
        if key not in self._by:
            edges, hubs, far = self.written(), None, None
            if self._count > HUB_EDGES:
                share = max(self._count / self.parts * HUB_SHARE, HUB_EDGES)
                many = edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(share))
                hubs, seen = cut(many.select(key), "hubs", n=F.count(F.lit(1)))
                if seen["n"]:
                    far = cut(edges.join(F.broadcast(hubs), key), "hub-edges")
                    edges = edges.join(F.broadcast(hubs), key, "left_anti")
                else:
                    drop(hubs)
                    hubs = None
            near = cut(edges.select(*self.edges.columns).repartition(self.parts, key), "edges", buckets=(self.parts, key))
            self._by[key] = near, hubs, far
        return self._by[key]

    def store(self, state: DataFrame, name: str, **metrics):
        """A state with a unique ``id``, written beside the edges."""
        self.written()
        return cut(state, name, buckets=(self.parts, "id"), **metrics)

    def begin(self, state: DataFrame, name: str, **metrics):
        """:meth:`store` for a state that does not lie by its id yet."""
        self.written()
        return self.store(state.repartition(self.parts, "id"), name, **metrics)

    def along(self, state: DataFrame, key: str) -> DataFrame:
        """Edges with the columns of ``state`` (``id, ...``) at their ``key`` end.

        ``state`` is stored, or made from one that is by filters and new columns; its
        bucket is hashed in memory and the edges stream past it, unsorted.
        """
        rows = state.withColumnRenamed("id", key)
        if self.small:
            return self.written().join(F.broadcast(rows), key)
        near, hubs, far = self.by(key)
        out = near.join(rows.hint("shuffle_hash"), key)
        if hubs is None:
            return out
        few = rows.join(F.broadcast(hubs), key, "left_semi")
        return out.unionByName(far.join(F.broadcast(few), key))

    def release(self) -> None:
        """Deletes the stored edges."""
        for tables in self._by.values():
            drop(*tables)
        drop(self._written)
        self._written = None
        self._by.clear()
