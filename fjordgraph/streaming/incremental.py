"""Levels, distances and components of a graph whose edges arrive in batches.

Minima only fall as edges are added, so a batch starts from what was known before: its
own edges give the first candidates, and these spread along all edges so far until
nothing improves. What does not change is neither sent nor recomputed.

The state lives in one folder. Edges of batch ``k`` are a table of their own, and so is
version ``k`` of the values, with all values at that time. A version is made from the one
before it and the edges up to its batch, and its folder appears under its final name only
when it is whole: a batch that is given again after a failure or a restart is computed
again from the same inputs, and one that is whole already is left alone. So results do
not depend on how often batches were tried, nor on how edges were dealt over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, drop

#: What each kind sends along an edge from the value at its source, and its type.
KINDS = {
    "levels": ("int", lambda: F.col("value") + 1),
    "distances": ("double", lambda: F.col("value") + F.col("weight")),
    "components": ("long", lambda: F.col("value")),
}
EDGES = "src long, dst long, weight double"


class Incremental:
    """One kind of fixpoint over growing edges, kept in ``folder``.

    ``levels`` and ``distances`` start at ``source``; ``components`` are named by their
    least id, with edges taken as undirected, and cover the ends of all edges. Edges are
    ``src, dst[, weight]``; a missing weight is 1, null ends lead nowhere, and negative
    or non-finite weights are an error. ``update`` is a function for ``foreachBatch``;
    the last ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str, source: int | None = None, keep: int = 2):
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        if (source is None) != (kind == "components"):
            raise ValueError("levels and distances have a source, components have none")
        self.spark, self.folder, self.kind, self.source, self.keep = spark, folder.rstrip("/"), kind, source, keep
        self.type, self.step = KINDS[kind]

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, table: str) -> list[int]:
        p, fs = self._path(table)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))

    def versions(self) -> list[int]:
        """The versions of the values that are whole and kept."""
        return self._numbers("values")

    def _write(self, df: DataFrame, table: str, version: int) -> None:
        """Written aside and renamed when whole; what is there already stays."""
        final, fs = self._path(f"{table}/version={version}")
        if fs.exists(final):
            return
        aside, _ = self._path(f"_aside/{table}-{version}")
        df.write.mode("overwrite").parquet(aside.toString())
        fs.mkdirs(final.getParent())
        if not fs.rename(aside, final):
            raise OSError(f"could not put {table} {version} in its place")

    def _edges(self, *versions: int) -> DataFrame:
        return self.spark.read.schema(EDGES).parquet(*[f"{self.folder}/edges/version={k}" for k in versions])

    def result(self, version: int | None = None) -> DataFrame:
        """``id, value`` of that version, or the latest; empty before the first batch."""
        schema, known = f"id long, value {self.type}", self.versions()
        if not known:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/values/version={known[-1] if version is None else version}")

    def _cleaned(self, batch: DataFrame) -> DataFrame:
        w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in batch.columns else F.lit(1.0)
        bad = (w < 0) | F.isnan(w) | (w == float("inf"))
        checked = F.when(bad, F.raise_error(F.lit("edge weights must be finite and not negative"))).otherwise(w)
        rows = batch.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), checked.alias("weight"))
        if self.kind == "components":
            return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).distinct()
        return rows

    def _born(self, new: DataFrame) -> DataFrame:
        """Values that need no edge: the source's, and every vertex's own id."""
        if self.kind == "components":
            return new.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("value"))
        return self.spark.range(1).select(F.lit(self.source).cast("long").alias("id"), F.lit(0).cast(self.type).alias("value"))

    def _better(self, edges: DataFrame, values: DataFrame, state: DataFrame) -> tuple[DataFrame, dict]:
        """What edges lead to from ``values`` that is below what is known, written."""
        near = edges.join(values.withColumnRenamed("id", "src"), "src")
        found = near.select(F.col("dst").alias("id"), self.step().cast(self.type).alias("value")).groupBy("id").agg(F.min("value").alias("value"))
        better = found.join(state.withColumnRenamed("value", "was"), "id", "left").where("was is null or value < was")
        return cut(better.select("id", "value"), "incremental-sent", n=F.count(F.lit(1)))

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Takes up the edges of a batch. Batches come in the order of their numbers."""
        done = self.versions()
        if done and batch_id <= done[-1]:
            return
        self._write(self._cleaned(batch), "edges", batch_id)
        new, every = self._edges(batch_id), self._edges(*[k for k in self._numbers("edges") if k <= batch_id])
        old = self.result()
        born = cut(self._born(new).join(old.select("id"), "id", "left_anti"), "incremental-born")
        state = cut(old.unionByName(born), "incremental")
        # only what the new edges carry can improve anything at first
        fresh, seen = self._better(new, state, state)
        while seen["n"]:
            merged = cut(state.unionByName(fresh).groupBy("id").agg(F.min("value").alias("value")), "incremental")
            later, seen = self._better(every, fresh, merged)
            drop(state, fresh)
            state, fresh = merged, later
        self._write(state, "values", batch_id)
        drop(state, fresh, born)
        for k in self.versions()[: -self.keep]:
            p, fs = self._path(f"values/version={k}")
            fs.delete(p, True)
