"""Ranks, prefix sums and quantiles of whole tables, without a one-task window.

Rows are dealt into ranges by bounds that Spark samples, so ranges have about
equal numbers of rows whatever the values or their type; sums are formed within
ranges, and only one number per range, of which there are as many as shuffle
partitions, is summed up ahead.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def running_total(rows: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all rows up to this one.

    ``order`` must be unique: equal rows would share a range however many.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__range").agg(F.sum(amount).alias("__n"))
    ahead = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("__range", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    own = F.sum(amount).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn(name, own).join(F.broadcast(offsets), "__range")
    return out.withColumn(name, F.col(name) + F.col("__ahead")).drop("__range", "__ahead")


def global_rank(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the zero-based rank by a unique column of any ordered type."""
    counted = running_total(rows.withColumn("__one", F.lit(1).cast("long")), [order], "__one", name)
    return counted.withColumn(name, F.col(name) - 1).drop("__one")


def counted_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, c, first, n``: the distinct values of each key, how often
    they occur, the zero-based place of the first among the key's sorted values,
    and the number of those. Nulls are left out."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    c = cut(running_total(c, [*keys, value], "c", "upto"), "counted")
    if not keys:
        return c.crossJoin(F.broadcast(c.agg(F.sum("c").alias("n")))).withColumn("first", F.col("upto") - F.col("c")).drop("upto")
    whole = c.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("start"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = c.join(whole, same).withColumn("first", F.col("upto") - F.col("c") - F.col("start"))
    return out.select(*keys, value, "c", "first", "n")


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row ``q``: exact quantiles, interpolated, in the order of ``shares``.

    Null where there are no values.
    """
    found = counted_values(rows, [], value)
    n = found.agg(F.max("n")).first()[0] or 0
    at = [(n - 1) * s for s in shares] if n else []
    places = sorted({p for x in at for p in (math.floor(x), math.ceil(x))})
    held = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("c")))
    values = {r.place: float(r.v) for r in found.select(F.explode(held).alias("place"), F.col(value).alias("v")).collect()} if n else {}
    mixed = [values[math.floor(x)] + (values[math.ceil(x)] - values[math.floor(x)]) * (x - math.floor(x)) for x in at]
    q = F.array(*[F.lit(x) for x in mixed]) if n else F.lit(None)
    return rows.sparkSession.range(1).select(q.cast("array<double>").alias("q"))
