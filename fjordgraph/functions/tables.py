"""Preparation of ratings and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import global_rank, quantiles
from ..sources.archives import read_zip_lines


def read_ratings(spark: SparkSession, path: str, share: float = 1.0, seed: int = 42) -> DataFrame:
    """``user, item, rating`` from a CSV with a header ``userId,movieId,rating,...``.

    A path that ends in ``.zip`` is an archive (or several, by a pattern) whose members
    ``ratings.csv`` are read. ``share`` below 1 keeps all ratings of that share of the
    users, told by a hash of the user.
    """
    if path.endswith(".zip"):
        p = read_zip_lines(spark, path, r"(?:.*/)?ratings\.csv").where("line_no > 0").select(F.split("value", ",").alias("p"))
        raw = p.select(*[F.get("p", F.lit(i)).try_cast(kind).alias(c) for i, (c, kind) in enumerate((("user", "long"), ("item", "long"), ("rating", "float")))])
    else:
        raw = spark.read.schema("user LONG, item LONG, rating FLOAT, ts LONG").option("header", True).csv(path)
    rows = raw.select("user", "item", "rating").where("user is not null and item is not null and rating is not null")
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64("user", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def dense_ids(rows: DataFrame, *columns: str) -> DataFrame:
    """Replace each column's values by their rank, 0, 1, 2, ...; nulls stay null."""
    out = rows
    for c in columns:
        ranks = global_rank(rows.where(F.col(c).isNotNull()).select(c).distinct(), c, "__dense")
        out = out.join(ranks, c, "left").drop(c).withColumnRenamed("__dense", c)
    return out.select(*rows.columns)


def read_features(spark: SparkSession, path: str, width: int = 28) -> DataFrame:
    """``label, f0 ..``: rows with too few or malformed fields are skipped."""
    p = spark.read.text(path).select(F.split("value", ",").alias("p"))
    cols = [F.get("p", F.lit(i + 1)).try_cast("float").alias(f"f{i}") for i in range(width)]
    rows = p.where(F.size("p") > width).select(F.get("p", F.lit(0)).try_cast("double").cast("tinyint").alias("label"), *cols)
    return rows.dropna()


def bin_edges(rows: DataFrame, column: str, bins: int = 255) -> DataFrame:
    """One row ``edges``: distinct inner quantiles, padded with infinity to ``bins``."""
    found = quantiles(rows, column, [i / (bins + 1) for i in range(1, bins + 1)])
    q = F.array_distinct(F.coalesce("q", F.array().cast("array<double>")))
    return found.select(F.concat(q, F.array_repeat(F.lit(float("inf")), F.lit(bins) - F.size(q))).alias("edges"))


def digitize(value: Column, edges: Column) -> Column:
    """How many edges are at most ``value``."""
    return F.size(F.filter(edges, lambda e: e <= value))


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def row_pointers(rows: DataFrame, row: str, n: int) -> DataFrame:
    """``id, start, end`` of each row of a sparse matrix in coordinate form."""
    from ..operators.graph import Graph, csr_offsets

    g = Graph(rows.select(F.col(row).cast("long").alias("src"), F.lit(0).cast("long").alias("dst")), n)
    return csr_offsets(g)
