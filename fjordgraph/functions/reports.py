"""Distributions and digests of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import dense_labels
from ..operators.ranks import global_rank
from ..storage import cut

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def distribution(result: DataFrame, value: str, limit: int | None = 20) -> DataFrame:
    """``value, count`` in order of the value, nulls left out; the first ``limit``."""
    rows = result.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("count")).orderBy(value)
    return rows.limit(limit) if limit is not None else rows


def first_rows(result: DataFrame, limit: int = 20) -> DataFrame:
    return result.orderBy("id").limit(limit)


def histogram(result: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """``bucket, count`` of equal buckets over [0, greatest]; the last is closed.

    Null values are in bucket -1. Empty buckets have no row.
    """
    top = result.agg(F.coalesce(F.max(value), F.lit(0.0)).alias("top"))
    width = F.when(F.col("top") > 0, F.col("top") / buckets).otherwise(1.0)
    at = F.least(F.floor(F.col(value) / width), F.lit(buckets - 1)).cast("int")
    return result.crossJoin(F.broadcast(top)).select(F.coalesce(at, F.lit(-1)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))


def serial_digest(labels: DataFrame, label: str = "label") -> str:
    """FNV-1a style digest of labels in id order, numbered by first occurrence.

    It is serial; labels are streamed to the driver one partition at a time and never
    held together. For small graphs; :func:`partition_digest` is for others.
    """
    h = FNV_OFFSET
    rows = dense_labels(labels.select("id", F.col(label).alias("label"))).orderBy("id")
    for r in rows.toLocalIterator():
        h = ((h ^ r.label) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


#: Modulus and multipliers of the digest; products of two residues fit 63 bits.
DIGEST_MODULUS, DIGEST_FACTORS = (1 << 31) - 1, (48271, 69621)


def _power(base: int, k: Column) -> Column:
    """``base ** k`` modulo the digest's, from the bits of ``k`` below 2 ** 40."""
    out, square = F.lit(1).cast("long"), base
    for bit in range(40):
        out = out * F.when(F.shiftright(k, bit).bitwiseAND(F.lit(1)) == 1, F.lit(square)).otherwise(F.lit(1)) % DIGEST_MODULUS
        square = square * square % DIGEST_MODULUS
    return out


def partition_digest(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row ``digest``: equal for equal partitions of the same ids, whatever their
    labels, and else different but for a chance of about 2 ** -60 per pair.

    Labels are numbered by first occurrence and read as the coefficients of a
    polynomial over a prime field, in the order of ids, at two places. It is a sum, so
    tasks add up their parts: ids get their place from a global rank over ranges, and
    one row per task remains. The digest ends with the number of ids.
    """
    dense = dense_labels(labels.select("id", F.col(label).alias("label")))
    placed = global_rank(cut(dense, "dense"), "id", "place")
    n = F.count(F.lit(1))
    sums = [F.sum(((F.col("label") + 1) % DIGEST_MODULUS * _power(f, F.col("place")) % DIGEST_MODULUS).cast("decimal(38,0)")).alias(f"h{i}") for i, f in enumerate(DIGEST_FACTORS)]
    told = placed.agg(*sums, n.alias("n")).select(*[F.coalesce(F.col(f"h{i}") % DIGEST_MODULUS, F.lit(0)).cast("long").alias(f"h{i}") for i in range(2)], "n")
    return told.select(F.concat(*[F.lpad(F.lower(F.hex(c)), w, "0") for c, w in (("h0", 8), ("h1", 8), ("n", 12))]).alias("digest"))


def component_count(labels: DataFrame, label: str = "component") -> DataFrame:
    return labels.agg(F.count_distinct(label).alias("components"))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown; a last line tells if there are more than ``limit`` rows."""
    head = " | ".join(rows.columns)
    lines = [f"| {head} |", "|" + "---|" * len(rows.columns)]
    found = rows.limit(limit + 1).collect()
    for r in found[:limit]:
        lines.append("| " + " | ".join("-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |")
    if len(found) > limit:
        lines.append("| " + " | ".join(["..."] * len(rows.columns)) + " |")
    return "\n".join(lines) + "\n"
