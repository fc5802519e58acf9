"""Graph generators.

Relational, with randomness from an arithmetic hash of ids and a seed, so any
partitioning gives the same graph. The weights of one sequential stream and the
reproducible fixture are lists, for tests.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import formula_weight
from ..operators.ranks import running_total
from ..storage import cut

MASK = (1 << 64) - 1
#: Modulus of the hash; products of two residues fit 64 bits. Multipliers of two
#: public linear generators for it.
P, A, B = (1 << 31) - 1, 48271, 16807


def uniform(seed: int, *keys: Column | str) -> Column:
    """Number in (0, 1) fixed by the integer keys and the seed."""
    h = F.lit(seed % P).cast("long")
    for k in keys:
        h = (h * A + F.pmod(F.col(k) if isinstance(k, str) else k, F.lit(P)) + 1) % P
        h = (h * h + h * B + 11) % P
    return ((h * A + 7) % P + 0.5) / F.lit(float(P))


def uniform_sql(seed: int, *keys: str) -> str:
    """The same number in SQL, for keys that are not negative."""
    h = f"{seed % P}::bigint"
    for k in keys:
        h = f"(({h} * {A} + {k} % {P} + 1) % {P})"
        h = f"(({h} * {h} + {h} * {B} + 11) % {P})"
    return f"((({h} * {A} + 7) % {P} + 0.5::double) / {P}.0::double)"


def _reached(n: int) -> None:
    if n > P:
        raise ValueError(f"at most {P} vertices can be drawn")


def random_digraph(spark: SparkSession, n: int, k: int, seed: int = 42, weight: tuple[float, float] | None = None) -> DataFrame:
    """``k`` draws per vertex without self-loops; draws may repeat. The hash reaches
    ``P`` vertices; more are an error."""
    _reached(n)
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    step = 1 + F.floor(uniform(seed, "src", "slot") * (n - 1))
    out = rows.select("src", ((F.col("src") + step) % n).cast("long").alias("dst"), "slot")
    if weight is None:
        return out.select("src", "dst")
    lo, hi = weight
    return out.select("src", "dst", (lo + (hi - lo) * uniform(seed + 1, "src", "slot")).alias("weight"))


def _prime(least: int) -> int:
    return next(p for p in range(max(least, 2), 4 * max(least, 2)) if all(p % d for d in range(2, math.isqrt(p) + 1)))


def distinct_digraph(spark: SparkSession, n: int, k: int, seed: int = 42) -> DataFrame:
    """``k`` different out-neighbours per vertex, or all others if they are fewer.

    Each vertex walks the other ids by steps of its own modulo a prime, which
    meet none twice, and keeps the first ``k`` that are ids. The hash reaches ``P``
    vertices; more are an error.
    """
    _reached(n)
    if n < 2:
        return spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    q, take = _prime(n - 1), min(k, n - 1)
    a = 1 + F.floor(uniform(seed, "id") * (q - 1)).cast("long")
    b = F.floor(uniform(seed + 1, "id") * q).cast("long")
    walk = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(min(q - 1, take + q - n + 1)).cast("long")), lambda j: (a * j + b) % q)
    ends = F.slice(F.filter(walk, lambda x: x < n - 1), 1, take)
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(ends).alias("x"))
    return rows.select("src", ((F.col("src") + 1 + F.col("x")) % n).alias("dst"))


def xorshift_weights(edges: list[tuple[int, int]], seed: int, most: float) -> list[tuple[int, int, float]]:
    """Weights in [0.1, ``most``] from a 64-bit xorshift stream."""
    x = seed or 1
    out = []
    for u, v in edges:
        x ^= (x << 13) & MASK
        x ^= x >> 7
        x ^= (x << 17) & MASK
        out.append((u, v, 0.1 + (most - 0.1) * (x / 2.0**64)))
    return out


def seeded_ring(spark: SparkSession, n: int, k: int, groups: int = 4, share: int = 10) -> tuple[DataFrame, DataFrame]:
    """Each vertex to its next ``k``; every ``share``-th vertex is a seed whose
    label is a hundred times its group, groups being equal arcs."""
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"))
    edges = edges.select("src", ((F.col("src") + F.col("j")) % n).alias("dst"))
    size = max(1, n // groups)
    label = F.least(F.floor(F.col("id") / size), F.lit(groups - 1)) * 100
    return edges, spark.range(n).where(F.col("id") % share == 0).select("id", label.cast("long").alias("label"))


def ring(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))


def path(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def two_paths(spark: SparkSession, n: int) -> DataFrame:
    """Two paths of half the ids each, unconnected."""
    return path(spark, n).where(F.col("dst") != n // 2)


def loops_and_repeats(spark: SparkSession, n: int) -> DataFrame:
    """A self-loop at every id, a path twice, and twice an edge 0 to n // 2."""
    ids = spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    far = spark.range(2).select(F.lit(0).cast("long").alias("src"), F.lit(n // 2).cast("long").alias("dst"))
    return ids.unionAll(path(spark, n)).unionAll(path(spark, n)).unionAll(far)


def star(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))


def grid(spark: SparkSession, n: int) -> DataFrame:
    """Right and down neighbours on a square grid of ``ceil(sqrt(n))`` columns."""
    side = int(n**0.5)
    side += side * side < n
    ids = spark.range(n)
    right = ids.where((F.col("id") % side < side - 1) & (F.col("id") + 1 < n)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = ids.where(F.col("id") + side < n).select(F.col("id").alias("src"), (F.col("id") + side).alias("dst"))
    return right.unionByName(down)


def complete(spark: SparkSession, n: int) -> DataFrame:
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst"))
    return rows.where("src <> dst")


def layered(spark: SparkSession, layers: int, width: int) -> DataFrame:
    """Complete bipartite steps from each layer to the next."""
    rows = spark.range((layers - 1) * width).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    return rows.select("src", ((F.floor(F.col("src") / width) + 1) * width + F.col("j")).cast("long").alias("dst"))


def _drawn(rows: DataFrame, candidates: Column, p: float, seed: int) -> DataFrame:
    """``rows`` (``id, ...``) with ``at``, the numbers from 1 to ``candidates`` that
    each draws with probability ``p``.

    Gaps between drawn numbers are drawn instead of the numbers tested, so the
    work follows the output. Ten deviations more gaps than the mean are drawn.
    """
    rows = rows.withColumn("m", candidates.cast("long"))
    if p <= 0:
        return rows.withColumn("at", F.lit(0).cast("long")).where("false").drop("m")
    draws = F.ceil(F.col("m") * p + 10 * F.sqrt(F.col("m") * p) + 10).cast("long")
    tried = rows.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), draws)))
    gap = F.floor(F.log(uniform(seed, "id", "j")) / F.log(1 - F.lit(p))).cast("long") + 1 if p < 1 else F.lit(1).cast("long")
    at = F.sum(gap).over(Window.partitionBy("id").orderBy("j"))
    return tried.withColumn("at", at).where(F.col("at") <= F.col("m")).drop("m", "j")


def erdos_renyi(spark: SparkSession, n: int, p: float = 0.3, seed: int = 42) -> DataFrame:
    """Each pair ``src < dst`` with probability ``p``; one row per kept pair."""
    kept = _drawn(spark.range(max(0, n - 1)), F.lit(n - 1) - F.col("id"), p, seed)
    return kept.select(F.col("id").alias("src"), (F.col("id") + F.col("at")).alias("dst"))


def planted_communities(spark: SparkSession, n: int, groups: int, inside: float = 0.7, across: float = 0.05, seed: int = 42) -> DataFrame:
    """As :func:`erdos_renyi`, likelier within a group of ``n // groups`` ids."""
    size = max(1, n // groups)
    group = F.least(F.floor(F.col("id") / size), F.lit(groups - 1)).cast("long")
    last = F.when(group == groups - 1, F.lit(n - 1)).otherwise(group * size + size - 1).cast("long")
    rows = spark.range(max(0, n - 1)).withColumn("last", last)
    near = _drawn(rows, F.col("last") - F.col("id"), inside, seed).select(F.col("id").alias("src"), (F.col("id") + F.col("at")).alias("dst"))
    far = _drawn(rows, F.lit(n - 1) - F.col("last"), across, seed + 1).select(F.col("id").alias("src"), (F.col("last") + F.col("at")).alias("dst"))
    return near.unionAll(far)


def small_world(spark: SparkSession, n: int, k: int = 4, p: float = 0.3, seed: int = 42) -> DataFrame:
    """Watts-Strogatz: a ring lattice with ``k // 2`` edges ahead per vertex, each
    rewired with probability ``p`` to a random vertex outside the lattice's reach.

    Rewired edges that would repeat another stay as they were, all but one.
    """
    half = k // 2
    lattice = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(half).cast("long"))).alias("j"))
    free = n - 1 - 2 * half
    home = (F.col("u") + F.col("j")) % n
    jump = half + 1 + F.floor(uniform(seed, "u", "j") * max(free, 0)).cast("long")
    moves = (uniform(seed + 1, "u", "j") < p) & F.lit(free > 0)
    ends = lattice.withColumns({"home": home, "v": F.when(moves, (F.col("u") + jump) % n).otherwise(home)})
    pair = [F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")]
    first = F.row_number().over(Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("u", "j"))
    kept = ends.withColumn("v", F.when(first == 1, F.col("v")).otherwise(F.col("home")))
    return kept.select(*pair)


def balanced_seeds(vertices: DataFrame, labels: int, share: float, seed: int = 42) -> DataFrame:
    """A random ``share`` of the vertices, dealt evenly over the labels; the last
    label takes what is left over. One row per seed; ranks run over sampled ranges, so
    no task orders them all."""
    from ..operators.ranks import global_rank

    n = vertices.count()
    take = int(n * share)
    each = max(1, take // labels)
    ranked = global_rank(vertices.select("id", F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1)).alias("h")), "h", "r")
    return ranked.where(F.col("r") < take).select("id", F.least(F.floor(F.col("r") / each), F.lit(labels - 1)).cast("long").alias("label"))


def er_fixture(n: int, p: float, seed: int) -> list[tuple[int, int]]:
    """Directed pairs in row-major order from Python's generator; reproducible."""
    rng = random.Random(seed)
    return [(u, v) for u in range(n) for v in range(n) if u != v and rng.random() < p]


def with_formula_weight(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", formula_weight())


def ratings(spark: SparkSession, users: int, items: int, mean: float, seed: int = 42) -> DataFrame:
    """``user, item, rating``: a Poisson number of distinct items per user.

    The Poisson draw inverts its distribution function term by term.
    """
    top = int(mean + 12 * math.sqrt(mean) + 12)
    term, cdf, acc = math.exp(-mean), [], 0.0
    for k in range(top):
        acc += term
        cdf.append(acc)
        term *= mean / (k + 1)
    u = uniform(seed, "user")
    count = F.size(F.filter(F.array(*[F.lit(c) for c in cdf]), lambda c: c < u))
    rows = spark.range(users).select(F.col("id").cast("int").alias("user")).withColumn("n", F.least(count, F.lit(items)))
    rows = rows.where("n > 0").select("user", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j"))
    # an affine walk over the items, different for each user, never repeats one
    prime = _prime(items)
    a = 1 + F.pmod(F.xxhash64("user", F.lit(seed + 1)), F.lit(prime - 1))
    b = F.pmod(F.xxhash64("user", F.lit(seed + 2)), F.lit(prime))
    item = ((a * F.col("j") + b) % prime).cast("int")
    stars = (1 + F.floor(uniform(seed + 3, "user", "j") * 9) / 2).cast("float")
    return rows.select("user", item.alias("item"), stars.alias("rating")).where(F.col("item") < items)


def shuffled_subset(rows: DataFrame, keys: list[str], limit: int, seed: int = 42) -> DataFrame:
    """``limit`` rows chosen and ordered by a hash of ``keys``, which are integers and
    unique; ``place`` is their order, from 0. The same for a seed.

    Places are ranks over sampled ranges, so no task orders more than its range.
    """
    hashed = rows.withColumns({"__h": uniform(seed, *keys), "__one": F.lit(1).cast("long")})
    ranked = running_total(cut(hashed, "shuffled"), ["__h", *keys], "__one", "place")
    return ranked.where(F.col("place") <= limit).withColumn("place", F.col("place") - 1).drop("__h", "__one")
