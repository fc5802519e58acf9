"""Embedding near-duplicates by random-hyperplane sign hashing.

Vectors of one label meet in the buckets of several tables of sign bits. The
number of tables follows from the number of bits so that a pair right at the
threshold is missed with probability ``MISS`` at most; the number of bits follows
from the number of vectors, so that buckets keep their size as the input grows.
A bucket is split into blocks of at most about ``BLOCK`` rows that meet pairwise,
so no task holds more than two.

In the buckets only the bits meet at first: all tables' bits together tell the
angle of two vectors well enough to leave out pairs that are ``SIGMAS`` deviations
off (below 1e-9 for a pair at the threshold). Rows that have a pair left, which
did not meet in an earlier table, then meet again with their vectors, and are
compared exactly, by cosine in double precision. Tasks return counts and one link
to a class representative per vector, never pairs.

Equal vectors (by label and a 128-bit digest) are one row with a count before
anything else.

Vectors that are null, zero, or have null or non-finite components, and those
without a label, link with nothing; vectors of different length never link. A
null vec_id is a vector like others. Repeated rows are vectors of their own. An
empty table gives an empty result. Columns other than the id, the vector and the
label are not used and may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import cut, drop

THRESHOLD, MISS = 0.98, 1e-5
BUCKET, BLOCK = 128, 256
MOST_BITS, SIGMAS = 60, 6.5
SEED = 20_260_101


def plan_tables(typical: float, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``typical`` vectors that share a label."""
    bits = max(2, min(MOST_BITS, round(math.log2(max(typical, 1) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length of a list column."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signatures(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """``rep, sig, buckets``: all sign bits packed, and the bucket of each table."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.zeros((batch.num_rows, bits * tables), bool)
            for rows, x in _vectors(batch.column(1)):
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, bits * tables))
                signs[rows] = _unit(x) @ planes[d] >= 0
            out = _buckets(signs, bits)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            packed = pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, flat], names=["rep", "sig", "buckets"])

    return reps.select("rep", "embedding").mapInArrow(run, "rep long, sig binary, buckets array<long>")


def _buckets(signs: np.ndarray, bits: int) -> np.ndarray:
    return signs.reshape(len(signs), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _met(group: pa.Table, bits: int, tables: int) -> tuple[np.ndarray, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a group in order of ``rep``: their ids, the rows, signs and buckets
    of all tables, and which pairs may be compared here."""
    ids = group.column("rep").to_numpy()
    order = np.argsort(ids, kind="stable")
    group = group.take(pa.array(order))
    raw = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
    signs = np.unpackbits(raw, axis=1, count=bits * tables).astype(bool)
    pairs = np.triu(np.ones((len(ids), len(ids)), bool), 1)
    if group.column("i")[0].as_py() != group.column("j")[0].as_py():
        side = group.column("block").to_numpy()
        pairs &= side[:, None] != side[None, :]
    return ids[order], group, signs, _buckets(signs, bits), pairs


def _fresh(buckets: np.ndarray, p: np.ndarray, q: np.ndarray, table: int) -> np.ndarray:
    """Of pairs, those that share no bucket in an earlier table."""
    out = np.ones(len(p), bool)
    step = 500_000
    for k in range(0, len(p) if table else 0, step):
        a, b = p[k : k + step], q[k : k + step]
        out[k : k + step] = ~(buckets[a, :table] == buckets[b, :table]).any(axis=1)
    return out


def _promise(threshold: float, bits: int, tables: int):
    """Rows of a block pair that have a fresh pair of signatures close enough."""
    n, share = bits * tables, math.acos(threshold) / math.pi
    most = n * share + SIGMAS * math.sqrt(n * share * (1 - share)) + 1

    def run(group: pa.Table) -> pa.Table:
        _, group, signs, buckets, pairs = _met(group, bits, tables)
        x = signs.astype(np.float32) * 2 - 1
        p, q = np.nonzero(pairs & ((n - x @ x.T) / 2 <= most))
        ok = _fresh(buckets, p, q, group.column("tbl")[0].as_py())
        keep = np.zeros(len(x), bool)
        keep[p[ok]] = keep[q[ok]] = True
        return group.filter(pa.array(keep)).select(SEAT)

    return run


def _compare(threshold: float, bits: int, tables: int):
    def run(group: pa.Table) -> pa.Table:
        ids, group, _, buckets, pairs = _met(group, bits, tables)
        copies = group.column("copies").to_numpy()
        (_, x), *more = list(_vectors(group.column("embedding").combine_chunks()))
        if more:
            raise ValueError("vectors of one bucket differ in length")
        x = _unit(x)
        near = pairs & (x @ x.T >= threshold)
        links = np.zeros(len(ids), np.int64)
        p, q = np.nonzero(near)
        ok = _fresh(buckets, p, q, group.column("tbl")[0].as_py())
        np.add.at(links, p[ok], copies[q[ok]])
        np.add.at(links, q[ok], copies[p[ok]])
        near |= near.T
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root, np.where(near, root[None, :], len(ids)).min(axis=1, initial=len(ids)))
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = near.any(axis=1)
        return pa.table({"rep": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


#: A row's place: vector, table, bucket, its block, and the pair of blocks that meet.
SEAT = ["rep", "label", "dim", "tbl", "bucket", "block", "i", "j", "sig"]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for ``vec_id, embedding, label``."""
    e = F.col("embedding")
    kept = e if dict(vectors.dtypes)["embedding"] == "array<float>" else e.cast("array<double>")
    rows = vectors.select("vec_id", kept.alias("embedding"), "label").withColumn("row", F.monotonically_increasing_id())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("label").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    digest = {"good": good, "d1": F.xxhash64(F.lit(1), "embedding"), "d2": F.xxhash64(F.lit(2), "embedding")}
    rows = cut(rows.withColumns(digest), "emb-rows")
    # equal vectors: one representative, the first row
    own = ["label", "d1", "d2"]
    reps = rows.where("good").groupBy(*own).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    reps = cut(reps.withColumn("dim", F.size("embedding")), "emb-reps")
    sizes = reps.groupBy("label", "dim").count().agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s"), F.sum("count").alias("n")).first()
    bits, tables = plan_tables(sizes.s / sizes.n if sizes.n else 1, threshold, miss)
    signed = cut(reps.select("rep", "label", "dim").join(signatures(reps, bits, tables), "rep"), "emb-signed")
    seats = signed.select("rep", "label", "dim", "sig", F.posexplode("buckets").alias("tbl", "bucket"))
    key = ["label", "dim", "tbl", "bucket"]
    crowds = cut(seats.groupBy(*key).count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"), "emb-crowds")
    met = seats.join(crowds, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = met.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(SEAT)
    seat = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
    asked = cut(pairs.groupBy(*key, "i", "j").applyInArrow(_promise(threshold, bits, tables), seat), "emb-asked")
    full = asked.join(reps.select("rep", "copies", "embedding"), "rep")
    found = cut(full.groupBy(*key, "i", "j").applyInArrow(_compare(threshold, bits, tables), "rep long, links long, root long"), "emb-found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("rep <> root").select("rep", "root").distinct(), "rep", "root")
    named = reps.select("rep", *own, "copies", "least").join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = cut(named.select(*own, "component", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "emb-classes")
    names = cut(classes.groupBy("component").agg(F.min("least").alias("component_id")), "emb-names")
    told = cut(classes.join(names, "component").select(*own, "n_links", "component_id"), "emb-told")
    drop(reps, signed, crowds, asked, found, comp, classes, names)
    linked = rows.where("good").select("vec_id", *own).join(told, own).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
