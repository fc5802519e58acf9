"""Summaries of timed runs: statistics, comparisons, phases and traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import counted_values


def upper_median(values: Column) -> Column:
    """Element ``len / 2`` of the sorted values; null if there are none."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.when(F.size(v) > 0, F.get(v, F.floor(F.size(v) / 2).cast("int")))


def summarise(runs: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Per key: samples, mean, median, sample CV in percent, min, max and p95.

    Only positive values count. The p95 is the element at ``round(.95 n) - 1`` of
    the sorted values, halves rounded to even; the CV of one sample is 0.
    """
    good = runs.where(F.col(value) > 0)
    n = F.count(F.lit(1))
    cv = F.when(n >= 2, F.stddev_samp(value) / F.avg(value) * 100).otherwise(0.0)
    plain = good.groupBy(*keys).agg(n.alias("n_samples"), F.avg(value).alias("mean"), cv.alias("cv"), F.min(value).alias("min"), F.max(value).alias("max"))
    # places among the sorted values, told from counts of distinct ones
    at = lambda k: F.max(F.when((F.col("first") <= k) & (k < F.col("first") + F.col("c")), F.col(value)))
    half = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    p95 = at(F.greatest(F.lit(1), F.bround(F.col("n") * 0.95).cast("int")) - 1)
    places = counted_values(good, keys, value).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(half.alias("median"), p95.alias("p95"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return plain.join(places, same).select(*keys, "n_samples", "mean", "median", "cv", "min", "max", "p95")


def grouped_mean(runs: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Mean and population deviation of the runs that passed."""
    return runs.where("status = 'passed'").groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("runs"))


def best_config(summary: DataFrame, keys: list[str], label: str, value: str = "mean") -> DataFrame:
    """The label of the least value per key; of equal ones the first by name."""
    best = F.min(F.struct(value, label)).alias("b")
    return summary.groupBy(*keys).agg(best).select(*keys, F.col(f"b.{label}").alias(f"best_{label}"), F.col(f"b.{value}").alias(f"best_{value}"))


def speedup_over(summary: DataFrame, baseline: str, keys: list[str], label: str = "backend", value: str = "median") -> DataFrame:
    """The best label per key and how much faster it is than the baseline."""
    base = summary.where(F.col(label) == baseline).select(*keys, F.col(value).alias("base"))
    best = best_config(summary, keys, label, value)
    return best.join(base, keys, "left").withColumn("speedup", F.try_divide("base", f"best_{value}")).drop("base")


def crossover(summary: DataFrame, baseline: str, label: str = "backend", size: str = "nodes", value: str = "median") -> DataFrame:
    """Per other label: the least size at which it beats the baseline, else null."""
    base = summary.where(F.col(label) == baseline).select(size, F.col(value).alias("base"))
    others = summary.where(F.col(label) != baseline).join(base, size)
    return others.groupBy(label).agg(F.min(F.when(F.col(value) < F.col("base"), F.col(size))).alias("crossover"))


def cost_metric(vertical: DataFrame, distributed: DataFrame, keys: list[str], value: str = "median") -> DataFrame:
    """The fewest ``ranks`` that match the best vertical result, else null."""
    best = vertical.groupBy(*keys).agg(F.min(value).alias("best_vertical"))
    return distributed.join(best, keys).groupBy(*keys).agg(F.first("best_vertical").alias("best_vertical"), F.min(F.when(F.col(value) <= F.col("best_vertical"), F.col("ranks"))).alias("cost"))


def trace_events(workers: DataFrame) -> DataFrame:
    """``run, worker_id, key, ms`` of traces ``run, worker_id, timestamps``; what
    is not an integer is left out, the last of repeated keys counts."""
    flat = workers.select("run", "worker_id", F.posexplode("timestamps").alias("pos", "t"))
    flat = flat.select("run", "worker_id", "pos", F.col("t.key").alias("key"), F.trim("t.value").try_cast("long").alias("ms")).where("ms is not null")
    return flat.groupBy("run", "worker_id", "key").agg(F.max_by("ms", "pos").alias("ms"))


def iteration_windows(events: DataFrame) -> DataFrame:
    """``run, iteration, compute_ms, reduce_ms, broadcast_ms``, clamped at 0.

    A window runs from the earliest start of the iteration to the latest end of
    each phase; iterations count from 0 as far as they follow without a gap.
    """
    e = events.withColumn("iteration", F.regexp_extract("key", r"^iter_(\d+)_(start|compute|reduce|broadcast)$", 1).try_cast("int"))
    e = e.where("iteration is not null").withColumn("phase", F.regexp_extract("key", r"^iter_\d+_(\w+)$", 1))
    at = lambda p, f: f(F.when(F.col("phase") == p, F.col("ms"))).alias(p)
    w = e.groupBy("run", "iteration").agg(at("start", F.min), at("compute", F.max), at("reduce", F.max), at("broadcast", F.max)).where("start is not null")
    rank = F.row_number().over(Window.partitionBy("run").orderBy("iteration")) - 1
    w = w.withColumn("__rank", rank).where("__rank = iteration").drop("__rank")
    diff = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(F.lit(0).cast("long"), F.col(b) - F.col(a)))
    return w.select("run", "iteration", "start", diff("start", "compute").alias("compute_ms"), diff("compute", "reduce").alias("reduce_ms"), diff("reduce", "broadcast").alias("broadcast_ms"))


def phase_breakdown(events: DataFrame, submitted: DataFrame | None = None) -> DataFrame:
    """One row of phase times per run; ``submitted`` has ``run, submit_ms, finish_ms``."""
    when = lambda k, f: f(F.when(F.col("key") == k, F.col("ms")))
    ends = lambda *s: F.array_contains(F.array(*[F.col("key").endswith(x) for x in s]), True)
    base = events.groupBy("run").agg(
        F.count_distinct("worker_id").alias("workers"),
        when("worker_start", F.min).alias("s0"), when("worker_start", F.max).alias("s1"), when("worker_end", F.max).alias("e1"),
        when("get_input", F.min).alias("g0"), when("get_input_end", F.max).alias("g1"),
        F.min(F.when(ends("write_output_start", "write_labels_start"), F.col("ms"))).alias("w0"),
        F.max(F.when(ends("write_output_end", "write_labels_end"), F.col("ms"))).alias("w1"),
    )
    it = iteration_windows(events).groupBy("run").agg(
        F.count(F.lit(1)).alias("iterations"), F.min_by("start", "iteration").alias("i0"),
        *[F.coalesce(F.sum(f"{p}_ms"), F.lit(0)).alias(f"{p}_ms") for p in ("compute", "reduce", "broadcast")],
    )
    out = base.join(it, "run", "left")
    if submitted is not None:
        out = out.join(submitted, "run", "left")
    else:
        out = out.withColumns({"submit_ms": F.lit(None).cast("long"), "finish_ms": F.lit(None).cast("long")})
    span = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(F.lit(0).cast("long"), F.col(b) - F.col(a)))
    return out.select(
        "run", "workers", span("submit_ms", "s0").alias("cold_start_ms"), span("s0", "s1").alias("stagger_ms"),
        F.coalesce(span("g0", "g1"), span("s0", "g1")).alias("load_ms"), "compute_ms", "reduce_ms", "broadcast_ms",
        (F.col("reduce_ms") + F.col("broadcast_ms")).alias("communication_ms"), span("s0", "e1").alias("warm_total_ms"),
        span("submit_ms", "finish_ms").alias("host_total_ms"), F.coalesce(span("i0", "e1"), span("s0", "e1")).alias("span_ms"),
        span("w0", "w1").alias("write_ms"), F.coalesce("iterations", F.lit(0)).alias("iterations"),
    )


def spark_phases(runs: DataFrame) -> DataFrame:
    """Adds the phases of a Spark run from its load, compute, write and total times."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    warm = zero("load_ms") + F.col("compute_ms") + zero("write_ms")
    return runs.withColumns({"warm_total_ms": warm, "cold_start_ms": F.greatest(F.lit(0.0), F.col("total_ms") - warm), "span_ms": F.col("compute_ms")})


def traffic_bytes(algorithm: Column, nodes: Column, workers: Column, iterations: Column) -> Column:
    """``struct<reduce_bytes, broadcast_bytes, total_bytes>`` of a run's rounds.

    A message has a 4-byte slot per vertex and one counter. Label propagation
    also exchanges its labels once before, and its seeds, whose number is sent
    as 4 bytes. Null for other algorithms, 0 for one worker or no round.
    """
    others = workers.cast("long") - 1
    rounds = others * (nodes.cast("long") + 1) * 4 * iterations
    way = F.when(algorithm == "labelpropagation", rounds + others * 4 + others * nodes * 4).when(algorithm.isin("bfs", "sssp", "pagerank"), rounds)
    way = F.when((workers <= 1) | (iterations <= 0), F.lit(0).cast("long")).otherwise(way)
    return F.when(way.isNotNull(), F.struct(way.alias("reduce_bytes"), way.alias("broadcast_bytes"), (2 * way).alias("total_bytes")))


def speedups(runs: DataFrame) -> DataFrame:
    """Adds three ratios and the winner of the primary one.

    Columns ``base_exec_ms, base_total_ms, algo_ms, warm_ms, host_ms``; a zero or
    missing time gives no ratio. The primary metric is the total, else the warm
    one, else the span.
    """
    ratio = lambda a, b: F.when((F.col(a) != 0) & (F.col(b) != 0), F.col(a) / F.col(b))
    out = runs.withColumns({"algorithmic": ratio("base_exec_ms", "algo_ms"), "warm": ratio("base_total_ms", "warm_ms"), "cold": ratio("base_total_ms", "host_ms")})
    metric = F.when(F.col("cold").isNotNull(), "total").when(F.col("warm").isNotNull(), "warm").otherwise("span")
    value = F.coalesce("cold", "warm", "algorithmic")
    return out.withColumns({"primary_metric": metric, "winner": F.when(value > 1, "Burst").when(value.isNotNull(), "Standalone")})


def warm_pool(runs: DataFrame) -> DataFrame:
    """Adds ``cold_over_warm`` and ``warm_over_subtotal``; null for zero or missing."""
    ratio = lambda a, b: F.when((F.col(a) != 0) & (F.col(b) != 0), F.col(a) / F.col(b))
    return runs.withColumns({"cold_over_warm": ratio("cold_e2e_ms", "warm_e2e_median_ms"), "warm_over_subtotal": ratio("warm_e2e_median_ms", "warm_subtotal_median_ms")})


def probe_summary(rows: DataFrame) -> DataFrame:
    """Mean times per mode and granularity; rows without either are left out."""
    good = rows.where("mode is not null and granularity is not null")
    names = ("host_total_ms", "startup_median_ms", "stagger_ms")
    return good.groupBy("mode", "granularity").agg(F.count(F.lit(1)).alias("runs"), *[F.avg(c).alias(f"mean_{c}") for c in names])


def startup_summary(events: DataFrame, submitted: DataFrame) -> DataFrame:
    """Per run: upper median of the workers' start latency, and their stagger."""
    starts = events.where("key = 'worker_start'").join(submitted, "run")
    late = F.collect_list(F.col("ms") - F.col("submit_ms"))
    return starts.groupBy("run").agg(upper_median(late).alias("startup_median_ms"), (F.max("ms") - F.min("ms")).alias("stagger_ms"), F.first(F.col("finish_ms") - F.col("submit_ms")).alias("host_total_ms"))


def collective_latency(events: DataFrame, mode: str) -> DataFrame:
    """Per run: upper median over iterations of last end minus first start."""
    suffix = "broadcast_end" if mode == "broadcast" else "all_to_all_end"
    e = events.withColumn("iteration", F.regexp_extract("key", r"^iter_(\d+)_", 1).try_cast("int"))
    part = e.groupBy("run", "iteration").agg(F.min(F.when(F.col("key").endswith("_start"), F.col("ms"))).alias("a"), F.max(F.when(F.col("key").endswith(suffix), F.col("ms"))).alias("b"))
    return part.where("a is not null and b is not null and iteration is not null").groupBy("run").agg(upper_median(F.collect_list(F.col("b") - F.col("a"))).alias("latency_median_ms"))


def point_to_point(events: DataFrame, payload_bytes: int, iterations: int, pairs: bool = False) -> DataFrame:
    """Per run: duration and MB/s of worker 0, or of all pairs together."""
    e = events if pairs else events.where("worker_id = 0")
    at = lambda k, f: f(F.when(F.col("key") == k, F.col("ms")))
    out = e.groupBy("run").agg(at("ptp_start", F.min).alias("a"), at("ptp_end", F.max).alias("b"), F.count_if(F.col("key") == "ptp_start").alias("n"))
    out = out.where("a is not null and b is not null").withColumn("duration_ms", F.greatest(F.lit(0).cast("long"), F.col("b") - F.col("a")))
    total = F.lit(payload_bytes * iterations) * (F.floor(F.col("n") / 2) if pairs else F.lit(1))
    rate = F.round(total / (F.col("duration_ms") / 1000.0) / (1024 * 1024), 4)
    return out.select("run", "duration_ms", F.when(F.col("duration_ms") > 0, rate).alias("throughput_mb_s"))


def counter_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """``counter, delta`` of two readings ``counter, value``."""
    b = before.select("counter", F.col("value").alias("was"))
    return after.join(b, "counter", "left").select("counter", (F.col("value") - F.coalesce("was", F.lit(0))).alias("delta"))


def fits(workers: Column, cpus_each: Column, mb_each: Column, cpus: int, memory_mb: int, reserved_cpus: int = 6, reserved_mb: int = 8192) -> Column:
    """Whether a cluster has room for the workers beside its own needs."""
    return (workers * cpus_each + reserved_cpus <= cpus) & (workers * mb_each + reserved_mb <= memory_mb)


def divisors(value: Column) -> Column:
    """All divisors in rising order: the possible granularities."""
    return F.filter(F.sequence(F.lit(1), value.cast("int")), lambda d: value % d == 0)


def epoch_ms(at: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, as traces have them."""
    return F.unix_millis(at)


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def cost_cells(algorithms: DataFrame, sizes: list[int], threads: list[int], ranks: list[int], reps: int) -> DataFrame:
    """The runs of a cost comparison: ``algorithm, nodes, backend, threads,
    ranks, rep``. One thread stands alone, several threads share memory, and
    ranks exchange messages."""
    kind = F.array(
        F.struct(F.lit("standalone").alias("backend"), F.lit(1).alias("threads"), F.lit(None).cast("int").alias("ranks")),
        *[F.struct(F.lit("rayon").alias("backend"), F.lit(x).alias("threads"), F.lit(None).cast("int").alias("ranks")) for x in threads],
        *[F.struct(F.lit("mpi").alias("backend"), F.lit(None).cast("int").alias("threads"), F.lit(x).alias("ranks")) for x in ranks],
    )
    cells = algorithms.select("algorithm", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("nodes"))
    cells = cells.select("algorithm", "nodes", F.explode(kind).alias("k")).select("algorithm", "nodes", "k.*")
    return cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def cells_to_run(cells: DataFrame, records: DataFrame, force: bool = False) -> DataFrame:
    """Cells without a passed record: what a resumed campaign still has to run."""
    if force:
        return cells
    keys = [c for c in cells.columns if c in records.columns]
    done = records.where("status = 'passed'").select(*[F.col(c).alias(f"__{c}") for c in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return cells.join(done, same, "left_anti")


def payloads(run: DataFrame, partitions: Column, granularity: Column) -> DataFrame:
    """One row per partition of a run: its columns, ``partition`` and ``group``,
    the number of the pack of ``granularity`` workers that it is in."""
    each = run.withColumn("partition", F.explode(F.sequence(F.lit(0), partitions.cast("int") - 1)))
    return each.withColumn("group", F.floor(F.col("partition") / granularity).cast("int"))
