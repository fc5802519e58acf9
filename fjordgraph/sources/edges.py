"""Edge lists, graph JSON and result files: readers and writers.

Text fields are cast by ``try_cast``, so a malformed field is null; lenient
readers leave such rows out, strict ones raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.generate import uniform
from ..operators.graph import Graph, canonical, csr_offsets, symmetrise
from ..operators.ranks import global_rank
from ..storage import cut

UNVISITED, UNREACHABLE, UNLABELLED = "UNVISITED", "Infinity", "UNKNOWN"
MAX_LABEL = (1 << 32) - 1
GRAPH_JSON = "edges ARRAY<ARRAY<BIGINT>>, labeled_nodes MAP<STRING, BIGINT>, num_nodes BIGINT"
#: Edges, and seeds, of a graph document; larger graphs are several. Copies of an edge
#: that may come together.
DOCUMENT, COPIES = 100_000, 1000


def _fields(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    lines = lines.where("line <> '' and not startswith(line, '#')")
    return lines.select("line", F.split("line", pattern).alias("p"))


def _get(i: int, kind: str) -> Column:
    return F.get("p", F.lit(i)).try_cast(kind)


def _weight() -> Column:
    w = F.coalesce(_get(2, "double"), F.lit(1.0))
    bad = (w < 0) | F.isnan(w) | (w == float("inf"))
    return F.when(bad, F.raise_error(F.lit("edge weights must be finite and not negative"))).otherwise(w)


def read_edges(spark: SparkSession, path: str, n: int | None = None, tab_only: bool = False) -> DataFrame:
    """``src, dst``: blank, ``#`` and malformed lines are skipped, more columns
    ignored. ``n`` drops edges that leave ``0 .. n-1``."""
    rows = _fields(spark, path, r"\t" if tab_only else r"\s+").select(_get(0, "long").alias("src"), _get(1, "long").alias("dst"))
    return _inside(rows.where("src is not null and dst is not null"), n)


def _inside(rows: DataFrame, n: int | None) -> DataFrame:
    rows = rows.where("src >= 0 and dst >= 0")
    return rows if n is None else rows.where((F.col("src") < n) & (F.col("dst") < n))


def read_weighted_edges(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """``src, dst, weight``: a missing or malformed weight is 1; a negative or
    non-finite one is an error."""
    rows = _fields(spark, path, r"\s+").select(_get(0, "long").alias("src"), _get(1, "long").alias("dst"), _weight().alias("weight"))
    return _inside(rows.where("src is not null and dst is not null"), n)


def read_seeded_edges(spark: SparkSession, path: str, n: int | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges and ``id, label`` seeds: a third column labels the source vertex.

    A negative label is none, and one beyond 32 unsigned bits is left out.
    ``strict`` raises on malformed lines instead of leaving them out.
    """
    rows = _fields(spark, path, r"\s+").select("line", F.size("p").alias("k"), _get(0, "long").alias("src"), _get(1, "long").alias("dst"), _get(2, "long").alias("label"))
    broken = F.col("src").isNull() | F.col("dst").isNull() | ((F.col("k") > 2) & F.col("label").isNull())
    if strict:
        said = F.concat(F.lit("malformed line: "), F.col("line"))
        rows = rows.withColumn("src", F.when(broken, F.raise_error(said).cast("long")).otherwise(F.col("src")))
    rows = _inside(rows.where("src is not null and dst is not null"), n)
    seeds = rows.where(F.col("label").between(0, MAX_LABEL)).select(F.col("src").alias("id"), "label").distinct()
    return rows.select("src", "dst"), seeds


def edge_faults(spark: SparkSession, path: str, third: str = "weight") -> DataFrame:
    """``line, fault`` of the lines that readers leave out, take as something else or
    raise on: too few ``columns``, a ``source`` or ``destination`` that is no number, or
    one below 0 (``outside``); a ``weight`` that is no number, is ``not finite`` or
    ``negative``; or, with ``third`` as ``label``, a ``label`` that is no number or is
    ``too large``. A line has its first fault."""
    rows = _fields(spark, path, r"\s+")
    src, dst, raw, weight, label = _get(0, "long"), _get(1, "long"), F.get("p", F.lit(2)), _get(2, "double"), _get(2, "long")
    fault = F.when(F.size("p") < 2, "columns").when(src.isNull(), "source").when(dst.isNull(), "destination").when((src < 0) | (dst < 0), "outside")
    if third == "weight":
        fault = fault.when(raw.isNotNull() & weight.isNull(), "weight").when(F.isnan(weight) | (F.abs(weight) == float("inf")), "not finite").when(weight < 0, "negative")
    else:
        fault = fault.when(raw.isNotNull() & label.isNull(), "label").when(label > MAX_LABEL, "too large")
    return rows.select("line", fault.alias("fault")).where("fault is not null")


def read_shards(spark: SparkSession, path: str, n: int, weighted: bool = False) -> DataFrame:
    """Sharded edges with the number of their shard, from ``part-<number>`` names.

    ``weighted`` shards have a third column as :func:`read_weighted_edges` has it.
    """
    name = F.input_file_name()
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.regexp_extract(name, r"part[-=](\d+)", 1).cast("int").alias("shard"))
    p = lines.where("line <> '' and not startswith(line, '#')").select("shard", F.split("line", r"\s+").alias("p"))
    rows = p.select("shard", _get(0, "long").alias("src"), _get(1, "long").alias("dst"), _weight().alias("weight"))
    rows = _inside(rows.where("src is not null and dst is not null"), n)
    return rows.select("src", "dst", "weight", "shard") if weighted else rows.select("src", "dst", "shard")


def read_undirected_edges(spark: SparkSession, path: str) -> DataFrame:
    return symmetrise(read_edges(spark, path))


def read_canonical_edges(spark: SparkSession, path: str) -> DataFrame:
    return canonical(read_weighted_edges(spark, path))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Edges, seeds and the number of vertices of a graph document, or of a folder of
    documents that are one graph."""
    doc = spark.read.schema(GRAPH_JSON).option("multiLine", True).json(path)
    edges = doc.select(F.explode("edges").alias("e")).select(F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst"))
    seeds = doc.select(F.explode("labeled_nodes").alias("k", "label")).select(F.col("k").try_cast("long").alias("id"), "label")
    return edges, seeds, doc.agg(F.max("num_nodes")).first()[0] or 0


def read_snap(spark: SparkSession, path: str, seed: int = 42) -> DataFrame:
    """A downloaded graph with weights 1 to 100, fixed by edge and seed."""
    return read_edges(spark, path).withColumn("weight", 1 + F.floor(uniform(seed, "src", "dst") * 100).cast("double"))


def read_result(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """``id, value`` of a written result; sentinels are null."""
    p = spark.read.text(path).select(F.split("value", r"\t").alias("p"))
    text = F.get("p", F.lit(1))
    value = F.when(text.isin(UNVISITED, UNREACHABLE, UNLABELLED, "inf"), None).otherwise(text.try_cast(kind))
    return p.select(_get(0, "long").alias("id"), value.alias("value")).where("id is not null")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


# writers


def write_result(result: DataFrame, path: str, value: str, sentinel: str, ordered: bool = True) -> None:
    """``id<TAB>value`` lines, in order of the ids over all parts."""
    rows = result.orderBy("id") if ordered else result
    text = F.concat_ws("\t", F.col("id").cast("string"), F.coalesce(F.col(value).cast("string"), F.lit(sentinel)))
    rows.select(text.alias("value")).write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in edges.columns]).alias("value")).write.text(path)


def _write_parts(rows: DataFrame, path: str, format: str = "parquet") -> None:
    """A folder ``part=<k>`` for each value of ``part``. Rows of a part come together as
    far as files get the advisory size; a large part is written by several tasks."""
    rows.hint("rebalance", "part").write.partitionBy("part").format(format).save(path)


def write_sharded(edges: DataFrame, path: str, parts: int, key: str = "src") -> None:
    """One folder ``part=<k>`` for the rows with ``key % parts = k``."""
    rest = F.concat_ws("\t", *[F.col(c).cast("string") for c in edges.columns])
    out = edges.select((F.col(key) % parts).cast("int").alias("part"), rest.alias("value"))
    _write_parts(out, path, "text")


def write_row_shards(rows: DataFrame, path: str, order: str, parts: int) -> None:
    """Row ``i`` in order of a unique column goes to folder ``part=<i % parts>``."""
    ranked = global_rank(rows, order, "__row").withColumn("part", (F.col("__row") % parts).cast("int")).drop("__row")
    _write_parts(ranked, path)


def write_csr(graph: Graph, path: str) -> None:
    """Compressed rows as tables: ``rows`` (``id, start, end``) and ``entries``
    (``at, dst, weight``), where a row's entries lie at ``start .. end - 1``."""
    offsets = csr_offsets(graph)
    weight = F.col("weight") if "weight" in graph.edges.columns else F.lit(1.0)
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst", "weight")) - 1
    entries = graph.edges.select("src", "dst", weight.alias("weight")).withColumn("place", place)
    entries = entries.join(offsets.select(F.col("id").alias("src"), "start"), "src").select((F.col("start") + F.col("place")).alias("at"), "dst", "weight")
    offsets.write.parquet(f"{path}/rows")
    entries.write.parquet(f"{path}/entries")


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, weight`` of what :func:`write_csr` wrote."""
    rows = spark.read.parquet(f"{path}/rows").where("end > start").select(F.col("id").alias("src"), F.explode(F.sequence("start", F.col("end") - 1)).alias("at"))
    return rows.join(spark.read.parquet(f"{path}/entries"), "at").select("src", "dst", "weight")


def write_range_rows(graph: Graph, path: str, parts: int) -> None:
    """Row pointers in contiguous ranges of ids, one folder ``part=<k>`` each,
    counted from the range's own first entry."""
    from ..operators.graph import owned_range

    rows = csr_offsets(graph).withColumn("part", owned_range(graph.n, parts, F.col("id")))
    base = rows.groupBy("part").agg(F.min("start").alias("base"))
    out = rows.join(F.broadcast(base), "part").select("id", (F.col("start") - F.col("base")).alias("start"), (F.col("end") - F.col("base")).alias("end"), "part")
    _write_parts(out, path)


def write_ranges(rows: DataFrame, path: str, key: str, n: int, parts: int) -> None:
    """Contiguous ranges of ``key`` in folders ``part=<k>``, as Parquet."""
    from ..operators.graph import owned_range

    _write_parts(rows.withColumn("part", owned_range(n, parts, F.col(key))), path)


def graph_documents(edges: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """Rows in the layout of :func:`read_graph_json`, which together are the graph: one
    for each ``DOCUMENT`` edges or seeds, so a small graph is one document."""
    edges, seen = cut(edges.select("src", "dst"), "graph-edges", n=F.count(F.lit(1)))
    k = max(1, -(-max(seen["n"], seeds.count()) // DOCUMENT))
    # copies of one edge are dealt out too
    copies = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies")).select("src", "dst", "copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))).alias("at"))
    some = F.array_repeat(F.array("src", "dst"), F.least(F.col("copies") - F.col("at") * COPIES, F.lit(COPIES)).cast("int"))
    e = copies.select(F.pmod(F.xxhash64("src", "dst", "at"), F.lit(k)).alias("document"), some.alias("some")).repartition(k, "document")
    e = e.groupBy("document").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("edges"))
    s = seeds.select(F.pmod(F.xxhash64("id"), F.lit(k)).alias("document"), F.col("id").cast("string").alias("k"), "label").repartition(k, "document")
    s = s.groupBy("document").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "label")))).alias("labeled_nodes"))
    rows = edges.sparkSession.range(k).select(F.col("id").alias("document")).join(e, "document", "left").join(s, "document", "left")
    return rows.select(F.coalesce("edges", F.array().cast("array<array<bigint>>")).alias("edges"), F.coalesce("labeled_nodes", F.create_map().cast("map<string,bigint>")).alias("labeled_nodes"), F.lit(n).cast("long").alias("num_nodes"))


def write_graph_json(edges: DataFrame, seeds: DataFrame, n: int, path: str) -> None:
    """A file for each document, as a reader of documents of many lines takes files whole."""
    graph_documents(edges, seeds, n).write.option("maxRecordsPerFile", 1).json(path)


def result_document(result: DataFrame, value: str, info: dict) -> DataFrame:
    """One JSON string with run information and the full vector; small n only."""
    vector = F.transform(F.sort_array(F.collect_list(F.struct("id", F.col(value).alias("v")))), lambda x: x["v"])
    meta = [F.lit(v).alias(k) for k, v in info.items()]
    return result.agg(vector.alias(value)).select(F.to_json(F.struct(*meta, value)).alias("json"))
