"""The graph model and its relational transforms.

A graph is a directed multigraph: an edge table ``src, dst[, weight]`` whose
repeated edges and self-loops count, and a vertex domain that is ``0 .. n-1`` when
``n`` is given, a table of ids, or the set of endpoints. Edges that leave the domain are
dropped on construction, before any degree is counted; so are edges with a null
endpoint. A missing weight is 1, a negative or non-finite one an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import Layout
from .ranks import global_rank, running_total


class Graph:
    """Edges and a vertex domain; immutable.

    ``vertices`` (``id``) is a domain of any ids; edges with an end beside it are
    dropped, unless it is said to be ``closed``, that is, to hold all ends.

    ``layout`` keeps the edges for loops, by either end. An algorithm releases what it
    had stored, but if the graph is used in ``with``, the tables stay until its end, for
    all that runs there.
    """

    def __init__(self, edges: DataFrame, n: int | None = None, vertices: DataFrame | None = None, closed: bool = False):
        keep = [c for c in ("src", "dst", "weight") if c in edges.columns]
        edges = edges.select(*keep).where("src is not null and dst is not null")
        if "weight" in keep:
            w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
            bad = (w < 0) | F.isnan(w) | (w == float("inf"))
            edges = edges.withColumn("weight", F.when(bad, F.raise_error(F.lit("edge weights must be finite and not negative"))).otherwise(w))
        if n is not None:
            edges = edges.where((F.col("src") >= 0) & (F.col("dst") >= 0) & (F.col("src") < n) & (F.col("dst") < n))
        if vertices is not None and not closed:
            for end in ("src", "dst"):
                edges = edges.join(vertices.select(F.col("id").alias(end)), end, "left_semi")
            edges = edges.select(*keep)
        self.edges, self.n, self._vertices = edges, n, vertices
        self.layout = Layout(edges)
        self._held = False

    def __enter__(self) -> Graph:
        self._held = True
        return self

    def __exit__(self, *error) -> None:
        self._held = False
        self.layout.release()

    def release(self) -> None:
        if not self._held:
            self.layout.release()

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def vertices(self) -> DataFrame:
        if self._vertices is not None:
            return self._vertices.select("id")
        return domain(self.spark, self.n) if self.n is not None else endpoints(self.edges)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(edges, self.n, self._vertices)


def domain(spark: SparkSession, n: int) -> DataFrame:
    """Vertices ``0 .. n-1``, isolated ones included."""
    return spark.range(n).select("id")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])


def symmetrise(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; multiplicity doubles."""
    return edges.unionByName(transpose(edges))


def undirected_simple(edges: DataFrame) -> DataFrame:
    """Both directions once, whatever the multiplicity; self-loops once."""
    return symmetrise(edges.select("src", "dst")).distinct()


def canonical(edges: DataFrame, weight: str | None = "weight") -> DataFrame:
    """Undirected edges ``src <= dst`` with the least weight of their repeats."""
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    if weight is None or weight not in edges.columns:
        return edges.select(*ends).distinct()
    return edges.select(*ends, F.col(weight).alias("weight")).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def from_adjacency(rows: DataFrame, neighbours: str = "neighbours") -> DataFrame:
    """``id, array of neighbours`` -> edges."""
    return rows.select(F.col("id").alias("src"), F.explode(neighbours).alias("dst"))


def to_adjacency(edges: DataFrame) -> DataFrame:
    """Edges -> ``id, neighbours`` (sorted, with repeats); for export.

    One row holds all of a vertex's neighbours, so this is for graphs whose
    largest degree fits in memory.
    """
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def dangling(graph: Graph) -> DataFrame:
    """Vertices without an out-edge."""
    sources = graph.edges.select(F.col("src").alias("id")).distinct()
    return graph.vertices.join(sources, "id", "left_anti")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Out-edges of the given ``id``s."""
    return edges.join(ids.select(F.col("id").alias("src")), "src")


def summary(edges: DataFrame) -> DataFrame:
    """One row: ``n`` (greatest id + 1), ``n_edges``, ``source``, ``source_degree``.

    The source is the vertex of greatest out-degree, the least id of equal ones.
    """
    top = F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("top")
    best = out_degree(edges).agg(top).select((-F.col("top.neg")).alias("source"), F.col("top.degree").alias("source_degree"))
    size = edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("n"), F.count(F.lit(1)).alias("n_edges"))
    return size.crossJoin(best)


def formula_weight(src: Column | str = "src", dst: Column | str = "dst", seed: int = 7) -> Column:
    """Deterministic integer weight of an edge, 1 to 13."""
    s, d = (F.col(c) if isinstance(c, str) else c for c in (src, dst))
    return (1 + (s * 31 + d * 17 + seed) % 13).cast("double")


def clean_seeds(seeds: DataFrame) -> DataFrame:
    """``id, label`` with one label per vertex: the least; negatives are none."""
    return seeds.where("id is not null and label >= 0").groupBy("id").agg(F.min("label").alias("label"))


def initial_labels(graph: Graph, seeds: DataFrame | None) -> DataFrame:
    """``id, label, is_seed``: the seeds' labels, or own ids without seeds."""
    if seeds is None:
        return graph.vertices.select("id", F.col("id").alias("label"), F.lit(False).alias("is_seed"))
    s = clean_seeds(seeds).select("id", "label", F.lit(True).alias("is_seed"))
    return graph.vertices.join(s, "id", "left").select("id", "label", F.coalesce("is_seed", F.lit(False)).alias("is_seed"))


def owned_range(n: int, parts: int, value: Column) -> Column:
    """Contiguous blocks of ``0 .. n-1``; the first ``n % parts`` have one more."""
    size, extra = divmod(n, parts)
    edge = extra * (size + 1)
    small = F.lit(extra) + F.floor((value - edge) / F.lit(max(size, 1)))
    return F.when(value < edge, F.floor(value / F.lit(size + 1))).otherwise(small).cast("int")


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``mapping`` (``id, new_id``)."""
    a = mapping.select(F.col("id").alias("src"), F.col("new_id").alias("a"))
    b = mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("b"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest)


def dense_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels renumbered 0, 1, 2, ... by the least id that has them.

    The order of labels is a global rank, taken over distinct labels only.
    """
    first = labels.groupBy(label).agg(F.min("id").alias("first_id"))
    return labels.join(global_rank(first, "first_id", "new_label").select(label, "new_label"), label).select("id", F.col("new_label").alias("label"))


def csr_offsets(graph: Graph) -> DataFrame:
    """``id, start, end``: where each vertex's out-edges lie in source order."""
    deg = graph.vertices.join(out_degree(graph.edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    out = running_total(deg, ["id"], "degree", "end")
    return out.select("id", (F.col("end") - F.col("degree")).alias("start"), "end")


def owned_edges(graph: Graph, parts: int) -> DataFrame:
    """Edges with the ``owner`` of their source, in order of the source. ``parts`` owners
    have contiguous ranges of the ids; partition ``k`` holds the edges of owner ``k``."""
    if graph.n is None:
        raise ValueError("owners need a domain 0 .. n-1")
    rows = graph.edges.withColumn("owner", owned_range(graph.n, parts, F.col("src")))
    return rows.repartitionById(parts, "owner").sortWithinPartitions("src", "dst")
