"""All registered queries of the graph library, with their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import analytics, generate, reports, tables, validate
from ..operators import graph as g
from ..operators import labels as lp
from ..operators import louvain as lv
from ..operators import pagerank as pr
from ..operators import traversal as tr
from ..operators.components import connected_components as cc
from ..operators.pregel import aggregate_messages, pregel
from ..sources import edges as io
from ..sources import records
from ..storage import shared_dir
from . import tables as t
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401


def _scratch(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


# algorithms


@query(f"with recursive {t.BFS} select v.id, r.level from v left join r using (id)")
def bfs_levels(spark, sf_dir):
    graph = t.part_graph(spark, sf_dir)
    return tr.bfs(graph, t.source_of(graph.edges))[0]


@query(f"with recursive {t.BFS} select v.id, case when r.level <= 3 then r.level end as level from v left join r using (id)")
def bfs_capped(spark, sf_dir):
    graph = t.part_graph(spark, sf_dir)
    return tr.bfs(graph, t.source_of(graph.edges), max_levels=3)[0]


@query(f"with recursive {t.SSSP} select v.id, r.d as distance from v left join r using (id)")
def sssp_distances(spark, sf_dir):
    graph = t.part_graph(spark, sf_dir, weighted=True)
    return tr.sssp(graph, t.source_of(graph.edges))[0]


@query(f"with {t.pagerank_ctes(10)} select id, round(r, 9) as rank from p10")
def pagerank_ten_rounds(spark, sf_dir):
    ranks, _ = pr.pagerank(t.part_graph(spark, sf_dir), max_iter=10, tol=0.0)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@query(t.lp_sql(5, seeded=False))
def lp_unsupervised(spark, sf_dir):
    return lp.label_propagation(t.part_graph(spark, sf_dir), max_iter=5)[0]


@query(t.lp_sql(5, seeded=True))
def lp_seeded(spark, sf_dir):
    return lp.label_propagation(t.part_graph(spark, sf_dir), t.seeds(spark, sf_dir), max_iter=5)[0]


@query(t.lp_sql(4, seeded=True).replace(t.PARTS, t.PARTS.replace("e as materialized (", "e0 as (").replace("), v as", "), e as materialized (select src, dst from e0 union select dst, src from e0), ends as (select src id from e union select p_partkey from part where p_partkey % 10 = 0), v as").replace("select p_partkey id from part)", "select id from ends)")))
def lp_undirected(spark, sf_dir):
    return lp.label_propagation_undirected(t.part_chain(spark, sf_dir), t.seeds(spark, sf_dir), max_iter=4, ratio=0.0)[0]


@query(f"with recursive {t.COMPONENTS} select id, m as component from r")
def components_weak(spark, sf_dir):
    return cc(t.part_chain(spark, sf_dir))


@query(f"with recursive {t.COMPONENTS} select count(distinct m) as components from r")
def component_count(spark, sf_dir):
    return reports.component_count(cc(t.part_chain(spark, sf_dir)))


@query(f"with recursive {t.COMPONENTS}, {t.digest_ctes('select id, m as label from r')} select digest from digested")
def partition_digest(spark, sf_dir):
    return reports.partition_digest(cc(t.part_chain(spark, sf_dir)), "component")


@query(f"with {t.pagerank_ctes(10, t.MULTI)} select id, round(r, 9) as rank from p10")
def pagerank_multigraph(spark, sf_dir):
    """Repeated edges and self-loops each carry their share."""
    ranks, _ = pr.pagerank(t.user_graph(spark, sf_dir), max_iter=10, tol=0.0)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@query(t.lp_sql(4, False, t.MULTI))
def lp_multigraph(spark, sf_dir):
    return lp.label_propagation(t.user_graph(spark, sf_dir), max_iter=4)[0]


@query(f"with {t.MULTI} select src as id, count(*) as degree from e group by 1")
def out_degree_multigraph(spark, sf_dir):
    return g.out_degree(t.user_graph(spark, sf_dir).edges)


@query(f"with {t.pagerank_ctes(8, t.TRADE)} select id, round(r, 9) as rank from p8")
def pagerank_bipartite(spark, sf_dir):
    """All suppliers are dangling."""
    ranks, _ = pr.pagerank(t.trade_graph(spark, sf_dir), max_iter=8, tol=0.0)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@query(f"with recursive {t.COMPONENTS.replace(t.PARTS, t.TRADE)} select id, m as component from r")
def components_bipartite(spark, sf_dir):
    return cc(t.trade_graph(spark, sf_dir).edges)


@query(t.pagerank_stop_sql(25, 1e-4))
def pagerank_converged(spark, sf_dir):
    ranks, info = pr.pagerank(t.part_graph(spark, sf_dir), max_iter=25, tol=1e-4)
    return ranks.select("id", F.round("rank", 9).alias("rank"), F.lit(info.iterations).alias("iterations"))


@query(f"""with {t.PARTS}, dg as (select src, count(*) d from e group by src), p0 as (select id, 1.0::double r from v),
{", ".join(f"p{i} as materialized (select v.id, 0.15::double + 0.85::double * coalesce(c, 0) r from v left join (select e.dst id, sum(p.r / dg.d) c from e join p{i - 1} p on p.id = e.src join dg on dg.src = e.src group by 1) using (id))" for i in range(1, 7))}
select id, round(r, 7) as rank from p6""")
def pagerank_unnormalised(spark, sf_dir):
    ranks, _ = pr.pagerank(t.part_graph(spark, sf_dir), max_iter=6, tol=0.0, normalised=False)
    return ranks.select("id", F.round("rank", 7).alias("rank"))


@query(t.lp_stop_sql(8, "changed <= 40"))
def lp_until_threshold(spark, sf_dir):
    labels, info = lp.label_propagation(t.part_graph(spark, sf_dir), t.seeds(spark, sf_dir), max_iter=8, threshold=40)
    return labels.select("id", "label", F.lit(info.iterations).alias("iterations"))


@query(t.lp_stop_sql(8, "changed = 0 or changed::double / free < 0.05::double"))
def lp_until_ratio(spark, sf_dir):
    labels, info = lp.label_propagation(t.part_graph(spark, sf_dir), t.seeds(spark, sf_dir), max_iter=8, ratio=0.05)
    return labels.select("id", "label", F.lit(info.iterations).alias("iterations"))


@query(t.sssp_progress_sql(6))
def sssp_progress(spark, sf_dir):
    """Vertices whose distance improved, by round."""
    graph = t.part_graph(spark, sf_dir, weighted=True)
    _, info = tr.sssp(graph, t.source_of(graph.edges), max_iter=6)
    said = [m["changed"] for m in info.metrics] + [0] * (6 - len(info.metrics))
    return spark.range(6).select((F.col("id") + 1).cast("int").alias("round"), F.get(F.array(*[F.lit(x) for x in said]), F.col("id").cast("int")).cast("long").alias("improved"))


_UNDIRECTED = t.WEIGHTED + ", c as (select least(src, dst) src, greatest(src, dst) dst, min(weight) weight from w group by 1, 2)"


def _communities(spark, sf_dir):
    base = g.canonical(t.part_chain(spark, sf_dir).withColumn("weight", g.formula_weight()))
    return base, g.endpoints(base).select("id", (F.col("id") % 10).alias("community"))


@query(f"""with {_UNDIRECTED}, m as (select 2 * sum(weight) m2 from c),
ends as (select src id, weight from c union all select dst, weight from c where src <> dst),
tot as (select id % 10 k, sum(weight) tot from ends group by 1),
ins as (select src % 10 k, sum(case when src = dst then weight else 2 * weight end) ins from c where src % 10 = dst % 10 group by 1)
select round(sum(coalesce(ins, 0) / m2 - (tot / m2) * (tot / m2)), 9) as modularity from tot left join ins using (k), m""")
def modularity(spark, sf_dir):
    return lv.modularity(*_communities(spark, sf_dir)).select(F.round("modularity", 9).alias("modularity"))


@query(f"with {_UNDIRECTED} select least(src % 10, dst % 10) as src, greatest(src % 10, dst % 10) as dst, sum(weight) as weight from c group by 1, 2")
def louvain_coarsen(spark, sf_dir):
    return lv.coarsen(*_communities(spark, sf_dir))


@query()
def louvain_communities(spark, sf_dir):
    base, _ = _communities(spark, sf_dir)
    return lv.louvain(base)[0]


@query(f"with {_UNDIRECTED}, u as (select src id from c union select dst from c) select count(*) as vertices, count(*) as labelled, true as labels_dense, true as beats_residues, 0::bigint as unlike_itself from u")
def louvain_quality(spark, sf_dir):
    """One community per vertex, numbered without gaps, better than a partition
    by id, and the same as itself under other names."""
    base, residues = _communities(spark, sf_dir)
    found = lv.louvain(base)[0]
    value = lambda c: lv.modularity(base, c).first().modularity
    other = found.select("id", (F.col("community") * 3 + 1).alias("label"))
    return found.agg(
        F.lit(residues.count()).cast("long").alias("vertices"), F.count_distinct("id").alias("labelled"), (F.max("community") + 1 == F.count_distinct("community")).alias("labels_dense"),
        F.lit(value(found) > value(residues)).alias("beats_residues"), F.lit(validate.partition_conflicts(found.withColumnRenamed("community", "label"), other).count()).cast("long").alias("unlike_itself"),
    )


@query(f"with recursive {t.BFS} select v.id, r.level from v left join r using (id)")
def pregel_bfs(spark, sf_dir):
    graph = t.part_graph(spark, sf_dir)
    src = t.source_of(graph.edges)
    start = graph.vertices.select("id", F.when(F.col("id") == src, 0).alias("level"))
    return pregel(start, graph.edges, F.min("msg"), {"level": F.least("level", "msg")}, to_dst=F.col("src_level") + 1, reads=("src",))[0]


@query(f"with {t.PARTS} select e.dst as id, cast(sum(e.src) as bigint) as msg from e group by 1")
def aggregate_neighbours(spark, sf_dir):
    graph = t.part_graph(spark, sf_dir)
    return aggregate_messages(graph.vertices.withColumn("x", F.col("id")), graph.edges, F.sum("msg"), to_dst=F.col("src_x"))


# transforms


_HALF = "(select count(*) // 2 from part)"


@query(f"with {t.PARTS} select src, dst from e where src < {_HALF} and dst < {_HALF}")
def graph_in_domain(spark, sf_dir):
    """The domain is half of the parts, whatever their number."""
    return g.Graph(t.part_chain(spark, sf_dir), t.table(spark, sf_dir, "part").count() // 2).edges


@query(f"with {t.PARTS}, b as (select id, coalesce(d, 0) d from v left join (select src id, count(*) d from e group by 1) using (id)) select id, cast(sum(d) over (order by id) - d as bigint) as start, cast(sum(d) over (order by id) as bigint) as \"end\" from b")
def csr_offsets(spark, sf_dir):
    return g.csr_offsets(t.part_graph(spark, sf_dir))


@query(f"with {t.PARTS} select dst as src, src as dst from e")
def transpose(spark, sf_dir):
    return g.transpose(t.part_chain(spark, sf_dir))


@query(f"with {t.PARTS} select src, dst from e union all select dst, src from e")
def symmetrise(spark, sf_dir):
    return g.symmetrise(t.part_chain(spark, sf_dir))


@query(f"with {t.PARTS} select src, dst from e union select dst, src from e")
def undirected_simple(spark, sf_dir):
    return g.undirected_simple(t.part_chain(spark, sf_dir))


@query(f"with {_UNDIRECTED} select src, dst, weight from c")
def canonical_edges(spark, sf_dir):
    return g.canonical(t.part_chain(spark, sf_dir).withColumn("weight", g.formula_weight()))


@query(f"with {t.PARTS} select src as id from e union select dst from e")
def endpoints(spark, sf_dir):
    return g.endpoints(t.part_chain(spark, sf_dir))


@query(f"with {t.PARTS} select src, dst from e")
def adjacency_round_trip(spark, sf_dir):
    return g.from_adjacency(g.to_adjacency(t.part_chain(spark, sf_dir)))


@query(f"with {t.PARTS} select src, dst from e where src in (select id from v)")
def neighbour_lookup(spark, sf_dir):
    """All parts are asked for."""
    return g.neighbours(t.part_chain(spark, sf_dir), t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query(f"with {t.PARTS} select src as id, count(*) as degree from e group by 1")
def out_degree(spark, sf_dir):
    return g.out_degree(t.part_chain(spark, sf_dir))


@query(f"with {t.PARTS} select id from v where id not in (select src from e)")
def dangling(spark, sf_dir):
    return g.dangling(t.part_graph(spark, sf_dir))


@query(f"with {t.SOURCE} select (select max(greatest(src, dst)) + 1 from e) as n, (select count(*) from e) as n_edges, (select id from s0) as source, (select count(*) from e where src = (select id from s0)) as source_degree")
def graph_summary(spark, sf_dir):
    return g.summary(t.part_chain(spark, sf_dir))


@query(f"with {t.WEIGHTED} select src, dst, weight from w")
def formula_weights(spark, sf_dir):
    return generate.with_formula_weight(t.part_chain(spark, sf_dir))


@query("select l_partkey as id, min(l_suppkey) as label from lineitem group by 1")
def seed_conflicts(spark, sf_dir):
    rows = t.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("label"))
    return g.clean_seeds(rows)


@query("with n as (select count(*) n from part) select p_partkey as id, cast(case when p_partkey < (n % 7) * (n // 7 + 1) then p_partkey // (n // 7 + 1) else n % 7 + (p_partkey - (n % 7) * (n // 7 + 1)) // (n // 7) end as int) as owner from part, n")
def owned_ranges(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), g.owned_range(part.count(), 7, F.col("p_partkey")).alias("owner"))


@query(f"with {t.PARTS}, {t.SEEDS} select v.id, cast(s.label as bigint) as label, s.id is not null as is_seed from v left join seeds s using (id)")
def initial_labels(spark, sf_dir):
    return g.initial_labels(t.part_graph(spark, sf_dir), t.seeds(spark, sf_dir))


@query(f"with {t.PARTS}, n as (select count(*) n from part) select (n - 1 - src) as src, (n - 1 - dst) as dst from e, n")
def relabel(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    mapping = part.select(F.col("p_partkey").alias("id"), (F.lit(part.count() - 1) - F.col("p_partkey")).alias("new_id"))
    return g.relabel(t.part_chain(spark, sf_dir), mapping)


@query("with f as (select p_brand, min(p_partkey) a from part group by 1), d as (select p_brand, dense_rank() over (order by a) - 1 k from f) select p_partkey as id, k as label from part join d using (p_brand)")
def dense_labels(spark, sf_dir):
    return g.dense_labels(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label")))


# sources and sinks, over files written from the tables


def _scan_with_noise(spark, edges, n):
    path = _scratch(spark)
    noise = spark.createDataFrame([("# header",), ("bad line",), ("",), ("5",), ("1 x",)], "value string")
    rows = edges.select(F.concat_ws("\t", "src", "dst").alias("value"))
    rows.unionByName(noise).write.text(path)
    return io.read_edges(spark, path, n=n)


@query(f"with {t.PARTS} select src, dst from e where src < {_HALF} and dst < {_HALF}")
def scan_edges(spark, sf_dir):
    return _scan_with_noise(spark, t.part_chain(spark, sf_dir), t.table(spark, sf_dir, "part").count() // 2)


@query(f"with {t.WEIGHTED} select src, dst, case when src % 2 = 0 then weight else 1 end as weight from w")
def scan_weighted_edges(spark, sf_dir):
    path = _scratch(spark)
    w = F.when(F.col("src") % 2 == 0, g.formula_weight().cast("string"))
    t.part_chain(spark, sf_dir).select(F.concat_ws("\t", "src", "dst", w).alias("value")).write.text(path)
    return io.read_weighted_edges(spark, path)


@query(f"with {t.PARTS} select distinct src as id, src % 5 as label from e where src % 5 > 0")
def scan_seeds(spark, sf_dir):
    path = _scratch(spark)
    label = F.when(F.col("src") % 5 > 0, F.col("src") % 5).otherwise(-1)
    io.write_edges(t.part_chain(spark, sf_dir).withColumn("label", label), path)
    return io.read_seeded_edges(spark, path)[1]


@query(f"with {t.PARTS} select src, dst, cast(src % 8 as int) as shard from e")
def scan_shards(spark, sf_dir):
    path = _scratch(spark)
    io.write_sharded(t.part_chain(spark, sf_dir), path, 8)
    return io.read_shards(spark, path, t.table(spark, sf_dir, "part").count())


@query(f"with {t.PARTS} select src, dst from e union all select dst, src from e")
def scan_undirected(spark, sf_dir):
    path = _scratch(spark)
    io.write_edges(t.part_chain(spark, sf_dir), path)
    return io.read_undirected_edges(spark, path)


@query(f"with {_UNDIRECTED} select src, dst, weight from c")
def scan_canonical(spark, sf_dir):
    path = _scratch(spark)
    io.write_edges(t.part_chain(spark, sf_dir).withColumn("weight", g.formula_weight()), path)
    return io.read_canonical_edges(spark, path)


@query(f"with {t.PARTS} select src, dst from e")
def graph_json_round_trip(spark, sf_dir):
    """All edges, in as many documents as the graph needs."""
    path = _scratch(spark)
    io.write_graph_json(t.part_chain(spark, sf_dir), t.seeds(spark, sf_dir), t.table(spark, sf_dir, "part").count(), path)
    return io.read_graph_json(spark, path)[0]


@query(f"with recursive {t.BFS} select v.id, cast(r.level as bigint) as value from v left join r using (id)")
def result_round_trip(spark, sf_dir):
    path = _scratch(spark)
    io.write_result(bfs_levels(spark, sf_dir), path, "level", io.UNVISITED)
    return io.read_result(spark, path)


@query("with n as (select count(*) n from part) select p_partkey as id, cast(case when p_partkey < (n % 5) * (n // 5 + 1) then p_partkey // (n // 5 + 1) else n % 5 + (p_partkey - (n % 5) * (n // 5 + 1)) // (n // 5) end as int) as part from part, n")
def range_shards_round_trip(spark, sf_dir):
    path = _scratch(spark)
    part = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    io.write_ranges(part, path, "id", part.count(), 5)
    return spark.read.parquet(path).select("id", "part")


@query("select event_id, cast(case when event_id % 3 = 0 then greatest(event_id % 100, user_id) end as bigint) as duration from events")
def longest_durations(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, F.format_string("x {'duration': %d, 'end': 5} y {'duration': %d, 'end': 6}", F.col("event_id") % 100, F.col("user_id"))).otherwise("{'duration': 7}")
    return t.table(spark, sf_dir, "events").select("event_id", records.longest_duration(said).alias("duration"))


@query("select max(event_id) as event_id, max_by(user_id, event_id) as user_id from events where event_id % 2 = 0")
def last_json_line(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("RESULT "), F.to_json(F.struct("event_id", "user_id")))).otherwise("RESULT not json")
    return records.last_json_line(e.select(F.col("event_id").alias("line_no"), text.alias("value")), "event_id long, user_id long", "RESULT ")


@query("select p_partkey as id, cast(case when p_size % 3 = 0 then p_size when p_size % 3 = 1 then p_size * 1024 end as bigint) as mb from part")
def memory_sizes(spark, sf_dir):
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("MiB"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("g "))).otherwise("2 cups")
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), records.memory_mb(text).alias("mb"))


@query(f"with {t.PARTS} select distinct src as id, src % 5 as label from e where src % 5 > 0")
def scan_strict_seeds(spark, sf_dir):
    """The strict reader, on lines without a fault."""
    path = _scratch(spark)
    label = F.when(F.col("src") % 5 > 0, F.col("src") % 5).otherwise(-1)
    io.write_edges(t.part_chain(spark, sf_dir).withColumn("label", label), path)
    return io.read_seeded_edges(spark, path, strict=True)[1]


@query(f"with {t.PARTS} select distinct src as id, src as label from e where src % 2 = 0")
def scan_label_range(spark, sf_dir):
    """Labels beyond 32 bits are left out."""
    path = _scratch(spark)
    label = F.when(F.col("src") % 2 == 0, F.col("src")).otherwise(F.col("src") + (1 << 32))
    io.write_edges(t.part_chain(spark, sf_dir).withColumn("label", label), path)
    return io.read_seeded_edges(spark, path)[1]


@query(f"with {t.WEIGHTED} select src, dst, weight, cast(src % 8 as int) as shard from w")
def scan_weighted_shards(spark, sf_dir):
    path = _scratch(spark)
    io.write_sharded(t.part_chain(spark, sf_dir).withColumn("weight", g.formula_weight()), path, 8)
    return io.read_shards(spark, path, t.table(spark, sf_dir, "part").count(), weighted=True)


@query(f"with {t.PARTS} select src, dst, 1 + floor({generate.uniform_sql(42, 'src', 'dst')} * 100)::double as weight from e")
def scan_snap(spark, sf_dir):
    path = _scratch(spark)
    io.write_edges(t.part_chain(spark, sf_dir), path)
    return io.read_snap(spark, path)


@query(f"with {t.PARTS} select src, dst from e where src % 2 = 0")
def scan_tabs_only(spark, sf_dir):
    """Lines parted by blanks are malformed to this reader."""
    path = _scratch(spark)
    line = F.when(F.col("src") % 2 == 0, F.concat_ws("\t", "src", "dst")).otherwise(F.concat_ws(" ", "src", "dst"))
    t.part_chain(spark, sf_dir).select(line.alias("value")).write.text(path)
    return io.read_edges(spark, path, tab_only=True)


@query("with d as (select user_id, dense_rank() over (order by user_id) - 1 u from (select distinct user_id from events)) select u as user, cast(event_id % 97 as bigint) as item, cast(event_id % 5 + 1 as float) as rating from events join d using (user_id)")
def scan_ratings(spark, sf_dir):
    path = _scratch(spark)
    rows = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("userId"), (F.col("event_id") % 97).alias("movieId"), (F.col("event_id") % 5 + 1).alias("rating"), F.lit(7).alias("timestamp"))
    rows.write.option("header", True).csv(path)
    return tables.dense_ids(tables.read_ratings(spark, path), "user")


@query("select cast(p_size % 2 as tinyint) as label, cast(p_size as float) as f0, cast(p_partkey as float) as f1 from part where p_partkey % 3 > 0")
def scan_features(spark, sf_dir):
    """Rows with a malformed field are skipped."""
    path = _scratch(spark)
    x = F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string")).otherwise("x1")
    t.table(spark, sf_dir, "part").select(F.concat_ws(",", F.col("p_size") % 2, "p_size", x).alias("value")).write.text(path)
    return tables.read_features(spark, path, 2)


@query(f"with {t.PARTS} select sum(length(src::varchar) + length(dst::varchar) + 2) as bytes from e")
def written_bytes(spark, sf_dir):
    path = _scratch(spark)
    io.write_edges(t.part_chain(spark, sf_dir), path)
    return io.file_sizes(spark, path).where(F.col("path").endswith(".txt")).agg(F.sum("length").alias("bytes"))


@query(f"with {t.RUNS} select backend, nodes, count(*) as records, round(sum(ms), 7) as ms from runs group by 1, 2")
def scan_run_records(spark, sf_dir):
    """Records written as JSON lines, their sizes left to the file's name."""
    path = _scratch(spark)
    rows = t.runs(spark, sf_dir)
    made = rows.select(F.lit("bfs").alias("algorithm"), "backend", "ranks", "status", F.struct(F.struct(F.col("ms").alias("execution_time_ms")).alias("raw")).alias("result"), F.concat(F.lit("bfs_x_n"), F.col("nodes").cast("string"), F.lit("_rep1")).alias("name"))
    made.repartition("name").write.partitionBy("name").json(path)
    out = records.read_runs(spark, path, multi_line=False)
    return _rounded(out.groupBy("backend", "nodes").agg(F.count("rep").alias("records"), F.sum("result.raw.execution_time_ms").alias("ms")), "ms")


@query(f"with recursive {t.BFS} select v.id, r.level from v left join r using (id)")
def result_json_round_trip(spark, sf_dir):
    """The vector in one JSON string, read back; for results that fit one row."""
    doc = io.result_document(bfs_levels(spark, sf_dir), "level", {"algorithm": "bfs"})
    parsed = doc.select(F.from_json("json", "algorithm string, level array<int>").alias("r"))
    return parsed.select(F.posexplode("r.level").alias("id", "level")).select(F.col("id").cast("long").alias("id"), "level")


@query("select p_partkey as id, cast((row_number() over (order by p_partkey) - 1) % 6 as int) as part from part")
def row_shards_round_trip(spark, sf_dir):
    path = _scratch(spark)
    io.write_row_shards(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), path, "id", 6)
    return spark.read.parquet(path).select("id", "part")


@query(f"with {t.WEIGHTED} select src, dst, weight from w")
def csr_round_trip(spark, sf_dir):
    path = _scratch(spark)
    io.write_csr(t.part_graph(spark, sf_dir, weighted=True), path)
    return io.read_csr(spark, path)


@query(f"""with {t.PARTS}, n as (select count(*) n from part), b as (select id, coalesce(d, 0) d from v left join (select src id, count(*) d from e group by 1) using (id)),
o as (select id, cast(case when id < (n % 5) * (n // 5 + 1) then id // (n // 5 + 1) else n % 5 + (id - (n % 5) * (n // 5 + 1)) // (n // 5) end as int) part, d from b, n)
select id, cast(sum(d) over w - d as bigint) as start, cast(sum(d) over w as bigint) as "end", part from o window w as (partition by part order by id)""")
def range_rows_round_trip(spark, sf_dir):
    path = _scratch(spark)
    io.write_range_rows(t.part_graph(spark, sf_dir), path, 5)
    return spark.read.parquet(path).select("id", "start", "end", "part")


@query(f"with {t.PARTS}, n as (select count(*) n from part) select src, dst, cast(case when src < (n % 4) * (n // 4 + 1) then src // (n // 4 + 1) else n % 4 + (src - (n % 4) * (n // 4 + 1)) // (n // 4) end as int) as owner from e, n")
def owned_edges(spark, sf_dir):
    return g.owned_edges(t.part_graph(spark, sf_dir), 4)


@query("select event_id, epoch_us(ts) // 1000 as ms, date_trunc('milliseconds', ts) as ts from events")
def epoch_times(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("event_id", analytics.epoch_ms(F.col("ts").cast("timestamp")).alias("ms"))
    return e.withColumn("ts", analytics.from_epoch_ms(F.col("ms")).cast("timestamp_ntz"))


@query("select '| event_type | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' |' || chr(10), '' order by event_type) as text from (select event_type, count(*) n from events group by 1)")
def markdown_table(spark, sf_dir):
    counts = t.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type")
    return spark.range(1).select(F.lit(reports.markdown(counts)).alias("text"))


@query("with a as (select event_type, count(*) n from events group by 1), b as (select event_type, count(*) n from events where value > 50 group by 1) select a.event_type as counter, a.n - coalesce(b.n, 0) as delta from a left join b using (event_type)")
def counter_deltas(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    count = lambda df: df.groupBy(F.col("event_type").alias("counter")).agg(F.count(F.lit(1)).alias("value"))
    return analytics.counter_deltas(count(e.where("value > 50")), count(e))


def _collectives(spark, sf_dir):
    """Orders read as workers that take part in three collectives each."""
    o = t.table(spark, sf_dir, "orders")
    at = F.col("o_orderkey") % 8
    rows = o.select(F.floor(F.col("o_orderkey") / 8).alias("run"), at.cast("int").alias("worker_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    stamp = lambda k, v: F.struct(F.concat(F.lit("iter_"), F.col("i").cast("string"), F.lit(k)).alias("key"), v.cast("long").alias("ms"))
    both = F.array(stamp("_start", 100 * F.col("i") + F.col("worker_id")), stamp("_broadcast_end", 100 * F.col("i") + 20 + F.col("worker_id") * F.col("i")))
    return rows.select("run", "worker_id", F.explode(both).alias("x")).select("run", "worker_id", "x.key", "x.ms")


@query("with w as (select o_orderkey // 8 run, max(o_orderkey % 8) hi, min(o_orderkey % 8) lo from orders group by 1) select run, 20 + hi - lo as latency_median_ms from w")
def collective_probe(spark, sf_dir):
    return analytics.collective_latency(_collectives(spark, sf_dir), "broadcast")


@query("with w as (select o_orderkey // 8 run, max(o_orderkey % 8) hi, min(o_orderkey % 8) lo, count(*) n from orders group by 1) select run, 50 + 2 * hi - lo as duration_ms, round(cast(1048576 * 10 * (n // 2) as double) / ((50 + 2 * hi - lo) / 1000.0::double) / 1048576, 4) as throughput_mb_s from w")
def point_to_point_probe(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    at = F.col("o_orderkey") % 8
    both = F.array(F.struct(F.lit("ptp_start").alias("key"), at.alias("ms")), F.struct(F.lit("ptp_end").alias("key"), (50 + 2 * at).alias("ms")))
    e = o.select(F.floor(F.col("o_orderkey") / 8).alias("run"), at.cast("int").alias("worker_id"), F.explode(both).alias("x")).select("run", "worker_id", "x.key", "x.ms")
    return analytics.point_to_point(e, 1 << 20, 10, pairs=True)


_CELLS = """cells as (select algorithm, nodes, backend, threads, ranks, rep from (values ('bfs'), ('sssp')) a(algorithm), (values (10000::bigint), (100000)) n(nodes),
(values ('standalone', 1, null::int), ('rayon', 2, null), ('rayon', 4, null), ('mpi', null, 2), ('mpi', null, 4)) k(backend, threads, ranks), (values (0), (1)) r(rep))"""


@query(f"with {_CELLS}, done as (select distinct ['standalone', 'rayon', 'mpi', 'burst'][o_orderkey % 4 + 1] backend, cast(power(10, 4 + o_custkey % 3) as bigint) nodes from orders where o_orderstatus <> 'F' and o_orderkey % 4 < 2) select c.* from cells c left join done d using (backend, nodes) where d.backend is null")
def campaign_cells(spark, sf_dir):
    """A comparison's runs without those that have a passed record."""
    names = spark.range(2).select(F.when(F.col("id") == 0, "bfs").otherwise("sssp").alias("algorithm"))
    cells = analytics.cost_cells(names, [10_000, 100_000], [2, 4], [2, 4], 2)
    done = t.runs(spark, sf_dir).where("backend in ('standalone', 'rayon')").select("backend", "nodes", "status")
    return analytics.cells_to_run(cells, done)


@query("select o_orderkey as run, cast(p.range as int) as partition, cast(p.range // 2 as int) as \"group\" from orders, range(6) p where p.range < o_orderkey % 6 + 1")
def run_payloads(spark, sf_dir):
    runs = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"))
    return analytics.payloads(runs, F.col("run") % 6 + 1, F.lit(2))


# reports


@query(f"with recursive {t.BFS} select count(*) as reachable, coalesce(max(level), 0) as max_level from r")
def reach_summary(spark, sf_dir):
    return tr.reach_summary(bfs_levels(spark, sf_dir), "level")


@query(f"with recursive {t.SSSP} select count(*) as reachable, coalesce(max(d), 0) as max_distance from r")
def distance_summary(spark, sf_dir):
    return tr.reach_summary(sssp_distances(spark, sf_dir), "distance")


@query(f"with {t.pagerank_ctes(5)} select round(max(r), 9) as max_rank, round(sum(r), 9) as sum_rank from p5")
def rank_summary(spark, sf_dir):
    ranks, _ = pr.pagerank(t.part_graph(spark, sf_dir), max_iter=5, tol=0.0)
    return pr.rank_summary(ranks).select(F.round("max_rank", 9).alias("max_rank"), F.round("sum_rank", 9).alias("sum_rank"))


@query(f"with x as ({t.lp_sql(5, True)}) select count(label) as labeled, count(distinct label) as labels from x")
def label_summary(spark, sf_dir):
    return lp.label_summary(lp_seeded(spark, sf_dir))


@query(f"with recursive {t.BFS} select level, count(*) as count from r group by 1 order by 1 limit 20")
def level_distribution(spark, sf_dir):
    return reports.distribution(bfs_levels(spark, sf_dir), "level")


@query(f"with x as ({t.lp_sql(5, True)}) select label, count(*) as count from x where label is not null group by 1 order by 1 limit 20")
def label_distribution(spark, sf_dir):
    return reports.distribution(lp_seeded(spark, sf_dir), "label")


@query(f"with x as ({t.lp_sql(5, True)}) select id, label from x order by id limit 20")
def first_vertices(spark, sf_dir):
    return reports.first_rows(lp_seeded(spark, sf_dir))


@query(f"with recursive {t.SSSP}, b as (select max(d) / 10 w from r) select coalesce(cast(least(floor(d / w), 9) as int), -1) as bucket, count(*) as count from v left join r using (id), b group by 1")
def distance_histogram(spark, sf_dir):
    return reports.histogram(sssp_distances(spark, sf_dir), "distance")


@query("with b as (select max(p_retailprice) / 10 w from part) select cast(least(floor(p_retailprice / w), 9) as int) as bucket, count(*) as count from part, b group by 1")
def value_histogram(spark, sf_dir):
    return reports.histogram(t.table(spark, sf_dir, "part").withColumn("v", F.col("p_retailprice")), "v")


# validators


@query(f"with recursive {t.BFS}, c as (select id, level from r where level <= 3) select id, r.level as a, c.level as b from r left join c using (id) where c.id is null")
def vector_mismatches(spark, sf_dir):
    return validate.mismatches(bfs_levels(spark, sf_dir), bfs_capped(spark, sf_dir), "level").select("id", "a", "b")


@query("select p_partkey as id from part where p_partkey % 7 = 0 and p_retailprice > 0")
def tolerance_check(spark, sf_dir):
    part = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    moved = part.withColumn("v", F.col("v") * F.when(F.col("id") % 7 == 0, 1.001).otherwise(1 + 1e-9))
    return validate.far_apart(part, moved, "v").select("id")


@query("with a as (select distinct p_brand x, p_partkey % 3 y from part) select 'a' as side, cast(hash_id as bigint) as label, count(*) as partners from (select distinct cast(replace(x, 'Brand#', '') as bigint) hash_id, y from a) group by 2 having count(*) > 1 union all select 'b', y, count(*) from a group by 2 having count(*) > 1")
def partition_conflicts(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("id"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("long").alias("label"))
    return validate.partition_conflicts(a, part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("label")))


@query(f"""with x as ({t.lp_sql(2, True)}), {t.PARTS},
c as (select e.src id, x.label lab, count(*) n from e join x on x.id = e.dst where x.label is not null group by 1, 2),
m as (select id, lab from c qualify row_number() over (partition by id order by n desc, lab) = 1)
select x.id, case when x.label is null then 'coverage' else 'majority' end as rule from x join m using (id) where x.id % 10 <> 0 and x.label is distinct from m.lab""")
def fixed_point_violations(spark, sf_dir):
    graph, seeds = t.part_graph(spark, sf_dir), t.seeds(spark, sf_dir)
    found, _ = lp.label_propagation(graph, seeds, max_iter=2)
    return lp.fixed_point_violations(graph, found, seeds)


@query(f"with x as ({t.lp_sql(5, True)}) select round(avg(case when x.label is not distinct from p_partkey % 4 then 1.0::double else 0 end), 9) as accuracy, 0::bigint as seed_violations from part join x on x.id = p_partkey")
def label_accuracy(spark, sf_dir):
    truth = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("label"))
    out = validate.label_accuracy(lp_seeded(spark, sf_dir), truth, t.seeds(spark, sf_dir))
    return out.select(F.round("accuracy", 9).alias("accuracy"), "seed_violations")


@query(f"with {t.PARTS}, u as (select src id from e union select dst from e) select id, 'missing' as problem from v where id not in (select id from u)")
def missing_vertices(spark, sf_dir):
    graph = t.part_graph(spark, sf_dir)
    return validate.missing_ids(graph.vertices, g.endpoints(graph.edges))


# run analytics


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 7) for c in columns})


_STATS = f"""{t.RUNS}, ok as (select * from runs where ms > 0),
ranked as (select *, row_number() over (partition by backend, nodes order by ms) k, count(*) over (partition by backend, nodes) n from ok)"""
_SUMMARY = f"""{_STATS}, summary as (select backend, nodes, count(*) n_samples, avg(ms) mean, median(ms) median, case when count(*) >= 2 then stddev_samp(ms) / avg(ms) * 100 else 0 end cv, min(ms) min, max(ms) max, max(case when k = greatest(1, round_even(n * 0.95::double, 0)) then ms end) p95 from ranked group by 1, 2)"""


@query(f"with {_SUMMARY} select backend, nodes, n_samples, round(mean, 7) as mean, round(median, 7) as median, round(cv, 7) as cv, round(min, 7) as min, round(max, 7) as max, round(p95, 7) as p95 from summary")
def run_statistics(spark, sf_dir):
    return _rounded(analytics.summarise(t.runs(spark, sf_dir), ["backend", "nodes"]), "mean", "median", "cv", "min", "max", "p95")


_GROUPED = f"{t.RUNS}, gm as (select backend, nodes, ranks, avg(ms) mean, coalesce(stddev_pop(ms), 0) std, count(*) runs from runs where status = 'passed' group by 1, 2, 3)"


@query(f"with {_GROUPED} select backend, nodes, ranks, round(mean, 7) as mean, round(std, 7) as std, runs from gm")
def run_group_means(spark, sf_dir):
    return _rounded(analytics.grouped_mean(t.runs(spark, sf_dir), ["backend", "nodes", "ranks"]), "mean", "std")


@query(f"with {_GROUPED} select backend, nodes, ranks as best_ranks, round(mean, 7) as best_mean from gm qualify row_number() over (partition by backend, nodes order by mean, ranks) = 1")
def best_configuration(spark, sf_dir):
    means = analytics.grouped_mean(t.runs(spark, sf_dir), ["backend", "nodes", "ranks"])
    return _rounded(analytics.best_config(means, ["backend", "nodes"], "ranks"), "best_mean")


@query(f"with {_SUMMARY}, b as (select nodes, backend, median from summary qualify row_number() over (partition by nodes order by median, backend) = 1) select b.nodes, b.backend as best_backend, round(b.median, 7) as best_median, round(s.median / b.median, 7) as speedup from b left join summary s on s.nodes = b.nodes and s.backend = 'standalone'")
def backend_speedups(spark, sf_dir):
    s = analytics.summarise(t.runs(spark, sf_dir), ["backend", "nodes"])
    return _rounded(analytics.speedup_over(s, "standalone", ["nodes"]), "best_median", "speedup")


@query(f"with {_SUMMARY} select a.backend, min(case when a.median < s.median then a.nodes end) as crossover from summary a join summary s on s.nodes = a.nodes and s.backend = 'standalone' where a.backend <> 'standalone' group by 1")
def backend_crossover(spark, sf_dir):
    return analytics.crossover(analytics.summarise(t.runs(spark, sf_dir), ["backend", "nodes"]), "standalone")


@query(f"with {t.RUNS}, a as (select nodes, min(m) best from (select nodes, backend, median(ms) m from runs where backend in ('standalone', 'rayon') group by 1, 2) group by 1), d as (select nodes, ranks, median(ms) m from runs where backend = 'mpi' group by 1, 2) select d.nodes, round(any_value(best), 7) as best_vertical, min(case when m <= best then ranks end) as cost from d join a using (nodes) group by 1")
def cost_to_match(spark, sf_dir):
    r = t.runs(spark, sf_dir)
    vertical = analytics.summarise(r.where("backend in ('standalone', 'rayon')"), ["nodes", "backend"])
    distributed = analytics.summarise(r.where("backend = 'mpi'"), ["nodes", "ranks"])
    return _rounded(analytics.cost_metric(vertical, distributed, ["nodes"]), "best_vertical")


def _traces(spark, sf_dir):
    """Orders read as workers of runs, eight each, with one traced iteration."""
    o = t.table(spark, sf_dir, "orders")
    at = F.col("o_orderkey") % 8
    stamps = [("worker_start", at), ("get_input", 10 + at), ("get_input_end", 20 + 2 * at), ("iter_0_start", 40 + at), ("iter_0_compute", 60 + at), ("iter_0_reduce", 70 + at), ("iter_0_broadcast", 71 + at), ("worker_end", 90 + 3 * at)]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in stamps], F.struct(F.lit("noise").alias("key"), F.lit("x").alias("value")))
    return o.select(F.floor(F.col("o_orderkey") / 8).alias("run"), at.cast("int").alias("worker_id"), entries.alias("timestamps"))


@query("""with w as (select o_orderkey // 8 run, o_orderkey % 8 a from orders),
r as (select run, count(*) workers, min(a) lo, max(a) hi from w group by 1)
select run, workers, cast(lo + 5 as bigint) as cold_start_ms, hi - lo as stagger_ms, (20 + 2 * hi) - (10 + lo) as load_ms, 20 + hi - lo as compute_ms, cast(10 as bigint) as reduce_ms, cast(1 as bigint) as broadcast_ms, cast(11 as bigint) as communication_ms, 90 + 3 * hi - lo as warm_total_ms, cast(505 as bigint) as host_total_ms, 90 + 3 * hi - (40 + lo) as span_ms, cast(null as bigint) as write_ms, cast(1 as bigint) as iterations from r""")
def phase_breakdown(spark, sf_dir):
    return _phases(_traces(spark, sf_dir))


def _phases(traces):
    submitted = traces.select("run").distinct().withColumns({"submit_ms": F.lit(-5).cast("long"), "finish_ms": F.lit(500).cast("long")})
    return analytics.phase_breakdown(analytics.trace_events(traces), submitted)


@query("with x as (select o_orderkey run, ['bfs', 'sssp', 'pagerank', 'labelpropagation'][o_orderkey % 4 + 1] algorithm, o_custkey n, o_orderkey % 5 w, o_orderkey % 7 k from orders) select run, algorithm, case when w <= 1 or k = 0 then 0 else (w - 1) * (n + 1) * 4 * k + case when algorithm = 'labelpropagation' then (w - 1) * 4 + (w - 1) * n * 4 else 0 end end as reduce_bytes, 2 * case when w <= 1 or k = 0 then 0 else (w - 1) * (n + 1) * 4 * k + case when algorithm = 'labelpropagation' then (w - 1) * 4 + (w - 1) * n * 4 else 0 end end as total_bytes from x")
def logical_traffic(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("bfs", "sssp", "pagerank", "labelpropagation")])
    k = F.col("o_orderkey")
    rows = t.table(spark, sf_dir, "orders").select(k.alias("run"), F.get(names, (k % 4).cast("int")).alias("algorithm"), F.col("o_custkey").alias("n"), (k % 5).alias("w"), (k % 7).alias("k"))
    b = rows.withColumn("b", analytics.traffic_bytes(F.col("algorithm"), F.col("n"), F.col("w"), F.col("k")))
    return b.select("run", "algorithm", "b.reduce_bytes", "b.total_bytes")


@query(f"with {t.RUNS} select run, round(case when ms <> 0 then (ms * 2 + 1) / ms end, 7) as algorithmic, case when nodes > 10000 then 'total' else 'span' end as primary_metric, case when coalesce(case when nodes > 10000 then (ms * 3) / (ms + 100) end, (ms * 2 + 1) / ms) > 1 then 'Burst' else 'Standalone' end as winner from runs")
def run_speedups(spark, sf_dir):
    ms = F.col("ms")
    rows = t.runs(spark, sf_dir).select("run", (ms * 2 + 1).alias("base_exec_ms"), F.when(F.col("nodes") > 10000, ms * 3).alias("base_total_ms"), ms.alias("algo_ms"), (ms + 50).alias("warm_ms"), (ms + 100).alias("host_ms"))
    return _rounded(analytics.speedups(rows), "algorithmic").select("run", "algorithmic", "primary_metric", "winner")


@query(f"with {t.RUNS} select run, round(case when run % 3 <> 0 then ms / (run % 3) end, 7) as cold_over_warm, round(case when run % 3 <> 0 then (run % 3) / 2.0::double end, 7) as warm_over_subtotal from runs")
def warm_pool_ratios(spark, sf_dir):
    rows = t.runs(spark, sf_dir).select("run", F.col("ms").alias("cold_e2e_ms"), (F.col("run") % 3).cast("double").alias("warm_e2e_median_ms"), F.lit(2.0).alias("warm_subtotal_median_ms"))
    return _rounded(analytics.warm_pool(rows), "cold_over_warm", "warm_over_subtotal").select("run", "cold_over_warm", "warm_over_subtotal")


@query(f"with {t.RUNS} select backend as mode, ranks as granularity, count(*) as runs, round(avg(ms), 7) as mean_host_total_ms, round(avg(case when run % 2 = 0 then ms end), 7) as mean_startup_median_ms, round(avg(ms / 2), 7) as mean_stagger_ms from runs group by 1, 2")
def probe_summary(spark, sf_dir):
    rows = t.runs(spark, sf_dir).select(F.col("backend").alias("mode"), F.col("ranks").alias("granularity"), F.col("ms").alias("host_total_ms"), F.when(F.col("run") % 2 == 0, F.col("ms")).alias("startup_median_ms"), (F.col("ms") / 2).alias("stagger_ms"))
    return _rounded(analytics.probe_summary(rows), "mean_host_total_ms", "mean_startup_median_ms", "mean_stagger_ms")


@query(f"with {t.RUNS} select run, round(ms * 0.5 + ms, 7) as warm_total_ms, round(greatest(0, 2 * ms - 1 - ms * 1.5), 7) as cold_start_ms, round(ms, 7) as span_ms from runs")
def spark_run_phases(spark, sf_dir):
    ms = F.col("ms")
    rows = t.runs(spark, sf_dir).select("run", (ms * 0.5).alias("load_ms"), ms.alias("compute_ms"), F.lit(None).cast("double").alias("write_ms"), (2 * ms - 1).alias("total_ms"))
    return _rounded(analytics.spark_phases(rows), "warm_total_ms", "cold_start_ms", "span_ms").select("run", "warm_total_ms", "cold_start_ms", "span_ms")


@query("select run, list_sort(list(a))[len(list(a)) // 2 + 1] as startup_median_ms, max(a) - min(a) as stagger_ms, cast(500 as bigint) as host_total_ms from (select o_orderkey // 8 run, o_orderkey % 8 a from orders) group by 1")
def startup_probe(spark, sf_dir):
    return _startup(_traces(spark, sf_dir))


def _startup(traces):
    submitted = traces.select("run").distinct().withColumns({"submit_ms": F.lit(0).cast("long"), "finish_ms": F.lit(500).cast("long")})
    return analytics.startup_summary(analytics.trace_events(traces), submitted)


@query("select p_partkey as id, array_to_string(list_filter(range(1, p_size + 1), lambda d: p_size % d = 0), ',') as divisors, p_size * 1 + 6 <= 32 and p_size * 2048 + 8192 <= 65536 as fits from part")
def resource_plans(spark, sf_dir):
    size = F.col("p_size")
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(analytics.divisors(size), lambda d: d.cast("string")), ",").alias("divisors"), analytics.fits(size, F.lit(1), F.lit(2048), 32, 65536).alias("fits"))


# generators and table preparation


_IDS = "(select unnest(range((select count(*) from part))) i)"


def _size(spark, sf_dir):
    return t.table(spark, sf_dir, "part").count()


@query(f"select i as src, (i + 1) % (select count(*) from part) as dst from {_IDS}")
def ring_graph(spark, sf_dir):
    return generate.ring(spark, _size(spark, sf_dir))


@query(f"select i as src, i + 1 as dst from {_IDS} where i + 1 < (select count(*) from part)")
def path_graph(spark, sf_dir):
    return generate.path(spark, _size(spark, sf_dir))


@query(f"select 0 as src, i as dst from {_IDS} where i > 0")
def star_graph(spark, sf_dir):
    return generate.star(spark, _size(spark, sf_dir))


@query(f"select i as src, i + 1 as dst from {_IDS} where i + 1 < (select count(*) from part) and i + 1 <> (select count(*) // 2 from part)")
def two_paths_graph(spark, sf_dir):
    return generate.two_paths(spark, _size(spark, sf_dir))


@query(f"with n as (select count(*) n from part) select i as src, i as dst from {_IDS} union all select i, i + 1 from {_IDS}, n, range(2) where i + 1 < n union all select 0, n // 2 from n, range(2)")
def repeated_edges_graph(spark, sf_dir):
    return generate.loops_and_repeats(spark, _size(spark, sf_dir))


@query(f"select i as src, (i + j.range) % (select count(*) from part) as dst from {_IDS}, range(1, 5) j")
def seeded_ring_edges(spark, sf_dir):
    return generate.seeded_ring(spark, _size(spark, sf_dir), 4)[0]


@query(f"select i as id, least(i // (select count(*) // 4 from part), 3) * 100 as label from {_IDS} where i % 10 = 0")
def seeded_ring_seeds(spark, sf_dir):
    return generate.seeded_ring(spark, _size(spark, sf_dir), 4)[1]


@query(f"with n as (select count(*) n, cast(ceil(sqrt(count(*))) as bigint) s from part) select i as src, i + 1 as dst from {_IDS}, n where i % s < s - 1 and i + 1 < n union all select i, i + s from {_IDS}, n where i + s < n")
def grid_graph(spark, sf_dir):
    return generate.grid(spark, _size(spark, sf_dir))


@query(f"select i as src, (i // 20 + 1) * 20 + j.range as dst from {_IDS}, range(20) j where i // 20 + 1 < (select count(*) // 20 from part)")
def layered_graph(spark, sf_dir):
    return generate.layered(spark, _size(spark, sf_dir) // 20, 20)


@query("with n as (select cast(floor(sqrt(count(*))) as bigint) n from part), v as (select unnest(range(n)) i from n) select a.i as src, b.i as dst from v a, v b where a.i <> b.i")
def complete_graph(spark, sf_dir):
    """About as many edges as there are parts."""
    return generate.complete(spark, int(_size(spark, sf_dir) ** 0.5))


@query(f"""with n as (select count(*) n from part), d as (select i, unnest(range(10)) j from {_IDS})
select i as src, (i + 1 + cast(floor({generate.uniform_sql(42, 'i', 'j')} * (n - 1)) as bigint)) % n as dst, 0.1::double + 9.9::double * {generate.uniform_sql(43, 'i', 'j')} as weight from d, n""")
def random_graph(spark, sf_dir):
    return generate.random_digraph(spark, _size(spark, sf_dir), 10, weight=(0.1, 10.0))


def _drawn_sql(candidates: str, p: str, seed: int) -> str:
    """Pairs ``src, at``: gaps drawn one after another up to the candidates."""
    draws = f"cast(ceil({candidates} * {p} + 10 * sqrt({candidates} * {p}) + 10) as bigint)"
    gap = f"cast(floor(ln({generate.uniform_sql(seed, 'i', 'j')}) / ln(1 - {p})) as bigint) + 1"
    return f"select i as src, m, sum({gap}) over (partition by i order by j) pos from (select i, n, {candidates} m, unnest(range(1, {draws} + 1)) j from x)"


_COMMUNITIES = f"""n as (select count(*) n from part), g as (select n, least(i // 50, n // 50 - 1) g, i from {_IDS}, n where i < n - 1),
x as (select i, n, case when g = n // 50 - 1 then n - 1 else g * 50 + 49 end hi from g)"""


@query(f"with {_COMMUNITIES}, a as ({_drawn_sql('(hi - i)', '0.3::double', 42)}), b as ({_drawn_sql('(n - 1 - hi)', '(2.0::double / n)', 43)}) select src, src + cast(pos as bigint) as dst from a where pos <= m union all select b.src, x.hi + cast(pos as bigint) from b join x on x.i = b.src where pos <= m")
def community_graph(spark, sf_dir):
    n = _size(spark, sf_dir)
    return generate.planted_communities(spark, n, n // 50, 0.3, 2.0 / n)


@query(f"with n as (select count(*) n from part), x as (select i, n from {_IDS}, n where i < n - 1), a as ({_drawn_sql('(n - 1 - i)', '(4.0::double / n)', 42)}) select src, src + cast(pos as bigint) as dst from a where pos <= m")
def erdos_renyi_graph(spark, sf_dir):
    n = _size(spark, sf_dir)
    return generate.erdos_renyi(spark, n, 4.0 / n)


@query(f"select i as id, 10::bigint as neighbours, 10::bigint as distinct_ones, 0::bigint as loops from {_IDS}")
def distinct_digraph_check(spark, sf_dir):
    """Draws are different for each vertex and never the vertex itself."""
    e = generate.distinct_digraph(spark, _size(spark, sf_dir), 10)
    return e.groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("neighbours"), F.count_distinct("dst").alias("distinct_ones"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


@query("select 2 * count(*) as edges, 2 * count(*) as distinct_ones, 0::bigint as loops, true as rewired from part")
def small_world_check(spark, sf_dir):
    """Rewiring keeps the number of edges and makes neither repeats nor loops."""
    e = generate.small_world(spark, _size(spark, sf_dir))
    near = F.least(F.col("dst") - F.col("src"), _size(spark, sf_dir) - (F.col("dst") - F.col("src"))) <= 2
    return e.agg(F.count("src").alias("edges"), F.count_distinct("src", "dst").alias("distinct_ones"), F.count_if(F.col("src") >= F.col("dst")).alias("loops"), (F.count_if(~near) > 0.2 * F.count("src")).alias("rewired"))


@query("with n as (select count(*) n from part) select cast(k as bigint) as label, case when k < 3 then (n // 10) // 4 else n // 10 - 3 * ((n // 10) // 4) end as seeds from n, range(4) t(k)")
def balanced_seed_counts(spark, sf_dir):
    ids = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return generate.balanced_seeds(ids, 4, 0.1).groupBy("label").agg(F.count_distinct("id").alias("seeds"))


@query("select count(*) as users, true as distinct_items, true as in_range from customer")
def ratings_check(spark, sf_dir):
    users = t.table(spark, sf_dir, "customer").count()
    r = generate.ratings(spark, users, 500, 20.0)
    return r.agg(F.count_distinct("user").alias("users"), (F.count("item") == F.count_distinct("user", "item")).alias("distinct_items"), ((F.min("rating") >= 1) & (F.max("rating") <= 5) & (F.max("item") < 500)).alias("in_range"))


@query("select count(*) as rows, count(*) as distinct_rows from part")
def shuffled_rows(spark, sf_dir):
    part = t.table(spark, sf_dir, "part").select("p_partkey")
    out = generate.shuffled_subset(part, ["p_partkey"], part.count())
    return out.agg(F.count("p_partkey").alias("rows"), F.count_distinct("p_partkey").alias("distinct_rows"))


@query("with a as (select distinct user_id u from events), b as (select distinct event_type t from events), x as (select u, row_number() over (order by u) - 1 k from a), y as (select t, row_number() over (order by t) - 1 k from b) select event_id, x.k as user_id from events join x on x.u = user_id")
def dense_user_ids(spark, sf_dir):
    return tables.dense_ids(t.table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")


_EDGES = "select list_sort(list_distinct(quantile_cont(p_retailprice, list_transform(range(1, 16), lambda i: i / 16.0::double)))) q from part"


@query(f"with b as ({_EDGES}) select p_partkey as id, cast(len(list_filter(q, lambda e: e <= p_retailprice)) as int) as bin from part, b")
def quantile_bins(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    edges = tables.bin_edges(part, "p_retailprice", 15)
    return part.crossJoin(F.broadcast(edges)).select(F.col("p_partkey").alias("id"), tables.digitize(F.col("p_retailprice"), F.col("edges")).alias("bin"))


@query("select event_type, count(*) as count from events group by 1")
def class_distribution(spark, sf_dir):
    return tables.class_distribution(t.table(spark, sf_dir, "events"), "event_type")


@query("with d as (select c_custkey id, count(o_orderkey) d from customer left join orders on o_custkey = c_custkey group by 1) select id, cast(sum(d) over (order by id) - d as bigint) as start, cast(sum(d) over (order by id) as bigint) as \"end\" from d")
def sparse_row_pointers(spark, sf_dir):
    return tables.row_pointers(t.table(spark, sf_dir, "orders"), "o_custkey", t.table(spark, sf_dir, "customer").count())
