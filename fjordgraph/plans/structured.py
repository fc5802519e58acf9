"""Queries on the order graph, and certificates and comparisons of results.

The order graph has long paths, a component for each customer and many vertices without
a way on, which the part graph has not.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import certificates, generate, reports, validate
from ..operators import graph as g
from ..operators import labels as lp
from ..operators import pagerank as pr
from ..operators import traversal as tr
from ..operators.components import connected_components as cc
from ..operators.pregel import aggregate_messages
from ..sources import edges as io
from ..sources import records
from ..storage import shared_dir
from ..streaming.incremental import Incremental
from . import tables as t
from .registry import query

_BFS = t.on_orders(t.BFS)
_SSSP = t.on_orders(t.SSSP)
_COMPONENTS = t.on_orders(t.COMPONENTS)
CAP = 4


@query(f"with recursive {_BFS} select v.id, r.level from v left join r using (id)")
def bfs_orders(spark, sf_dir):
    return tr.bfs(t.order_graph(spark, sf_dir), t.first_order(spark, sf_dir))[0]


@query(f"with recursive {_BFS} select v.id, case when r.level <= {CAP} then r.level end as level from v left join r using (id)")
def bfs_orders_capped(spark, sf_dir):
    return tr.bfs(t.order_graph(spark, sf_dir), t.first_order(spark, sf_dir), max_levels=CAP)[0]


@query(f"with recursive {_SSSP} select v.id, r.d as distance from v left join r using (id)")
def sssp_orders(spark, sf_dir):
    return tr.sssp(t.order_graph(spark, sf_dir, weighted=True), t.first_order(spark, sf_dir))[0]


@query(f"with recursive {_BFS} select count(r.id) as reachable, max(r.level) as max_level from r")
def reach_orders(spark, sf_dir):
    return tr.reach_summary(bfs_orders(spark, sf_dir), "level")


@query(t.on_orders(t.lp_sql(4, False)))
def lp_orders(spark, sf_dir):
    return lp.label_propagation(t.order_graph(spark, sf_dir), max_iter=4)[0]


@query(f"with {t.on_orders(t.pagerank_ctes(8))} select id, round(r, 9) as rank from p8")
def pagerank_orders(spark, sf_dir):
    ranks, _ = pr.pagerank(t.order_graph(spark, sf_dir), max_iter=8, tol=0.0)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


def _components(spark, sf_dir):
    return cc(t.order_graph(spark, sf_dir).edges)


@query(f"with recursive {_COMPONENTS} select id, m as component from r")
def components_orders(spark, sf_dir):
    return _components(spark, sf_dir)


@query(f"with recursive {_COMPONENTS} select count(distinct m) as components from r")
def component_count_orders(spark, sf_dir):
    return reports.component_count(_components(spark, sf_dir))


@query(f"with recursive {_COMPONENTS}, {t.digest_ctes('select id, m as label from r')} select digest from digested")
def partition_digest_orders(spark, sf_dir):
    return reports.partition_digest(_components(spark, sf_dir), "component")


@query(f"with {t.ORDERS} select id from v where id not in (select src from e)")
def dangling_orders(spark, sf_dir):
    return g.dangling(t.order_graph(spark, sf_dir))


@query("with e as (select o_orderkey src, l_partkey dst from orders join lineitem on l_orderkey = o_orderkey) select src, dst from e where src in (select p_partkey from part) and dst in (select p_partkey from part)")
def edges_within_vertices(spark, sf_dir):
    """Orders' lines read as edges, of which only those between ids of parts stay."""
    rows = t.table(spark, sf_dir, "orders").join(t.table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    parts = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return g.Graph(rows.select(F.col("o_orderkey").alias("src"), F.col("l_partkey").alias("dst")), vertices=parts).edges


@query(f"with {t.ORDERS}, u as (select src id from e union select dst from e) select id, 'missing' as problem from v where id not in (select id from u)")
def missing_orders(spark, sf_dir):
    """Customers' only orders are in no edge."""
    graph = t.order_graph(spark, sf_dir)
    return validate.missing_ids(graph.vertices, g.endpoints(graph.edges))


@query(f"with recursive {_BFS} select v.id, r.level as a, case when r.level <= {CAP} then r.level end as b from v join r using (id) where r.level > {CAP}")
def mismatches_orders(spark, sf_dir):
    return validate.mismatches(bfs_orders(spark, sf_dir), bfs_orders_capped(spark, sf_dir), "level").select("id", "a", "b")


# certificates of results with planted faults


@query(f"""with recursive {_BFS}, x as (select v.id, case when v.id % 50 = 7 then r.level + 1 when v.id % 50 = 8 then greatest(r.level - 1, 0) when v.id % 50 = 9 then null when v.id % 500 = 10 then coalesce(r.level, 3) else r.level end as level from v left join r using (id) where v.id % 200 <> 11),
ed as (select distinct e.dst id from e join x a on a.id = e.src join x b on b.id = e.dst where a.level is not null and (b.level is null or b.level > a.level + 1)),
su as (select distinct e.dst id from e join x a on a.id = e.src join x b on b.id = e.dst where b.level = a.level + 1)
select id, 'missing' as rule from v where id % 200 = 11 union all
select x.id, 'source' from x join s0 using (id) where level is distinct from 0 union all
select id, 'edge' from ed where id not in (select id from s0) union all
select id, 'predecessor' from x where level is not null and id not in (select id from ed) and id not in (select id from su) and id not in (select id from s0)""")
def bfs_certificate(spark, sf_dir):
    """Some levels are one too high, one too low, gone or made up, some rows missing."""
    graph, source = t.order_graph(spark, sf_dir), t.first_order(spark, sf_dir)
    k, level = F.col("id") % 50, F.col("level")
    bad = F.when(k == 7, level + 1).when(k == 8, F.greatest(level - 1, F.lit(0))).when(k == 9, F.lit(None)).when(F.col("id") % 500 == 10, F.coalesce(level, F.lit(3))).otherwise(level)
    found = tr.bfs(graph, source)[0].where("id % 200 <> 11").select("id", bad.alias("level"))
    return certificates.bfs_violations(graph, found, source)


@query(f"""with recursive {_SSSP}, x as (select v.id, case when v.id % 5 = 1 then r.d + 0.5 when v.id % 5 = 2 then r.d - 0.5 when v.id % 5 = 3 then null else r.d end as d from v left join r using (id)),
ed as (select distinct w.dst id from w join x a on a.id = w.src join x b on b.id = w.dst where a.d is not null and (b.d is null or b.d > a.d + w.weight)),
su as (select distinct w.dst id from w join x a on a.id = w.src join x b on b.id = w.dst where b.d = a.d + w.weight)
select x.id, 'source' as rule from x join s0 using (id) where d is distinct from 0 union all
select id, 'edge' from ed where id not in (select id from s0) union all
select id, 'predecessor' from x where d is not null and id not in (select id from ed) and id not in (select id from su) and id not in (select id from s0)""")
def sssp_certificate(spark, sf_dir):
    graph, source = t.order_graph(spark, sf_dir, weighted=True), t.first_order(spark, sf_dir)
    k, d = F.col("id") % 5, F.col("distance")
    bad = F.when(k == 1, d + 0.5).when(k == 2, d - 0.5).when(k == 3, F.lit(None)).otherwise(d)
    return certificates.sssp_violations(graph, tr.sssp(graph, source)[0].select("id", bad.alias("distance")), source)


@query(f"""with {t.pagerank_ctes(6)} select round(sum(a.r), 9) as total, round(sum(abs(b.r - a.r)), 9) as residual, round(max(abs(b.r - a.r)), 9) as greatest, round(sum(abs(b.r - a.r)) / 0.15::double, 8) as error_bound, 0::bigint as unlike from p5 a join p6 b using (id)""")
def pagerank_certificate(spark, sf_dir):
    """How far five rounds are from the end."""
    graph = t.part_graph(spark, sf_dir)
    ranks, _ = pr.pagerank(graph, max_iter=5, tol=0.0)
    found = certificates.pagerank_residual(graph, ranks)
    return found.select(*[F.round(c, 9).alias(c) for c in ("total", "residual", "greatest")], F.round("error_bound", 8).alias("error_bound"), "unlike")


# comparisons


_PAIR = "select o_orderkey id, o_custkey % 40 a, o_custkey % 60 b from orders"


@query(f"""with x as ({_PAIR}), c as (select a, b, count(*)::double n from x group by 1, 2), p as (select a, sum(n) n, max(n) most from c group by 1), q as (select b, sum(n) n from c group by 1),
k as (select sum(n) n, sum(n * (n - 1) / 2) same, count(*) cells from c), kp as (select sum(n * (n - 1) / 2) pa, count(*) labels_a, sum(n - most) moved from p), kq as (select sum(n * (n - 1) / 2) pb, count(*) labels_b from q),
vi as (select -sum(c.n * (ln(c.n / p.n) + ln(c.n / q.n))) v from c join p using (a) join q using (b))
select cast(n as bigint) as ids, 0::bigint as only_a, 0::bigint as only_b, labels_a, labels_b, cells, cast(moved as bigint) as moved, round((same - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 9) as adjusted_rand, round(v / n, 9) as variation from k, kp, kq, vi""")
def partition_comparison(spark, sf_dir):
    """Orders by two overlapping groups of customers."""
    rows = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("a"), (F.col("o_custkey") % 60).alias("b"))
    out = validate.compare_partitions(rows.select("id", F.col("a").alias("label")), rows.select("id", F.col("b").alias("label")))
    return out.withColumns({c: F.round(c, 9) for c in ("adjusted_rand", "variation")})


@query(f"with x as ({_PAIR}), fa as (select a, dense_rank() over (order by min(id)) - 1 k from x group by 1), fb as (select b, dense_rank() over (order by min(id)) - 1 k from x group by 1) select id, fa.k as a, fb.k as b from x join fa using (a) join fb using (b) where fa.k <> fb.k order by id limit 20")
def partition_differences(spark, sf_dir):
    """The first twenty orders that the two groups, renumbered, disagree about."""
    rows = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("a"), (F.col("o_custkey") % 60).alias("b"))
    return validate.partition_differences(rows.select("id", F.col("a").alias("label")), rows.select("id", F.col("b").alias("label")))


@query(f"select p_partkey, row_number() over (order by {generate.uniform_sql(42, 'p_partkey')}, p_partkey) - 1 as place from part qualify place < (select count(*) // 3 from part)")
def shuffled_third(spark, sf_dir):
    """A third of the parts, in random order."""
    part = t.table(spark, sf_dir, "part").select("p_partkey")
    return generate.shuffled_subset(part, ["p_partkey"], part.count() // 3)


# streams, logs and merges of one's own


def _streamed(spark, sf_dir, kind, weighted=False):
    """The order graph's edges as a stream of four files, each of them a batch."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    edges = t.order_graph(spark, sf_dir, weighted).edges
    edges.repartition(4, F.xxhash64("dst")).write.parquet(f"{folder}/edges")
    inc = Incremental(spark, f"{folder}/state", kind, None if kind == "components" else t.first_order(spark, sf_dir))
    rows = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/edges")
    run = rows.writeStream.foreachBatch(inc.update).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return inc.result()


@query(f"with recursive {_BFS} select id, level from r")
def incremental_levels(spark, sf_dir):
    return _streamed(spark, sf_dir, "levels").select("id", F.col("value").alias("level"))


@query(f"with recursive {_SSSP} select id, d as distance from r")
def incremental_distances(spark, sf_dir):
    return _streamed(spark, sf_dir, "distances", weighted=True).select("id", F.col("value").alias("distance"))


@query(f"with recursive {_COMPONENTS} select id, m as component from r")
def incremental_components(spark, sf_dir):
    return _streamed(spark, sf_dir, "components").select("id", F.col("value").alias("component"))


@query("""with x as (select o_custkey % 50 as run, o_orderkey, o_orderkey % 3 f from orders)
select run, max(case when f = 0 then o_orderkey end) as order_key, max(case when f = 1 then o_orderkey % 1000 * 7 end) as duration from x group by 1""")
def scan_logs(spark, sf_dir):
    """Log files of fifty runs, a line per order: records, output with a duration, and
    lines that only look like records. The last record of each file counts."""
    path = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 3
    record = F.concat(F.lit("RESULT "), F.to_json(F.struct(key.alias("order_key"))))
    timing = F.concat(F.lit("timing {'duration': "), (key % 1000 * 7).cast("string"), F.lit(", 'end': 1}"))
    line = F.when(kind == 0, record).when(kind == 1, timing).otherwise(F.concat(F.lit("RESULT {broken "), key.cast("string")))
    lines = t.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("run"), "o_orderkey", line.alias("value"))
    lines.repartition("run").sortWithinPartitions("run", "o_orderkey").select("run", "value").write.partitionBy("run").text(path)
    log = records.read_log(spark, path)
    both = records.longest_durations(log).join(records.last_json_lines(log, "order_key long", "RESULT "), "file", "left")
    return both.select(F.regexp_extract("file", r"run=(\d+)", 1).cast("long").alias("run"), "order_key", "duration")


_TEXTS = ("2.5", "x", "NaN", "-1.5", "-inf")


@query(f"""with x as (select l_orderkey o, l_partkey p, l_linenumber k, [{", ".join(f"'{x}'" for x in _TEXTS)}][l_linenumber] w from lineitem),
l as (select case when k = 6 then cast(o as varchar) when k = 7 then 'a ' || p else o || ' ' || p || ' ' || w end line, ['', 'weight', 'not finite', 'negative', 'not finite', 'columns', 'source'][k] fault from x)
select fault, count(*) as lines, min(line) as least from l where fault <> '' group by 1""")
def scan_faults(spark, sf_dir):
    """Lines of lineitem as weighted edges, most of them with something wrong."""
    path = f"{shared_dir(spark)}/faults-{uuid.uuid4().hex}"
    o, p, k = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber")
    weight = F.get(F.array(*[F.lit(x) for x in _TEXTS]), (k - 1).cast("int"))
    line = F.when(k == 6, o).when(k == 7, F.concat(F.lit("a "), p)).otherwise(F.concat_ws(" ", o, p, weight))
    t.table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(path)
    return io.edge_faults(spark, path).groupBy("fault").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("least"))


@query(f"with {t.PARTS} select dst as id, list_reduce(list(src + 1), lambda a, b: gcd(a, b)) as msg from e group by 1")
def merge_by_function(spark, sf_dir):
    """Messages merged by a function that Spark has not: the greatest common divisor."""
    graph = t.part_graph(spark, sf_dir)
    return aggregate_messages(graph.vertices.withColumn("x", F.col("id") + 1), graph.edges, lambda s: int(np.gcd.reduce(s.to_numpy())), to_dst=F.col("src_x"), reads=("src",))
