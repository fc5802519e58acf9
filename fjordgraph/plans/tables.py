"""Graphs and run records derived from the driver's tables, in both languages.

All rows of the tables count: the part graph has every pair of parts that follow
one another on an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph, formula_weight, summary
from ..operators.ranks import running_total
from ..storage import cut

#: ``e`` is the part graph, ``v`` its dense domain, ``s0`` its source.
CHAIN = """chain as (select distinct src, dst from (select l_partkey src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) dst from lineitem) where dst is not null)"""
PARTS = CHAIN + """, e as materialized (select src, dst from chain), v as (select p_partkey id from part)"""
SOURCE = PARTS + """, s0 as (select src id from (select src, count(*) c from e group by src) order by c desc, src limit 1)"""
WEIGHTED = SOURCE + """, w as (select src, dst, cast(1 + (src * 31 + dst * 17 + 7) % 13 as double) weight from e)"""
BFS = SOURCE + """, r(id, level) using key (id) as (select id, 0 from s0 union select e.dst, min(r.level + 1) from r join e on e.src = r.id left join recurring.r x on x.id = e.dst where x.id is null group by e.dst)"""
SSSP = WEIGHTED + """, r(id, d) using key (id) as (select id, 0.0::double from s0 union select w.dst, min(r.d + w.weight) from r join w on w.src = r.id left join recurring.r x on x.id = w.dst where x.id is null or r.d + w.weight < x.d group by w.dst)"""
COMPONENTS = PARTS + """, u as (select src, dst from e union select dst, src from e), r(id, m) using key (id) as (select src, src from (select distinct src from u) union select u.dst, min(r.m) from r join u on u.src = r.id join recurring.r x on x.id = u.dst where r.m < x.m group by u.dst)"""
SEEDS = """seeds as (select p_partkey id, min(p_partkey % 4) label from part where p_partkey % 10 = 0 group by 1)"""
RUNS = """runs as (select o_orderkey run, ['standalone', 'rayon', 'mpi', 'burst'][o_orderkey % 4 + 1] backend, cast(power(10, 4 + o_custkey % 3) as bigint) nodes, cast(power(2, 1 + (o_orderkey // 4) % 4) as int) ranks, o_totalprice / 1000 ms, case when o_orderstatus = 'F' then 'failed' else 'passed' end status from orders)"""


#: Users that follow one another in time: repeated edges and self-loops.
MULTI = """e as materialized (select src, dst from (select user_id src, lead(user_id) over (order by ts, event_id) dst from events) where dst is not null), v as (select distinct user_id id from events)"""
#: Who bought from whom: bipartite, and suppliers have no out-edges.
TRADE = """e as materialized (select distinct o_custkey src, l_suppkey + (select count(*) from customer) dst from orders join lineitem on l_orderkey = o_orderkey), v as (select c_custkey id from customer union all select s_suppkey + (select count(*) from customer) from supplier)"""

#: An order leads to its customer's next one, an urgent one to the third from it too:
#: many components, long paths, ends without a way on, and vertices with two ways.
ORDERS = """ahead as (select o_orderkey src, lead(o_orderkey) over w a, case when o_orderpriority = '1-URGENT' then lead(o_orderkey, 3) over w end b from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)), e as materialized (select src, a dst from ahead where a is not null union all select src, b from ahead where b is not null), v as (select o_orderkey id from orders),
 s0 as (select min_by(o_orderkey, (o_orderdate, o_orderkey)) id from orders where o_custkey = (select o_custkey from orders group by 1 order by count(*) desc, 1 limit 1))"""
ORDERS_WEIGHTED = ORDERS + """, w as (select src, dst, cast(1 + (src * 31 + dst * 17 + 7) % 13 as double) weight from e)"""


def on_orders(ctes: str) -> str:
    """The same over the order graph."""
    return ctes.replace(WEIGHTED, ORDERS_WEIGHTED).replace(SOURCE, ORDERS).replace(PARTS, ORDERS)


def digest_ctes(labels: str) -> str:
    """``digested``: the digest of ``labels`` (``id, label``), serially in id order."""
    return f"""lab as ({labels}), firsts as (select label, dense_rank() over (order by min(id)) - 1 k from lab group by 1),
 listed as (select list(k + 1 order by id) ks, count(*) n from lab join firsts using (label)),
 digested as (select {" || ".join(f"lpad(format('{{:x}}', list_reduce(list_prepend(0::bigint, list_reverse(ks)), lambda h, x: (h * {f} + x) % 2147483647)), 8, '0')" for f in (48271, 69621))} || lpad(format('{{:x}}', n), 12, '0') as digest from listed)"""


def lp_ctes(rounds: int, seeded: bool, graph: str = PARTS) -> str:
    """Label propagation of a fixed number of rounds: ``l0 .. l<rounds>``."""
    if seeded:
        parts = [graph, SEEDS, "l0 as (select v.id, s.label lab, s.id is not null as seed from v left join seeds s using (id))"]
    else:
        parts = [graph, "l0 as (select id, id lab, false as seed from v)"]
    for i in range(1, rounds + 1):
        parts.append(f"c{i} as (select e.src id, l.lab, count(*) n from e join l{i - 1} l on l.id = e.dst where l.lab is not null group by 1, 2)")
        parts.append(f"m{i} as (select id, lab from c{i} qualify row_number() over (partition by id order by n desc, lab) = 1)")
        parts.append(f"l{i} as materialized (select p.id, case when p.seed then p.lab else coalesce(m.lab, p.lab) end lab, p.seed from l{i - 1} p left join m{i} m using (id))")
    return ", ".join(parts)


def lp_sql(rounds: int, seeded: bool, graph: str = PARTS) -> str:
    return f"with {lp_ctes(rounds, seeded, graph)} select id, cast(lab as bigint) as label from l{rounds}"


def lp_stop_sql(rounds: int, stop: str) -> str:
    """Seeded propagation up to the first round whose ``changed`` and ``free``
    meet ``stop``, or all ``rounds``."""
    counts = " union all ".join(f"select {i} k, (select count(*) from l{i} a join l{i - 1} b using (id) where a.lab is distinct from b.lab) changed, (select count(*) from l{i} where not seed) free" for i in range(1, rounds + 1))
    each = " union all ".join(f"select {i} k, id, lab from l{i}" for i in range(1, rounds + 1))
    return f"with {lp_ctes(rounds, True)}, q as ({counts}), stop as (select coalesce(min(k) filter ({stop}), {rounds}) k from q) select id, cast(lab as bigint) as label, k as iterations from ({each}) join stop using (k)"


def pagerank_ctes(rounds: int, graph: str = PARTS) -> str:
    parts = [graph, "nn as (select count(*)::double n from v)", "dg as (select src, count(*) d from e group by src)", "p0 as (select v.id, 1.0::double / n r from v, nn)"]
    for i in range(1, rounds + 1):
        parts.append(f"s{i} as (select e.dst id, sum(p.r / dg.d) c from e join p{i - 1} p on p.id = e.src join dg on dg.src = e.src group by 1)")
        parts.append(f"x{i} as (select coalesce(sum(p.r), 0) m from p{i - 1} p where p.id not in (select src from dg))")
        parts.append(f"p{i} as materialized (select v.id, 0.15::double / n + 0.85::double * (coalesce(c, 0) + m / n) r from v cross join nn cross join x{i} left join s{i} using (id))")
    return ", ".join(parts)


def pagerank_stop_sql(rounds: int, tol: float) -> str:
    """The first round whose L1 change is below ``tol``, or the last."""
    deltas = " union all ".join(f"select {i} k, (select sum(abs(a.r - b.r)) from p{i} a join p{i - 1} b using (id)) delta" for i in range(1, rounds + 1))
    each = " union all ".join(f"select {i} k, id, r from p{i}" for i in range(1, rounds + 1))
    return f"with {pagerank_ctes(rounds)}, q as ({deltas}), stop as (select coalesce(min(k) filter (delta < {tol}), {rounds}) k from q) select id, round(r, 9) as rank, k as iterations from ({each}) join stop using (k)"


def sssp_progress_sql(rounds: int) -> str:
    """How many distances each of the first rounds improves."""
    parts = [WEIGHTED, "d0 as (select id, 0.0::double d from s0)"]
    for i in range(1, rounds + 1):
        parts.append(f"d{i} as materialized (select id, min(d) d from (select id, d from d{i - 1} union all select w.dst, d.d + w.weight from d{i - 1} d join w on w.src = d.id) group by 1)")
    counts = " union all ".join(f"select {i} as round, (select count(*) from d{i} a left join d{i - 1} b using (id) where b.id is null or a.d < b.d) as improved" for i in range(1, rounds + 1))
    return f"with {', '.join(parts)} {counts}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow one another on an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null").distinct()


def part_graph(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Graph:
    edges = part_chain(spark, sf_dir)
    if weighted:
        edges = edges.withColumn("weight", formula_weight())
    return Graph(edges, table(spark, sf_dir, "part").count())


def source_of(edges: DataFrame) -> int:
    return summary(edges).first().source


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("label"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as timed runs of four backends on three sizes."""
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("standalone", "rayon", "mpi", "burst")])
    return table(spark, sf_dir, "orders").select(
        k.alias("run"), F.get(names, (k % 4).cast("int")).alias("backend"), F.pow(F.lit(10), 4 + F.col("o_custkey") % 3).cast("long").alias("nodes"),
        F.pow(F.lit(2), 1 + F.floor(k / 4) % 4).cast("int").alias("ranks"), (F.col("o_totalprice") / 1000).alias("ms"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("passed").alias("status"),
    )


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users that follow one another in time; repeated edges count."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", F.lit(1).cast("long").alias("one"))
    ranked = cut(running_total(events, ["ts", "event_id"], "one", "k").select("k", "user_id"), "user-order")
    after = ranked.select((F.col("k") - 1).alias("k"), F.col("user_id").alias("dst"))
    return Graph(ranked.join(after, "k").select(F.col("user_id").alias("src"), "dst"), vertices=events.select(F.col("user_id").alias("id")).distinct(), closed=True)


def order_graph(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Graph:
    """Orders that lead to their customer's later ones."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    third = F.when(F.col("o_orderpriority") == "1-URGENT", F.lead("o_orderkey", 3).over(w))
    ahead = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("a"), third.alias("b"))
    edges = ahead.select("src", F.explode(F.array("a", "b")).alias("dst")).where("dst is not null")
    if weighted:
        edges = edges.withColumn("weight", formula_weight())
    return Graph(edges, vertices=table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), closed=True)


def first_order(spark: SparkSession, sf_dir: str) -> int:
    """The first order of the customer with the most orders."""
    orders = table(spark, sf_dir, "orders")
    best = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    return best.orderBy(F.desc("n"), "o_custkey").select("first.o_orderkey").first()[0]


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers to the suppliers they bought from, whose ids follow theirs."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    offset = customer.count()
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + offset).alias("id"))
    sold = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = sold.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + offset).alias("dst")).distinct()
    return Graph(edges, vertices=customer.unionAll(supplier), closed=True)
