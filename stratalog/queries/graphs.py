"""Graph operators over graphs drawn from the tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import thousandths
from ..operators import graph as G
from ..operators import kernels as K
from .common import RING_SQL, SUPPLY_SQL, TRADE_SQL, TREE_SQL, ring, supply, table, trade, tree

Query = Callable[[SparkSession, str], DataFrame]


def _brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, component: suppliers by nation, parts by brand."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("component"))
    return s.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"), F.col("p_brand").alias("component")))


BRAND_SQL = """brand as (
  select 's' || s_suppkey as node, 'n' || s_nationkey as component from supplier
  union all select 'p' || p_partkey, p_brand from part)"""


def _grouped(df: DataFrame) -> DataFrame:
    return df.withColumn("g", F.lit(0))


def _trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade between different nations."""
    return trade(spark, sf_dir).where("src != dst").select("src", "dst", "count")


def _region_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's ring as a group of its own."""
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), F.col("n_regionkey").alias("g"))
    return ring(spark, sf_dir).join(region, "src").select("g", "src", "dst")


HITTING_SQL = """
with p as (select cast(n_nationkey as bigint) as node, n_regionkey as g, row_number() over (partition by n_regionkey order by n_nationkey) as at, count(*) over (partition by n_regionkey) as m from nation)
select a.node as src, b.node as dst, cast(((b.at - a.at + a.m) % a.m) * 1000 as bigint) as steps_x1000 from p a join p b on a.g = b.g and a.node != b.node"""


def q_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = G.pagerank(tree(spark, sf_dir), rounds=4)
    return ranks.select("node", F.floor(F.col("rank") * 1e6 + 0.5).cast("bigint").alias("rank_x1e6"))


PAGERANK_SQL = f"""
with {TREE_SQL}, e as (select distinct src, dst from tree where src != dst),
nodes as (select src as node from e union select dst from e),
n as (select count(*) as n from nodes),
o as (select src, count(*) as t from e group by 1),
r0 as (select node, 1.0::double / n as r from nodes, n)
""" + "".join(
    f""", r{i} as (
  select node, 0.15::double / n + 0.85::double * (coalesce(got, 0) + lost / n) as r
  from nodes cross join n cross join (select coalesce(sum(r), 0) as lost from r{i - 1} where node not in (select src from o))
  left join (select dst, sum(r / t) as got from e join o using (src) join r{i - 1} on node = src group by dst) on dst = node)"""
    for i in range(1, 5)
) + " select node, cast(floor(r * 1e6 + 0.5) as bigint) as rank_x1e6 from r4"


def q_personalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade(spark, sf_dir).where("src != dst").select("src", "dst", F.col("count").cast("double").alias("w"))
    focus = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("node"), F.lit(100.0).alias("boost"))
    return G.personalized_pagerank(edges, focus).select("node", thousandths(F.col("rank")).alias("rank_x1000"))


PERSONAL_SQL = f"""
with {TRADE_SQL}, e as (select src, dst, count::double as w from trade where src != dst),
focus as (select cast(r_regionkey as bigint) as node from region),
b as (select node, case when node in (select node from focus) then 1.0::double / (select count(*) from focus) else 0.0::double end as p from (select src as node from e union select dst from e union select node from focus)),
s as (select src, dst, w / sum(w) over (partition by src) as share from e),
r0 as (select node, p as r from b)
""" + "".join(
    f""", r{i} as materialized (
  select b.node, 0.15::double * p + 0.85::double * (coalesce(got, 0) + lost * p) as r
  from b cross join (select coalesce(sum(r), 0) as lost from r{i - 1} where node not in (select src from s))
  left join (select dst, sum(r * share) as got from s join r{i - 1} on node = src group by dst) g on g.dst = b.node)"""
    for i in range(1, 16)
) + " select node, cast(floor(r * 1000 + 0.5) as bigint) as rank_x1000 from r15"


def q_component_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.component_metrics(supply(spark, sf_dir), _brand(spark, sf_dir)).select("component", "ca", "ce", "instability", "distance")


def q_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach(tree(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.createDataFrame([("world",)], "node string"))


def q_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.affected(tree(spark, sf_dir), spark.createDataFrame([("r0",)], "node string"), depth=2)


def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ring(spark, sf_dir)
    return G.shortest_paths(r, r.select(F.col("src").alias("node"))).select("source", "node", F.size("path").cast("bigint").alias("length"))


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connected_components(ring(spark, sf_dir))


def q_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.transitive_closure(tree(spark, sf_dir))


def q_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings joined one way by an edge from each region's first nation to the next region's."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").cast("bigint").alias("k"))
    bridge = n.select(F.col("k").alias("src"), F.col("n_regionkey").alias("r")).join(n.select(F.col("k").alias("dst"), (F.col("n_regionkey") - 1).alias("r")), "r").select("src", "dst")
    return G.strong_components(ring(spark, sf_dir).unionByName(bridge))


SCC_SQL = f"""
with recursive {RING_SQL}, firsts as (select n_regionkey as r, cast(min(n_nationkey) as bigint) as k from nation group by 1),
e as (select * from ring union select a.k, b.k from firsts a join firsts b on b.r = a.r + 1),
p as (select src, dst from e union select p.src, e.dst from p join e on p.dst = e.src)
select a.src as node, min(a.dst) as component from p a join p b on a.src = b.dst and a.dst = b.src group by 1"""


def q_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycle_records(G.strong_components(ring(spark, sf_dir))).select("id", F.col("size").cast("bigint").alias("size"), F.array_join("members", "|").alias("members"))


CYCLES_SQL = f"""
with {RING_SQL}, m as (select n_regionkey, array_to_string(list_sort(list(cast(n_nationkey as varchar))), '|') as members, count(*) as size from nation group by 1 having count(*) > 1)
select substring(sha1(members), 1, 12) as id, size, members from m"""


def q_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"), F.col("n_regionkey").alias("community"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("src"))
    return G.modularity(li.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").select("src", "dst"), region)


MODULARITY_SQL = f"""
with {TRADE_SQL}, x as (select a.n_regionkey as cs, b.n_regionkey as cd, count from trade join nation a on a.n_nationkey = src join nation b on b.n_nationkey = dst),
m as (select sum(count) as m, sum(case when cs = cd then count else 0 end) as l from x),
d as (select c, sum(count) as d from (select cs as c, count from x union all select cd, count from x) group by c)
select cast(floor((l::double / m - (select sum(d::double * d) from d) / (4.0::double * m * m)) * 1000 + 0.5) as bigint) as modularity_x1000 from m"""


def q_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.col("l_returnflag").alias("label"))
    return G.container_edges(li, _brand(spark, sf_dir).withColumnRenamed("component", "container"))


CONTAINER_SQL = f"""
with {BRAND_SQL}, e as (select 's' || l_suppkey as src, 'p' || l_partkey as dst, l_returnflag as label from lineitem)
select a.component as src, b.component as dst, count(*) as count, array_to_string(list_sort(list_distinct(list(label)))[1:3], ',') as labels
from e join brand a on a.node = e.src join brand b on b.node = e.dst where a.component != b.component group by 1, 2"""


def q_misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("package"), F.col("c_nationkey").alias("community"))
    return G.misplaced(c)


def q_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_returnflag") == "R").alias("resolved"))
    return G.node_status(nodes, edges, table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")))


STATUS_SQL = """
with i as (select l_partkey as node, bool_or(l_returnflag = 'R') as sure from lineitem where l_quantity >= 45 group by 1)
select p_partkey as node, case when p_size = 1 then 'entry' when sure then 'connected' when sure is not null then 'uncertain' else 'orphan' end as status
from part left join i on node = p_partkey"""


def q_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("node")).agg(F.count("*").alias("size"))
    return G.coupling_volume(trade(spark, sf_dir), n)


def q_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hub_threshold(supply(spark, sf_dir))


def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(supply(spark, sf_dir), "p7")


def q_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.arch_violations(tree(spark, sf_dir), [("direct", "c*", "n1?", False), ("reach", "n*", "wor*", True)])


def q_articulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree, and suppliers as nodes without edges."""
    alone = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    edges = tree(spark, sf_dir)
    nodes = alone.unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node")))
    return K.articulation_points(_grouped(edges), nodes=_grouped(nodes)).drop("g")


def q_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey")).alias("p"))
    e = _trade_links(spark, sf_dir)
    e = e.join(r.select(F.col("n_nationkey").alias("src"), F.col("p").alias("ps")), "src").join(r.select(F.col("n_nationkey").alias("dst"), F.col("p").alias("pd")), "dst")
    return K.package_min_cut(_grouped(e)).drop("g")


def q_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.structure_matrix(_grouped(tree(spark, sf_dir))).drop("g")


_D = f"with {SUPPLY_SQL}, o as (select src, count(*) as o from supply group by 1), i as (select dst, count(*) as i from supply group by 1)"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "graph_degrees": (
        lambda s, d: G.degrees(supply(s, d)),
        f"{_D} select coalesce(src, dst) as node, coalesce(i, 0) as fan_in, coalesce(o, 0) as fan_out from o full outer join i on src = dst",
    ),
    "graph_curvature": (lambda s, d: G.curvature(supply(s, d)), f"{_D} select supply.src, supply.dst, 2 - o - i as curvature from supply join o using (src) join i using (dst)"),
    "graph_bottleneck": (
        lambda s, d: G.bottleneck(trade(s, d)),
        f"with {TRADE_SQL}, e as (select distinct src, dst from trade where src != dst), i as (select dst as node, count(*) as i from e group by 1), o as (select src as node, count(*) as o from e group by 1) select node, cast(floor(greatest(0.0::double, 1 - coalesce(o, 0)::double / i) * 1000 + 0.5) as bigint) as score_x1000 from i left join o using (node)",
    ),
    "graph_bottleneck_static": (
        lambda s, d: G.bottleneck_static(trade(s, d)),
        f"with {TRADE_SQL}, e as (select distinct src, dst from trade where src != dst), i as (select dst as node, count(*) as i from e group by 1), o as (select src as node, count(*) as o from e group by 1) select node, cast(floor(log2(coalesce(i, 0) + 1) * log2(coalesce(o, 0) + 1) * 1000 + 0.5) as bigint) as score_x1000 from i full outer join o using (node)",
    ),
    "graph_coupling_volume": (
        q_volume,
        f"with {TRADE_SQL}, e as (select distinct src, dst from trade where src != dst), i as (select dst as node, count(*) as i from e group by 1), o as (select src as node, count(*) as o from e group by 1), z as (select c_nationkey as node, count(*) as size from customer group by 1) select node, cast(pow(coalesce(i, 0) * coalesce(o, 0), 2) * size as bigint) as volume from i full outer join o using (node) join z using (node)",
    ),
    "graph_component_metrics": (
        q_component_metrics,
        f"""with {SUPPLY_SQL}, {BRAND_SQL}, n as (select src, dst, a.component as cs, b.component as cd from supply join brand a on a.node = src join brand b on b.node = dst where a.component != b.component),
        ca as (select cd as component, count(distinct src) as ca from n group by 1), ce as (select cs as component, count(distinct dst) as ce from n group by 1),
        m as (select c.component, coalesce(ca, 0) as ca, coalesce(ce, 0) as ce from (select distinct component from brand) c left join ca using (component) left join ce using (component)),
        k as (select *, case when ca + ce > 0 then ce::double / (ca + ce) else 0.0::double end as i from m)
        select component, ca, ce, round(i, 4) as instability, round(abs(i - 1), 4) as distance from k""",
    ),
    "graph_pagerank": (q_pagerank, PAGERANK_SQL),
    "graph_personalized_pagerank": (q_personalized, PERSONAL_SQL),
    "graph_reach_depth": (
        q_reach,
        f"with recursive {TREE_SQL}, r as (select 'world' as node, 0 as depth union all select src, depth + 1 from r join tree on dst = node) select node, min(depth) as depth from r group by 1",
    ),
    "graph_affected_depth2": (
        q_affected,
        f"with recursive {TREE_SQL}, r as (select 'r0' as node, 0 as depth union all select src, depth + 1 from r join tree on dst = node where depth < 2) select node, min(depth) as depth, false as is_test from r group by 1",
    ),
    "graph_shortest_paths": (
        q_paths,
        f"with recursive {RING_SQL}, r as (select src as source, dst as node, 2 as length from ring union all select source, dst, length + 1 from r join ring on node = src where length < 30), b as (select source, node, cast(min(length) as bigint) as length from r where source != node group by all) select * from b where length > 2",
    ),
    "graph_components": (
        q_components,
        "select cast(n_nationkey as bigint) as node, cast(min(n_nationkey) over (partition by n_regionkey) as bigint) as root from nation",
    ),
    "graph_transitive_closure": (
        q_closure,
        f"with recursive {TREE_SQL}, o as (select src, dst from tree union select o.src, tree.dst from o join tree on o.dst = tree.src) select src, dst from o",
    ),
    "graph_strong_components": (q_scc, SCC_SQL),
    "graph_cycle_records": (q_cycles, CYCLES_SQL),
    "graph_modularity": (q_modularity, MODULARITY_SQL),
    "graph_container_edges": (q_container, CONTAINER_SQL),
    "graph_misplaced": (
        q_misplaced,
        "with n as (select c_nationkey as k, c_mktsegment as s, count(*) as n from customer group by all), t as (select k, s as dominant from n qualify row_number() over (partition by k order by n desc, s) = 1) select c_custkey as node, c_mktsegment as package, dominant from customer join t on k = c_nationkey where c_mktsegment != dominant",
    ),
    "graph_node_status": (q_status, STATUS_SQL),
    "graph_hubs": (
        q_hubs,
        f"with {SUPPLY_SQL}, i as (select dst as node, count(*) as fan_in from supply group by 1 union all select distinct src, 0 from supply) select node, fan_in from i where fan_in >= (select greatest(5, ceil(max(fan_in) * 0.25)) from i)",
    ),
    "graph_neighbours": (q_neighbours, f"with {SUPPLY_SQL} select src, dst from supply where dst = 'p7'"),
    "graph_arch_rules": (
        q_arch,
        f"with {TREE_SQL} select 'direct' as rule, src, dst from tree where src like 'c%' and dst similar to 'n1.' union all select 'reach', 'n' || n_nationkey, 'world' from nation",
    ),
    "graph_articulation": (
        q_articulation,
        f"with {TREE_SQL}, ends as (select src as node from tree union all select dst from tree) select node, count(*) + (select count(*) from supplier) as severity from ends group by 1 having count(*) > 1",
    ),
    "graph_min_cut": (q_mincut, None),
    "graph_spectral": (
        lambda s, d: K.spectral_scopes(_region_ring(s, d)),
        "with r as (select n_regionkey as g, count(*) as n from nation group by 1), q as (select *, 2 - 2 * cos(2 * pi() * (n // 2) / n) as q from r) select g, n as nodes, n as edges, cast(floor(q * 1000 + 0.5) as bigint) as lambda_x1000, cast(floor(sqrt(2 * q) * 1000 + 0.5) as bigint) as cheeger_x1000 from q",
    ),
    "graph_louvain": (lambda s, d: K.communities(_grouped(tree(s, d))).drop("g"), None),
    "graph_persistence": (lambda s, d: K.persistence(_grouped(_trade_links(s, d).withColumnRenamed("count", "w"))).drop("g"), None),
    "graph_hitting_times": (lambda s, d: K.hitting_times(_region_ring(s, d)).drop("g"), HITTING_SQL),
    "graph_structure_matrix": (
        q_order,
        f"with {TREE_SQL}, n as (select src as node from tree union select dst from tree) select node, row_number() over (order by node) - 1 as position, row_number() over (order by node) - 1 as level from n",
    ),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
