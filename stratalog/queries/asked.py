"""Endpoints and comparisons over relations drawn from the tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cochange as C
from ..operators import graph as G
from ..operators import structure as T
from ..plans.endpoints import ENDPOINTS
from .common import SUPPLY_SQL, TREE_SQL, ring, supply, table, tree

Query = Callable[[SparkSession, str], DataFrame]


def _relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts are files that suppliers import; orders are commits; what orders say of customers is shared state."""
    li, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    p = lambda c: F.concat(F.lit("p"), F.col(c))
    nodes = part.select(p("p_partkey").alias("node"), F.lit("file").alias("type"), F.when(F.col("p_size") < 5, "orphan").otherwise("connected").alias("status"), "p_size")
    edges = supply(spark, sf_dir)
    commits = li.select(F.col("l_orderkey").alias("idx"), p("l_partkey").alias("file"))
    return {
        "nodes": nodes.drop("p_size"), "edges": edges, "calls": tree(spark, sf_dir), "commits": commits, "pairs": C.cochange_pairs(commits, min_count=2),
        "tested": part.where("p_size <= 25").select(p("p_partkey").alias("file")),
        "truth": orders.select(F.col("o_orderpriority").alias("concept"), p("o_custkey").alias("file"), F.when(F.col("o_orderstatus") == "O", "write").otherwise("read").alias("role")),
        "drift": li.where("l_discount >= 0.1").select(p("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("kind")),
        "exports": part.select(p("p_partkey").alias("file"), F.col("p_brand").alias("name"), F.when(F.col("p_size") > 40, "used").otherwise("safe-to-remove").alias("confidence")),
        "old_nodes": nodes.where("p_size != 30").select("node", "type", F.when(F.col("p_size") < 8, "orphan").otherwise("connected").alias("status")),
        "old_edges": edges.where("src != 's1'").unionByName(spark.createDataFrame([("gone", "gone")], "src string, dst string")),
    }


def _ask(name: str, **arguments: str) -> Query:
    return lambda s, d: ENDPOINTS[name](_relations(s, d), **arguments)


def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the last section, whose ties at its end only the order of names breaks."""
    return ENDPOINTS["context"](_relations(spark, sf_dir), node="p7").where("section != 'cochange'")


def q_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ENDPOINTS["cycles"]({"edges": ring(spark, sf_dir)})
    return found.select("id", F.col("size").cast("bigint").alias("size"), F.array_join("members", "|").alias("members"), F.array_join("path", ">").alias("path"))


def q_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two times, parts of two sizes."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    orders = lambda lo, hi: (o.where(F.year("o_orderdate").between(lo, hi)).select("o_orderkey", F.when(F.lit(hi) < 1999, F.col("o_orderstatus")).otherwise("F").alias("status")), ["o_orderkey"])
    parts = lambda most: (p.where(F.col("p_size") <= most).select("p_brand", "p_type").distinct(), ["p_brand", "p_type"])
    return T.diff_counters({"signatures": orders(1992, 1996), "flows": parts(30)}, {"signatures": orders(1994, 1999), "flows": parts(40)})


_STATUS = "case when p_size < {} then 'orphan' else 'connected' end"
COUNTERS_SQL = """
with b as (select o_orderkey as k, o_orderstatus as s from orders where year(o_orderdate) between 1992 and 1996), a as (select o_orderkey as k, 'F' as s from orders where year(o_orderdate) between 1994 and 1999),
x as (select distinct p_brand, p_type from part where p_size <= 30), y as (select distinct p_brand, p_type from part where p_size <= 40)
select 'signatures added' as counter, count(*) as value from a where k not in (select k from b) union all select 'signatures removed', count(*) from b where k not in (select k from a)
union all select 'signatures changed', count(*) from a join b using (k) where a.s != b.s
union all select 'flows added', count(*) from (select * from y except select * from x) union all select 'flows removed', count(*) from (select * from x except select * from y) union all select 'flows changed', 0"""

RANKS_SQL = f"""
with {SUPPLY_SQL}, e as (select src, dst from supply), nodes as (select src as node from e union select dst from e), n as (select count(*) as n from nodes), o as (select src, count(*) as t from e group by 1),
r0 as (select node, 1.0::double / n as r from nodes, n)
""" + "".join(
    f""", r{i} as materialized (
  select node, 0.15::double / n + 0.85::double * (coalesce(got, 0) + lost / n) as r
  from nodes cross join n cross join (select coalesce(sum(r), 0) as lost from r{i - 1} where node not in (select src from o))
  left join (select dst, sum(r / t) as got from e join o using (src) join r{i - 1} on node = src group by dst) on dst = node)"""
    for i in range(1, 16)
) + " select node, cast(floor(round(r / (select max(r) from r15), 6) * 1000 + 0.5) as bigint) as rank_x1000 from r15"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "ask_who_imports": (_ask("who_imports", node="p9"), f"with {SUPPLY_SQL} select src, dst from supply where dst = 'p9'"),
    "ask_who_calls": (_ask("who_calls", node="n3"), f"with {TREE_SQL} select src, dst from tree where dst = 'n3'"),
    "ask_affected": (_ask("affected", node="p9"), f"with {SUPPLY_SQL} select 'p9' as node, 0 as depth, false as is_test union all select src, 1, false from supply where dst = 'p9'"),
    "ask_orphans": (_ask("orphans"), "select 'p' || p_partkey as node from part where p_size < 5"),
    "ask_truth_point": (
        _ask("truth_point_for", concept="1-urgent"),
        "select distinct o_orderpriority as concept, case when o_orderstatus = 'O' then 'write' else 'read' end as role, 'p' || o_custkey as file from orders where o_orderpriority = '1-URGENT'",
    ),
    "ask_recent": (_ask("recent", k="30"), "select 'p' || l_partkey as file, max(l_orderkey) as last, count(distinct l_orderkey) as commits from lineitem group by 1 order by last desc, file limit 30"),
    "ask_uncovered": (
        _ask("uncovered"),
        f"""with {SUPPLY_SQL}, f as (select dst, count(*) as n from supply group by 1), w as (select distinct 'p' || o_custkey as file from orders where o_orderstatus = 'O'),
        u as (select 'p' || p_partkey as file from part where p_size > 25),
        s as (select u.file, coalesce(n, 0) as n, case when n >= 20 then 4 when n >= 5 then 2 when n >= 1 then 1 else 0 end + case when w.file is not null then 5 else 0 end as score from u left join f on dst = u.file left join w on w.file = u.file)
        select file, cast(n as bigint) as fan_in, cast(score as bigint) as score from s where score > 0""",
    ),
    "ask_changes_since": (
        _ask("changes_since"),
        f"""with {SUPPLY_SQL}, b as (select p_partkey as k, {_STATUS.format(8)} as s from part where p_size != 30), a as (select p_partkey as k, {_STATUS.format(5)} as s from part)
        select 'node' as what, 'p' || k as key, 'changed' as change from a join b using (k) where a.s != b.s union all select 'node', 'p' || k, 'added' from a where k not in (select k from b)
        union all select 'edge', src || ' -> ' || dst, 'added' from supply where src = 's1' union all select 'edge', 'gone -> gone', 'removed'""",
    ),
    "ask_drift": (_ask("drift", kind="R"), "select 'p' || l_partkey as file, l_linenumber as line, l_returnflag as kind from lineitem where l_discount >= 0.1 and l_returnflag = 'R'"),
    "ask_exports": (_ask("exports", confidence="used"), "select 'p' || p_partkey as file, p_brand as name, 'used' as confidence from part where p_size > 40"),
    "ask_context": (
        q_context,
        f"with {SUPPLY_SQL} select 'status' as section, {_STATUS.format(5)} as other, cast(0 as bigint) as value from part where p_partkey = 7 union all select 'in', src, 1 from supply where dst = 'p7'",
    ),
    "ask_summary": (
        _ask("summary"),
        f"with {SUPPLY_SQL} select 'nodes ' || {_STATUS.format(5)} as counter, count(*) as value from part group by 1 union all select 'edges', count(*) from supply",
    ),
    "ask_cycles": (
        q_cycles,
        """with m as (select array_to_string(list_sort(list(cast(n_nationkey as varchar))), '|') as members, count(*) as size, string_agg(n_nationkey, '>' order by n_nationkey) || '>' || min(n_nationkey) as path from nation group by n_regionkey having count(*) > 1)
        select substring(sha1(members), 1, 12) as id, size, members, path from m""",
    ),
    "graph_module_ranks": (lambda s, d: G.module_ranks(supply(s, d)).select("node", F.floor(F.col("rank") * 1000 + 0.5).cast("bigint").alias("rank_x1000")), RANKS_SQL),
    "diff_counters": (q_counters, COUNTERS_SQL),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
