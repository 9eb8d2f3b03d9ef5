"""Smaller operators over the tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import age_text, fnv1a
from ..operators import graph as G
from ..operators import relational as R
from ..operators import structure as T
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return G.health(p.select(F.when(F.col("p_size") < 3, "entry").when(F.col("p_size") < 40, "connected").when(F.col("p_size") < 45, "uncertain").otherwise("orphan").alias("status")))


def q_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first two folders of their addresses."""
    path = F.regexp_extract("url", "://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").where("url is not null").groupBy(G.container_of(path, 2).alias("container")).agg(F.count("*").alias("pages"))


def q_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations declare routes with a parameter, customers call them with their own numbers, in several spellings."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    declared = n.where("n_nationkey < 20").select(F.concat(F.lit("n"), "n_nationkey").alias("file"), F.lit("get").alias("method"), F.concat(F.lit("/nations/"), F.col("n_nationkey"), F.lit("/customers/:id/")).alias("path"))
    end = F.when(F.col("c_custkey") % 3 == 0, "/${id}?full=1").when(F.col("c_custkey") % 3 == 1, "/{customerId}").otherwise("/:who/")
    calls = c.select(F.concat(F.lit("c"), "c_custkey").alias("file"), F.lit("GET").alias("method"), F.concat(F.lit("/nations/"), F.col("c_nationkey"), F.lit("/customers"), end).alias("path"))
    return R.route_edges(declared, calls)


def q_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as tables, clerks' keys of orders as caches."""
    concepts = spark.createDataFrame([("orders",), ("users",), ("boxes",)], "concept string")
    keys = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(
        F.lit("redis").alias("kind"), F.concat(F.element_at(F.array(F.lit("order:"), F.lit("orders-by:"), F.lit("User:"), F.lit("reorder:")), (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_custkey")).alias("key"), F.col("o_orderstatus").alias("file")
    )
    return R.mirrors(concepts, keys)


def q_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events search for nations; nations are hubs by their number of customers."""
    n = table(spark, sf_dir, "nation")
    searches = table(spark, sf_dir, "events").join(n, F.col("user_id") % 25 == F.col("n_nationkey")).select(F.concat(F.lit("("), F.lower("n_name"), F.lit(")")).alias("pattern"))
    return R.search_hits(searches, n.select(F.concat(F.lit("src/"), "n_name", F.lit(".ts")).alias("file"), F.col("n_nationkey").alias("rank")))


def q_key_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*(F.lit(x) for x in ("_id", "_BY", "key", "_ref", "_to"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return R.key_suffixes(table(spark, sf_dir, "nation").select(F.col("n_name").alias("table"), F.concat(F.lit("other"), ends).alias("column")))


def q_dev_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    used = lambda flag: li.where(f"l_returnflag = '{flag}' and l_quantity <= 5").select(F.col("l_partkey").alias("package"))
    return R.dependency_gaps(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("package")), used("N"), used("R"))


def q_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers set off their segment's event; suppliers listen to the segment that their number falls on."""
    emits = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("entry"), F.col("c_mktsegment").alias("event"))
    heard = F.element_at(F.array(*(F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return T.downstream(emits, table(spark, sf_dir, "supplier").where("s_suppkey <= 20").select(F.concat(F.lit("s"), "s_suppkey").alias("entry"), heard.alias("event")))


def q_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as partial results of workers, folded by priority."""
    o = table(spark, sf_dir, "orders")
    parts = o.groupBy("o_orderpriority", (F.col("o_orderkey") % 7).alias("worker")).agg(
        F.count("*").alias("n"), F.max("o_orderdate").alias("last"), F.collect_set("o_orderstatus").alias("states"), F.create_map(F.lit("total"), F.count("*"), F.concat(F.lit("odd"), (F.max("o_custkey") % 2)), F.lit(1).cast("bigint")).alias("marks"), F.array(F.min("o_custkey")).alias("least")
    )
    out = T.merge_partials(parts, "o_orderpriority", ["n"], ["last"], ["states"], ["marks"], ["least"])
    return out.select("o_orderpriority", "n", F.col("last").cast("date").cast("string").alias("last"), F.array_join("states", ",").alias("states"), F.element_at("marks", "total").alias("total"), F.array_join("least", ",").alias("least"))


def q_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", fnv1a(F.col("n_name")).alias("hash"), (fnv1a(F.col("n_name")) % 8).alias("worker"))


def q_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.col("p_partkey") * F.col("p_partkey") * 37).cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", age_text(seconds).alias("age"))


def _age_sql(s: str) -> str:
    units = ((31557600, "year"), (2629800, "month"), (604800, "week"), (86400, "day"), (3600, "hour"), (60, "minute"))
    return "case " + " ".join(f"when {s} >= {n} then cast({s} // {n} as varchar) || ' {u}' || case when {s} // {n} = 1 then '' else 's' end || ' ago'" for n, u in units) + f" else {s} || ' seconds ago' end"


QUERIES: dict[str, tuple[Query, str | None]] = {
    "graph_health": (
        q_health,
        "with s as (select case when p_size < 3 then 'e' when p_size < 40 then 'c' when p_size < 45 then 'u' else 'o' end as s from part), t as (select count(*) as files, count(*) filter (s = 'e') as entries, count(*) filter (s = 'c') as connected, count(*) filter (s = 'o') as orphans, count(*) filter (s = 'u') as uncertain from s) select *, cast(floor(connected * 100.0::double / (files - entries) + 0.5) as bigint) as health_x100 from t",
    ),
    "graph_containers": (
        q_containers,
        "with p as (select regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '^(.*)/[^/]*$', 1) as f from pages where url is not null) select array_to_string(string_split(f, '/')[1:2], '/') as container, count(*) as pages from p group by 1",
    ),
    "route_edges": (
        q_routes,
        "select 'c' || c_custkey as src, case when c_nationkey < 20 then 'n' || c_nationkey end as dst, 'GET' as method, '/nations/' || c_nationkey || '/customers/*' as path, c_nationkey < 20 as resolved from customer",
    ),
    "truth_mirrors": (
        q_mirrors,
        "select distinct case o_orderkey % 4 when 2 then 'users' else 'orders' end as concept, 'redis' as kind, case o_orderkey % 4 when 0 then 'order:' when 1 then 'orders-by:' when 2 then 'User:' end || o_custkey as key, o_orderstatus as file from orders where o_orderkey % 50 = 0 and o_orderkey % 4 != 3 and o_orderkey % 4 != 1",
    ),
    "search_hits": (
        q_search_hits,
        "select '(' || lower(n_name) || ')' as pattern, 'src/' || n_name || '.ts' as file, count(*) as count from events join nation on user_id % 25 = n_nationkey where n_name not like '% %' and length(regexp_replace(n_name, '[^A-Za-z0-9_]', '', 'g')) >= 4 group by 1, 2",
    ),
    "key_suffixes": (q_key_suffixes, 'select n_name as "table", case n_nationkey % 5 when 2 then \'otherkey\' else \'other_ref\' end as "column" from nation where n_nationkey % 5 in (2, 3)'),
    "dependency_dev_only": (
        q_dev_only,
        "with n as (select distinct l_partkey as k from lineitem where l_returnflag = 'N' and l_quantity <= 5), r as (select distinct l_partkey as k from lineitem where l_returnflag = 'R' and l_quantity <= 5), d as (select p_partkey as k from part where p_partkey % 2 = 0) select k as package, 'unused' as gap from d where k not in (select k from n) and k not in (select k from r) union all select k, 'missing' from (select k from n union select k from r) where k not in (select k from d) union all select k, 'dev-only' from d where k not in (select k from n) and k in (select k from r)",
    ),
    "flow_downstream": (
        q_downstream,
        "select 'c' || c_custkey as entry, c_mktsegment as event, 's' || s_suppkey as listener from customer join supplier on c_mktsegment = (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[s_suppkey % 5 + 1] where c_acctbal < 0 and s_suppkey <= 20",
    ),
    "merge_partials": (
        q_fold,
        "with w as (select o_orderpriority, o_orderkey % 7 as w, min(o_custkey) as least from orders group by all) select o_orderpriority, cast(count(*) as bigint) as n, cast(cast(max(o_orderdate) as date) as varchar) as last, array_to_string(list_sort(list(distinct o_orderstatus)), ',') as states, cast(count(*) as bigint) as total, (select array_to_string(list_sort(list(least)), ',') from w where w.o_orderpriority = o.o_orderpriority) as least from orders o group by o_orderpriority",
    ),
    "hash_affinity": (
        q_affinity,
        "with b as (select n_name, list_transform(range(1, length(n_name) + 1), lambda i: cast(ascii(substring(n_name, i, 1)) as ubigint)) as x from nation), h as (select n_name, list_reduce(list_prepend(cast(2166136261 as ubigint), x), lambda h, c: (xor(h, c) * 16777619) & 4294967295) as h from b) select n_name, cast(h as bigint) as hash, cast(h % 8 as bigint) as worker from h",
    ),
    "age_texts": (q_ages, f"with p as (select p_partkey, cast(p_partkey as bigint) * p_partkey * 37 as s from part) select p_partkey, {_age_sql('s')} as age from p"),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
