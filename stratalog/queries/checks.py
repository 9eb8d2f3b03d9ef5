"""Checks and extraction over facts drawn from the tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import extract, runtime_alerts, static_violations
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

STATIC_NAMES = {
    "COMPOSITE-HUB-UNTESTED", "COMPOSITE-ESLINT-IN-ARTICULATION", "COMPOSITE-ESLINT-IN-UNTESTED-CYCLE", "CYCLES", "NO-NEW-ARTICULATION-POINT",
    "COMPOSITE-ARTICULATION-WITH-FLOATING-PROMISE", "COMPOSITE-FANOUT-NO-TEST-NO-ARTIC", "COMPOSITE-ENV-VAR-SPREAD",
}


def _p(key: str = "l_partkey") -> F.Column:
    return F.concat(F.lit("p"), F.col(key)).alias("file")


def q_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are files: suppliers import them, returned lines are lint findings, brands are cycles, dear parts hold the graph together."""
    li, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    facts = {
        "ModuleFanIn": li.groupBy(_p()).agg(F.count_distinct("l_suppkey").alias("count")),
        "TestedFile": part.where("p_size <= 25").select(_p("p_partkey")),
        "ArticulationPoint": part.where("p_retailprice > 1500").select(_p("p_partkey"), F.lit(2).alias("severity")),
        "EslintViolation": li.where("l_returnflag = 'R'").select(_p(), F.col("l_linenumber").alias("line"), F.when(F.col("l_tax") > 0.04, 2).otherwise(1).alias("severity")),
        "FloatingPromise": li.where("l_quantity >= 49").select(_p(), F.col("l_linenumber").alias("line")),
        "CycleNode": part.where("p_size < 10").select(_p("p_partkey"), F.col("p_brand").alias("cycleId"), F.when(F.col("p_size") < 5, "true").otherwise("false").alias("gated")),
        "IsPackageEntryPoint": part.where("p_size = 1").select(_p("p_partkey")),
        "IsFrameworkConventionFile": part.where("p_size = 2").select(_p("p_partkey")),
        "EnvRead": orders.select(F.col("o_orderpriority").alias("varName")),
    }
    exempt = part.where("p_size = 9").select(F.lit("CYCLES").alias("rule"), _p("p_partkey").alias("place"), F.lit(None).cast("string").alias("detail"))
    return static_violations(facts, STATIC_NAMES, exempt)


STATIC_SQL = """
with f as (select 'p' || l_partkey as file, count(distinct l_suppkey) as n from lineitem group by 1),
t as (select 'p' || p_partkey as file from part where p_size <= 25),
a as (select 'p' || p_partkey as file, p_size from part where p_retailprice > 1500),
e as (select 'p' || l_partkey as file, l_linenumber as line, case when l_tax > 0.04 then 2 else 1 end as severity from lineitem where l_returnflag = 'R'),
c as (select 'p' || p_partkey as file, p_brand as cycle, p_size from part where p_size < 10)
select 'COMPOSITE-HUB-UNTESTED' as rule, file as place, '' as detail, cast(0 as bigint) as number from f where n >= 20 and file not in (select file from t)
union select 'COMPOSITE-FANOUT-NO-TEST-NO-ARTIC', file, '', 0 from f where n > 15 and file not in (select file from t) and file not in (select file from a)
union select 'COMPOSITE-ESLINT-IN-ARTICULATION', file, '', line from e where severity = 2 and file in (select file from a)
union select 'COMPOSITE-ESLINT-IN-UNTESTED-CYCLE', file, '', line from e where file in (select file from c) and file not in (select file from t)
union select 'COMPOSITE-ARTICULATION-WITH-FLOATING-PROMISE', 'p' || l_partkey, '', l_linenumber from lineitem where l_quantity >= 49 and 'p' || l_partkey in (select file from a)
union select 'CYCLES', file, cycle, 0 from c where p_size between 5 and 8
union select 'NO-NEW-ARTICULATION-POINT', file, '', 0 from a where p_size not in (1, 2)
union select 'COMPOSITE-ENV-VAR-SPREAD', o_orderpriority, '', 0 from orders group by o_orderpriority having count(*) > 2"""


def q_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 1997 are what a run has touched; orders on hand are the routes hit."""
    li, part, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer"))
    fn = F.col("l_linestatus").alias("fn")
    facts = {
        "SymbolTouchedRuntime": li.where("year(l_shipdate) = 1997").groupBy(_p(), fn).agg(F.count("*").alias("count")),
        "TestedFile": part.where("p_size <= 25").select(_p("p_partkey")),
        "SymbolCallEdge": li.where("l_quantity > 25").select(_p().alias("toFile"), fn.alias("toSymbol")),
        "RuntimeRouteExpected": customer.select(F.col("c_mktsegment").alias("method"), F.concat(F.lit("/"), F.col("c_custkey")).alias("routePath")),
        "HttpRouteHit": orders.where("o_orderstatus = 'O'").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("method"), F.concat(F.lit("/"), F.col("c_custkey")).alias("routePath")),
        "IBScoreRuntime": part.select(_p("p_partkey"), F.col("p_brand").alias("fn"), F.col("p_size").alias("inflow"), F.floor(F.col("p_retailprice")).cast("bigint").alias("scorePermille")),
        "ModuleFanIn": li.groupBy(_p()).agg(F.count_distinct("l_suppkey").alias("count")),
    }
    return runtime_alerts(facts, {"HOT_PATH_UNTESTED", "RUNTIME_DRIFT", "DEAD_ROUTE", "BOTTLENECK", "COMPOSITE_HUB_BOTTLENECK"})


RUNTIME_SQL = """
with r as (select 'p' || l_partkey as file, l_linestatus as fn, count(*) as n from lineitem where year(l_shipdate) = 1997 group by 1, 2),
t as (select 'p' || p_partkey as file from part where p_size <= 25),
s as (select 'p' || l_partkey as file, l_linestatus as fn, count(*) as n from lineitem where l_quantity > 25 group by 1, 2),
h as (select distinct o_custkey from orders where o_orderstatus = 'O'),
b as (select 'p' || p_partkey as file, p_brand as fn, cast(floor(p_retailprice) as bigint) as score from part where p_size >= 5 and p_retailprice >= 851),
w as (select 'p' || l_partkey as file from lineitem group by 1 having count(distinct l_suppkey) >= 20)
select 'HOT_PATH_UNTESTED' as rule, file as place, fn as detail, n as number from r where n >= 10 and file not in (select file from t)
union all select 'RUNTIME_DRIFT', file, fn, n from s where n >= 2 and (file, fn) not in (select file, fn from r)
union all select 'DEAD_ROUTE', c_mktsegment, '/' || c_custkey, 0 from customer where c_custkey not in (select o_custkey from h)
union all select 'BOTTLENECK', file, fn, score from b
union all select 'COMPOSITE_HUB_BOTTLENECK', file, fn, score from b where file in (select file from w)"""


def _literals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lines are numbers in source: ship years decide where they stand, return flags how they are named."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, "CallExpression").when(F.col("l_linenumber") == 2, "PropertyAssignment").when(F.col("l_linenumber") == 3, "VariableDeclaration").when(F.col("l_linenumber") == 4, "BinaryExpression").otherwise("ArrayLiteral")
    flag = lambda c: F.when(c, 1).otherwise(0)
    name = lambda c: spark.createDataFrame([(c,)], "name string")
    return {
        "NumericLiteralAst": li.select(
            F.concat(F.lit("s"), F.col("l_suppkey")).alias("file"), F.col("l_orderkey").alias("line"), F.col("l_quantity").cast("int").cast("string").alias("valueText"), (F.col("l_quantity") * 40).cast("bigint").alias("valueAbs"), kind.alias("parentKind"),
            F.col("l_returnflag").alias("parentName"), flag(F.col("l_linestatus") == "O").alias("isScreamingSnake"), flag(F.col("l_discount") > 0.05).alias("isRatio"), flag(F.col("l_tax") == 0).alias("isTrivial"),
        ),
        "TimeoutFnName": name("R"), "TimeoutPropertyName": name("R"), "ThresholdPropertyName": name("A"),
        "FileTag": table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("file"), F.lit("test").alias("tag")),
    }


NUMBERS_SQL = """
with n as (
  select 's' || l_suppkey as file, l_orderkey as line, cast(cast(l_quantity as int) as varchar) as v, cast(l_quantity * 40 as bigint) as size, l_linenumber as k, l_returnflag as name, l_linestatus = 'O' as constant, l_discount > 0.05 as ratio
  from lineitem where l_tax != 0 and l_suppkey not in (select s_suppkey from supplier where s_nationkey < 5)),
c as (
  select *, case
    when k = 1 then case when name = 'R' then 'timeout' when size >= 1000 then 'large-int' end
    when k = 2 then case when name = 'R' then 'timeout' when name = 'A' then 'threshold' when ratio then 'ratio' when size >= 1000 then 'large-int' end
    when k = 3 and not constant or k = 4 then case when size >= 1000 then 'large-int' end end as category
  from n)
select distinct file, line, v as "valueText", name as context, category from c where category is not null"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "rules_static": (q_static, STATIC_SQL),
    "rules_runtime": (q_runtime, RUNTIME_SQL),
    "rules_magic_numbers": (lambda s, d: extract(_literals(s, d))["MagicNumber"], NUMBERS_SQL),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
