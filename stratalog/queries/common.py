"""Tables and the graphs and series that stand in for the engine's usual inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation points to the next one of its region, the last to the first: one cycle for each region."""
    n = table(spark, sf_dir, "nation")
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    first = F.first("n_nationkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return n.select(F.col("n_nationkey").cast("bigint").alias("src"), F.coalesce(F.lead("n_nationkey").over(w), first).cast("bigint").alias("dst"))


RING_SQL = """ring as (
  select cast(n_nationkey as bigint) as src,
         cast(coalesce(lead(n_nationkey) over (partition by n_regionkey order by n_nationkey),
                       first_value(n_nationkey) over (partition by n_regionkey order by n_nationkey)) as bigint) as dst
  from nation)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation -> region -> world."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("src"), F.lit("world").alias("dst"))
    return c.unionByName(n).unionByName(r)


TREE_SQL = """tree as (
  select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer
  union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
  union all select 'r' || r_regionkey, 'world' from region)"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct supplier -> part edges."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    return lines.repartition(parts_for(li.count(), spark), "src", "dst").distinct()


SUPPLY_SQL = "supply as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem)"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation -> customer nation, with the number of lines between them."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    return (
        li.select("l_orderkey", "l_suppkey")
        .join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        .join(c.select("c_custkey", "c_nationkey"), "c_custkey")
        .join(s.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .groupBy(F.col("s_nationkey").cast("bigint").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst"))
        .count()
    )


TRADE_SQL = """trade as (
  select cast(s_nationkey as bigint) as src, cast(c_nationkey as bigint) as dst, count(*) as count
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  group by 1, 2)"""
