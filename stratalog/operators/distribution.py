"""Entropy, divergence, concentration, similarity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import thousandths
from ..session import cut, parts_for, running_sums, store


def entropy(df: DataFrame, key: str, value: str, min_total: int = 3) -> DataFrame:
    """(key, entropy_x1000, total, n_values): base-2 entropy of the values of each key with ``min_total`` rows or more."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    # sum of p log p from counts: log2(t) - sum(n log2 n) / t, so one pass over the counts is enough
    return (
        counts.groupBy(key)
        .agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.count("*").alias("n_values"))
        .where(F.col("total") >= min_total)
        .select(key, thousandths(F.log2("total") - F.col("s") / F.col("total")).alias("entropy_x1000"), "total", "n_values")
    )


def kl_divergence(after: DataFrame, before: DataFrame, key: str, target: str, weight: str = "n") -> DataFrame:
    """(key, kl_x1000): natural-log divergence of after from before over the union of targets, each count plus one; keys without rows after are left out."""
    a = after.groupBy(key, target).agg(F.sum(weight).alias("a"))
    b = before.groupBy(key, target).agg(F.sum(weight).alias("b"))
    both = a.join(b, [key, target], "full_outer").select(key, target, (F.coalesce("a", F.lit(0)) + 1).alias("p"), (F.coalesce("b", F.lit(0)) + 1).alias("q"), F.col("a").isNotNull().alias("seen"))
    w = Window.partitionBy(key)
    terms = both.withColumns({"tp": F.sum("p").over(w), "tq": F.sum("q").over(w), "any": F.max("seen").over(w)}).where("any")
    share = F.col("p") / F.col("tp")
    return terms.groupBy(key).agg(thousandths(F.sum(share * F.ln(share / (F.col("q") / F.col("tq"))))).alias("kl_x1000"))


def pareto_rank(df: DataFrame, group: str, key: str, weight: str, share: float = 0.8) -> DataFrame:
    """(group, rank, keys): how many of a group's heaviest keys hold ``share`` of its weight."""
    totals = df.groupBy(group).agg(F.sum(weight).alias("total"), F.count("*").alias("keys")).select(F.col(group).alias("_g"), "total", "keys")
    run = running_sums(df.select(group, key, weight), [group], [F.desc(weight), F.col(key)], rank=F.lit(1), running=F.col(weight))
    held = run.join(totals, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("running") >= share * F.col("total"))
    return held.groupBy(group).agg(F.min("rank").cast("bigint").alias("rank"), F.max("keys").alias("keys"))


def wasserstein(after: DataFrame, before: DataFrame, group: str, key: str, weight: str) -> DataFrame:
    """(group, distance_x1000): summed difference of the running weights over keys in binary order, by the larger mass. The value depends on that order."""
    a = after.groupBy(group, key).agg(F.sum(weight).alias("a"))
    b = before.groupBy(group, key).agg(F.sum(weight).alias("b"))
    both = a.join(b, [group, key], "full_outer").na.fill(0, ["a", "b"])
    run = running_sums(both, [group], [F.col(key)], gap=F.col("a") - F.col("b")).withColumn("gap", F.abs("gap"))
    out = run.groupBy(group).agg(F.sum("gap").alias("work"), F.greatest(F.sum("a"), F.sum("b")).alias("mass"))
    return out.select(group, F.when(F.col("mass") > 0, thousandths(F.col("work") / F.col("mass"))).otherwise(0).alias("distance_x1000"))


def movers(after: DataFrame, before: DataFrame, key: str, weight: str, k: int) -> DataFrame:
    """(direction, key, change): the k keys that gained most and the k that lost most."""
    a = after.groupBy(key).agg(F.sum(weight).alias("a"))
    b = before.groupBy(key).agg(F.sum(weight).alias("b"))
    change = a.join(b, key, "full_outer").select(key, (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("change"))
    up = change.where("change > 0").orderBy(F.desc("change"), key).limit(k).select(F.lit("gain").alias("direction"), key, "change")
    down = change.where("change < 0").orderBy("change", key).limit(k).select(F.lit("loss").alias("direction"), key, "change")
    return up.unionByName(down)


def coverage_drift(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str] = ("only_a", "only_b")) -> DataFrame:
    """Keys of one side that the other lacks, with the side."""
    left = a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti").withColumn("side", F.lit(names[0]))
    return left.unionByName(b.select(*keys).distinct().join(a.select(*keys), keys, "left_anti").withColumn("side", F.lit(names[1])))


def edge_distance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: edges only in a, only in b, in either, and the share of the differing ones times 1000."""
    x = a.select(*keys).distinct().withColumn("x", F.lit(1)).join(b.select(*keys).distinct().withColumn("y", F.lit(1)), keys, "full_outer")
    s = x.agg(F.count(F.when(F.col("y").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("x").isNull(), 1)).alias("only_b"), F.count("*").alias("total"))
    return s.withColumn("distance_x1000", F.when(F.col("total") > 0, thousandths((F.col("only_a") + F.col("only_b")) / F.col("total"))).otherwise(0))


def hamming_pairs(df: DataFrame, id_col: str, code: str, block: list[str], most: int) -> DataFrame:
    """(a, b, distance) of rows in one block whose codes differ in at most ``most`` bits.

    Distinct codes meet each other within their block; rows come in afterwards,
    so a block of many equal codes is not paired with itself code by code. The
    pairs are counted first, from the codes' frequencies: small sides make many
    of them, so they and not the sides say how many tasks spell them out.
    """
    codes = cut(df.groupBy(*block, code).agg(F.count("*").alias("n")))
    l, r = codes.select(*block, F.col(code).alias("ca"), F.col("n").alias("na")), codes.select(*block, F.col(code).alias("cb"), F.col("n").alias("nb"))
    near = l.join(r, block).where(F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= most)
    pairs = near.agg(F.sum(F.col("na") * F.col("nb"))).head()[0] or 0
    tasks = min(parts_for(pairs, df.sparkSession, 5_000_000), 4096)
    a = df.select(*block, F.col(id_col).alias("a"), F.col(code).alias("ca"))
    b = df.select(*block, F.col(id_col).alias("b"), F.col(code).alias("cb"))
    out = a.join(near.drop("na", "nb"), [*block, "ca"]).repartition(tasks, *block, "cb").join(b, [*block, "cb"]).where("a < b")
    return out.select("a", "b", F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))).cast("bigint").alias("distance"))


def compressed_length(text: Column) -> Column:
    """Length of the text under zlib level 6."""

    @F.pandas_udf("long")
    def length(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: len(zlib.compress((t or "").encode(), 6)))

    return length(text)


def compression_distance(df: DataFrame, id_col: str, name: str, text: str, bucket: tuple[int, int] = (2, 20), ratio: tuple[float, float] = (0.4, 2.5), most: float = 0.7) -> DataFrame:
    """(a, b, ncd_x1000) of texts with one name: buckets of 2 to 20 rows, sizes not too far apart, distance up to ``most``. Ids are unique.

    Pairs are made of ids and compressed lengths, and only those of like
    lengths fetch their texts.
    """
    own = df.select(name, F.col(id_col).alias("i"), F.col(text).alias("t"))
    few = own.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n").between(*bucket)).select(name)
    sizes = store(own.join(few, name, "left_semi").select(name, "i", compressed_length(F.col("t")).alias("c")), "sizes")
    a, b = (sizes.select(name, F.col("i").alias(f"i{s}"), F.col("c").alias(f"c{s}")) for s in "ab")
    pairs = a.join(b, name).where("ia < ib").where(F.col("ca").cast("double").between(ratio[0] * F.col("cb"), ratio[1] * F.col("cb"))).drop(name)
    for s in "ab":
        pairs = pairs.join(own.select(F.col("i").alias(f"i{s}"), F.col("t").alias(f"t{s}")), f"i{s}")
    joint = pairs.withColumn("cab", compressed_length(F.concat("ta", "tb")))
    ncd = (F.col("cab") - F.least("ca", "cb")) / F.greatest("ca", "cb")
    return joint.where(ncd <= most).select(F.col("ia").alias("a"), F.col("ib").alias("b"), thousandths(ncd).alias("ncd_x1000"))


def nearest_rank(values: str, p: float, kind: str = "bigint") -> Column:
    """The value at floor(n p) of the sorted values of a group, for p below 1; 0 for none.

    percentile_disc takes the value at ceil(n p), counted from one, and p is
    raised a little for the case that n p is whole. It counts equal values before the
    shuffle and holds distinct ones only, so a group may have any number of rows.
    """
    return F.coalesce(F.expr(f"percentile_disc({p + 1e-12!r}D) within group (order by `{values}`)").cast(kind), F.lit(0).cast(kind))


def max_coverage(sets: DataFrame, candidate: str, item: str, weight: str, budget: int = 5) -> DataFrame:
    """(step, candidate, gain): greedy choice of the candidate that adds most uncovered weight; of equals the one that sorts first."""
    spark, rows = sets.sparkSession, []
    left = sets.select(candidate, item, weight).distinct().persist()
    try:
        rest = left
        for step in range(1, budget + 1):
            best = rest.groupBy(candidate).agg(F.sum(weight).alias("gain")).where("gain > 0").orderBy(F.desc("gain"), candidate).limit(1).collect()
            if not best:
                break
            rows.append((step, best[0][0], best[0][1]))
            # what is covered follows from the few candidates chosen, so the plan does not grow with the steps
            covered = left.where(F.col(candidate).isin([r[1] for r in rows])).select(item).distinct()
            rest = left.join(covered, item, "left_anti")
    finally:
        left.unpersist()
    kind = sets.schema[candidate].dataType.simpleString()
    return spark.createDataFrame(rows, f"step int, `{candidate}` {kind}, gain {left.groupBy().agg(F.sum(weight).alias('g')).schema['g'].dataType.simpleString()}")


def timing_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, median, p95, sigma_x1000, spread_x1000) of repeated runs."""
    kind = df.schema[value].dataType.simpleString()
    g = df.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), nearest_rank(value, 0.5, kind).alias("median"), nearest_rank(value, 0.95, kind).alias("p95"), F.stddev_pop(value).alias("s")
    )
    return g.select(key, "n", thousandths(F.col("m")).alias("mean_x1000"), "median", "p95", thousandths(F.col("s")).alias("sigma_x1000"), thousandths(F.ln(F.col("p95") + 1) / F.ln(F.col("median") + 1)).alias("spread_x1000"))


def timing_diff(now: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Change in per cent against the baseline; null without one or where it is not positive."""
    b = base.select(key, F.col(value).alias("_b"))
    return now.join(b, key, "left").select(key, value, F.when(F.col("_b") > 0, F.round((F.col(value) - F.col("_b")) / F.col("_b") * 100, 2)).alias("percent"))
