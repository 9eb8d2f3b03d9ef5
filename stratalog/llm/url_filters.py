"""URL filter lists as a sort-merge range join over reversed-host keys; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import free_names, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``: a host and its subdomains are exactly the keys with its key as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(events: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """The rows of events without payload, each with ``open``: keys and payload of the last row before it that has one.

    Rows are sorted by the keys over ranges, payloads before others of the same
    keys; each range carries on with what the ranges before have left open,
    which is one row for each range.
    """
    order = [*(F.col(k) for k in keys), F.col(payload).isNull()]
    ranged = store(events.repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "sweep")
    here = F.when(F.col(payload).isNotNull(), F.struct(*keys, payload))
    within = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    handed = ranged.groupBy("run").agg(F.max(here).alias("top")).select("run", F.max("top").over(earlier).alias("carried"))
    swept = ranged.withColumn("top", F.last(here, ignorenulls=True).over(within)).where(F.col(payload).isNull()).join(F.broadcast(handed), "run")
    return swept.withColumn("open", F.coalesce("top", "carried")).drop("run", "top", "carried", payload)


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """host, path, deciding rule and verdict of every row of pages.

    rules: (host, path, verdict). A rule fits its host and all subdomains if
    the URL's path starts with its path; the longest (host and path together)
    decides, among equally long ones the greater verdict (``block`` over
    ``allow``). Without a fitting rule the verdict is ``default`` and the rule
    null. A null URL, or one without ``://``, has an empty host and path, which
    no rule fits; a null path of a rule is an empty one. Rows repeat as they
    stand in pages; an empty table of either kind is fine, other columns are
    not read, and result columns step aside where the id has their name.

    Two sweeps over sorted keys. Reversed-host keys make each rule host an
    interval of keys, and these nest: the last rule host opened, with the rule
    hosts around it, is all that can hold a host. Under each of these the rules
    are intervals of paths, and they nest too: the last rule opened, with the
    rules that are prefixes of it, is all that can hold a URL. What a row
    carries is such a stack, as deep as a host has labels or a path has
    characters at most, however many rules there are; sorting by range spreads
    a host with very many pages or rules by its paths. Equal URLs are swept once.
    """
    host_, path_, rule_, verdict_ = free_names([id_col], "host", "path", "rule", "verdict")
    seen = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    listed = rules.where("host is not null and host != ''").select(
        host_key(F.translate("host", UPPER, LOWER)).alias("around"), F.coalesce("path", F.lit("")).alias("own"), "host", "verdict"
    )
    text = F.concat("host", "own")
    listed = store(listed.groupBy("around", "own").agg(F.max(F.struct(F.length(text).alias("length"), F.col("verdict"), text.alias("rule"))).alias("entry")), "rules")

    # hosts under rule hosts
    opened = listed.select(F.col("around").alias("key")).distinct()
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    upward = opened.select("key", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("depth"), labels.alias("labels"))
    upward = upward.select("key", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("depth")), "."), F.lit(".")).alias("around"))
    stacks = upward.join(opened.withColumnRenamed("key", "around"), "around", "left_semi").groupBy("key").agg(F.collect_list("around").alias("stack"))
    hosts = seen.select("host").where("host != ''").distinct().select(host_key(F.col("host")).alias("key"), "host", F.lit(None).cast("array<string>").alias("stack"))
    under = sweep(stacks.select("key", F.lit(None).cast("string").alias("host"), "stack").unionByName(hosts), ["key"], "stack")
    under = under.select("host", F.filter("open.stack", lambda s: F.startswith(F.col("key"), s)).alias("arounds")).where(F.size("arounds") > 0)

    # paths under the rules of each of these
    prefix = F.explode(F.sequence(F.lit(0), F.length("own"))).alias("size")
    chains = listed.select("around", F.col("own").alias("whole"), prefix).withColumn("own", F.expr("substring(whole, 1, size)"))
    chains = chains.join(listed, ["around", "own"]).groupBy("around", F.col("whole").alias("path")).agg(F.collect_list(F.struct("own", "entry")).alias("chain"))
    urls = seen.select("host", "path").distinct().join(under, "host").select(F.explode("arounds").alias("around"), "path", "host")
    nothing = F.lit(None).cast(chains.schema["chain"].dataType)
    swept = sweep(chains.withColumn("host", F.lit(None).cast("string")).unionByName(urls.withColumn("chain", nothing)), ["around", "path"], "chain")
    fitting = F.filter("open.chain", lambda c: F.startswith(F.col("path"), c["own"]))
    swept = swept.where("open.around = around").select("host", "path", F.array_max(F.transform(fitting, lambda c: c["entry"])).alias("entry"))
    best = swept.where("entry is not null").groupBy("host", "path").agg(F.max("entry").alias("best"))
    return seen.join(best, ["host", "path"], "left").select(
        F.col("_id").alias(id_col), F.col("host").alias(host_), F.col("path").alias(path_), F.col("best.rule").alias(rule_), F.coalesce("best.verdict", F.lit(default)).alias(verdict_)
    )
