"""What changes together: commits (idx, file) as sets, ordered by idx."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hundredths, thousandths
from ..session import parts_for, running_sums


def _small(commits: DataFrame, most_files: int) -> DataFrame:
    distinct = commits.select("idx", "file").distinct()
    sizes = distinct.groupBy("idx").agg(F.count("*").alias("n"))
    return distinct.join(sizes.where(F.col("n") <= most_files).select("idx"), "idx", "left_semi")


def cochange_pairs(commits: DataFrame, min_count: int = 3, min_jaccard: float = 0.0, most_files: int = 50, known: DataFrame | None = None) -> DataFrame:
    """(a, b, count, total_a, total_b, jaccard_x100) of files that share ``min_count`` commits.

    Commits of more than ``most_files`` files say nothing and are skipped, which also bounds what a
    commit adds to the self-join. With ``known`` (file), a pair needs one known file, and an unknown
    one has a total of zero.
    """
    c = _small(commits, most_files)
    pairs = c.select("idx", F.col("file").alias("a")).join(c.select("idx", F.col("file").alias("b")), "idx").where("a < b").groupBy("a", "b").agg(F.count("*").alias("count"))
    totals = c.groupBy("file").agg(F.count("*").alias("t"))
    pairs = pairs.where(F.col("count") >= min_count)
    if known is not None:
        totals = totals.join(known.select("file"), "file", "left_semi")
    out = pairs.join(totals.select(F.col("file").alias("a"), F.col("t").alias("total_a")), "a", "left").join(totals.select(F.col("file").alias("b"), F.col("t").alias("total_b")), "b", "left")
    if known is not None:
        out = out.where("total_a is not null or total_b is not null")
    out = out.na.fill(0, ["total_a", "total_b"])
    union = F.col("total_a") + F.col("total_b") - F.col("count")
    jaccard = F.when(union > 0, F.col("count") / union).otherwise(0.0)
    return out.where(jaccard >= min_jaccard).select("a", "b", "count", "total_a", "total_b", hundredths(jaccard).alias("jaccard_x100"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions."""
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "count", F.col("total_b").alias("total_a"), F.col("total_a").alias("total_b"), "jaccard_x100"))


def conditional(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, p_x100): how often a change of a comes with one of b."""
    p = F.col("count") / F.col("total_a")
    return symmetric(pairs).where("total_a > 0").where(p >= least).select("a", "b", hundredths(p).alias("p_x100"))


def log_growth(pairs: DataFrame, min_partners: int = 2) -> DataFrame:
    """(file, growth_x1000, partners): ln of one more than the mean pair count of a file."""
    g = symmetric(pairs).groupBy(F.col("a").alias("file")).agg(F.sum("count").alias("s"), F.count("*").alias("partners")).where(F.col("partners") >= min_partners)
    return g.select("file", thousandths(F.ln(F.col("s") / F.col("partners") + 1)).alias("growth_x1000"), "partners")


def lag_one_excess(commits: DataFrame, min_joint: int = 3, min_excess: float = 0.15, most_files: int = 50) -> DataFrame:
    """(a, b, joint, excess_x1000): how much likelier b changes in the commit after one of a than in any commit.

    Commits are numbered 0 to T-1 without gaps; a's are counted up to T-2, b's over all. Fewer than four commits say nothing.
    Commits of more than ``most_files`` files are skipped, which bounds what two neighbours add to the join.
    """
    rows = commits.count()
    n, m = (parts_for(k * rows, commits.sparkSession) for k in (1, 4))  # two neighbours add a row for each pair of their files
    c = _small(commits.repartition(n, "idx"), most_files)
    span = commits.agg((F.max("idx") + 1).alias("t"))
    after = c.select((F.col("idx") + 1).alias("idx"), F.col("file").alias("a")).repartition(n, "idx")
    follows = after.join(c.select("idx", F.col("file").alias("b")), "idx").where("a != b").select("a", "b").repartition(m, "a", "b").groupBy("a", "b").agg(F.count("*").alias("joint"))
    totals = c.groupBy("file").agg(F.count("*").alias("n"), F.max("idx").alias("last"))
    out = follows.where(F.col("joint") >= min_joint).join(totals.select(F.col("file").alias("a"), F.col("n").alias("na"), "last"), "a").join(totals.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    out = out.join(F.broadcast(span), F.lit(True)).where("t >= 4")  # one row
    drivers = F.col("na") - F.when(F.col("last") == F.col("t") - 1, 1).otherwise(0)
    excess = F.col("joint") / drivers - F.col("nb") / F.col("t")
    return out.select("a", "b", "joint", thousandths(excess).alias("excess_x1000")).where(F.col("excess_x1000") >= int(min_excess * 1000))


def lift(commits: DataFrame, min_count: int = 3, min_lift: float = 2.0, most_files: int = 50) -> DataFrame:
    """(a, b, count, lift_x1000); a file's occurrences count duplicates within a commit, pairs do not, nor commits of more than ``most_files`` files."""
    totals = commits.groupBy("file").agg(F.count("*").alias("n"))
    t = commits.agg(F.count_distinct("idx").alias("t"))
    c = _small(commits, most_files)
    pairs = c.select("idx", F.col("file").alias("a")).join(c.select("idx", F.col("file").alias("b")), "idx").where("a < b").groupBy("a", "b").agg(F.count("*").alias("count"))
    out = pairs.where(F.col("count") >= min_count).join(totals.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(totals.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    out = out.join(F.broadcast(t), F.lit(True))  # one row
    value = F.col("count") * F.col("t") / (F.col("na") * F.col("nb"))
    return out.where(value >= min_lift).select("a", "b", "count", thousandths(value).alias("lift_x1000"))


def direction(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, a_first, b_first): at how many joint commits the one or the other had the older last commit of its own.

    For every pair, its commits are walked in order; at a joint one, the last commits with only the one and only the other are compared.
    """
    c = commits.select("idx", "file").distinct()
    p = pairs.select("a", "b")
    own = p.join(c, F.col("a") == F.col("file")).select("a", "b", "idx", F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    own = own.unionByName(p.join(c, F.col("b") == F.col("file")).select("a", "b", "idx", F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    walk = own.groupBy("a", "b", "idx").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    w = Window.partitionBy("a", "b").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    solo = lambda x, y: F.last(F.when((F.col(x) == 1) & (F.col(y) == 0), F.col("idx")), ignorenulls=True).over(w)
    seen = walk.select("a", "b", "in_a", "in_b", solo("in_a", "in_b").alias("la"), solo("in_b", "in_a").alias("lb")).where("in_a = 1 and in_b = 1")
    return seen.groupBy("a", "b").agg(F.count(F.when(F.col("la") < F.col("lb"), 1)).alias("a_first"), F.count(F.when(F.col("lb") < F.col("la"), 1)).alias("b_first"))


def prune_transitive(edges: DataFrame) -> DataFrame:
    """(src, dst) without those that a path over one other node explains."""
    e = edges.select("src", "dst").distinct()
    two = e.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("src != dst and src != mid and mid != dst").select("src", "dst").distinct()
    return e.join(two, ["src", "dst"], "left_anti")


def commits_from_log(lines: DataFrame, marker: str = "COMMIT") -> DataFrame:
    """(idx, file) from log lines (n, line), newest first: a marker line opens each commit; idx counts from the oldest."""
    opens = F.col("line").startswith(marker)
    numbered = running_sums(lines, [], [F.col("n")], c=F.when(opens, 1).otherwise(0))
    total = numbered.agg(F.max("c").alias("t"))
    files = numbered.where(~opens & (F.trim("line") != "") & (F.col("c") > 0)).join(F.broadcast(total), F.lit(True))
    return files.select((F.col("t") - F.col("c")).alias("idx"), F.trim("line").alias("file"))


def cycle_persistence(snapshots: DataFrame, files: int) -> DataFrame:
    """(cycle, snapshots, ratio_x1000, first, last) over (snapshot, cycle); fewer than three snapshots in all give nothing."""
    g = snapshots.groupBy("cycle").agg(F.count_distinct("snapshot").alias("snapshots"), F.min("snapshot").alias("first"), F.max("snapshot").alias("last"))
    return g.where(F.lit(files >= 3)).select("cycle", "snapshots", thousandths(F.col("snapshots") / F.lit(max(1, files))).alias("ratio_x1000"), "first", "last")


def relation_stability(hashes: DataFrame) -> DataFrame:
    """(relation, unchanged_x1000): share of neighbouring snapshots with the same hash, over (relation, snapshot, hash)."""
    w = Window.partitionBy("relation").orderBy("snapshot")
    steps = hashes.select("relation", F.col("hash").alias("h"), F.lag("hash").over(w).alias("before"), F.row_number().over(w).alias("k")).where("k > 1")
    return steps.groupBy("relation").agg(thousandths(F.count(F.when(F.col("h") == F.col("before"), 1)) / F.count("*")).alias("unchanged_x1000"))
