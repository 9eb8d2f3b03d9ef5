"""Usage, coverage, flows, truth points and rankings over extracted structure."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diff import sorted_digest
from .graph import degrees, reach

BROADCAST_BYTES = 32 << 20

def usage_spread(reads: DataFrame, key: str, by: str, samples: int = 3, low: int = 2) -> DataFrame:
    """(key, reads, readers, low, samples): how often and by how many readers a name is read; low below ``low`` readers."""
    per = reads.groupBy(key, by).agg(F.count("*").alias("n"))
    first = per.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(by)))
    shown = F.when(F.col("_k") <= samples, F.col(by).cast("string"))
    out = first.groupBy(key).agg(F.sum("n").alias("reads"), F.count("*").alias("readers"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= samples, F.struct("_k", shown.alias("v"))))), lambda x: x["v"]), ",").alias("samples"))
    return out.select(key, "reads", "readers", (F.col("readers") < low).alias("low"), "samples")


def test_links(sources: DataFrame, tests: DataFrame, imports: DataFrame, reexports: DataFrame | None = None) -> DataFrame:
    """(file, test) of tests that cover a source: by stem (file, stem), by import (src, dst), or by importing a file that re-exports it."""
    by_name = sources.select("file", "stem").join(tests.select(F.col("file").alias("test"), "stem"), "stem").select("file", "test")
    direct = imports.join(tests.select(F.col("file").alias("src")), "src", "left_semi").select(F.col("dst").alias("file"), F.col("src").alias("test"))
    parts = [by_name, direct.join(sources.select("file"), "file", "left_semi")]
    if reexports is not None:
        hop = direct.withColumnRenamed("file", "src").join(reexports.select("src", "dst"), "src").select(F.col("dst").alias("file"), "test")
        parts.append(hop.join(sources.select("file"), "file", "left_semi"))
    return reduce(DataFrame.unionByName, parts).distinct()


def coverage(sources: DataFrame, links: DataFrame) -> DataFrame:
    """One row: files, tested, covered_x1000 (0 without files)."""
    tested = sources.select("file").distinct().join(links.select("file").distinct().withColumn("t", F.lit(1)), "file", "left")
    return tested.agg(F.count("*").alias("files"), F.coalesce(F.sum("t"), F.lit(0)).alias("tested")).select("files", "tested", F.when(F.col("files") > 0, F.floor(F.col("tested") * 1000 / F.col("files") + 0.5)).otherwise(0).cast("bigint").alias("covered_x1000"))


def flows(calls: DataFrame, entries: DataFrame, sinks: DataFrame, depth: int = 8) -> DataFrame:
    """(node, sink, depth): sinks (node, sink) that some entry (node) reaches in up to ``depth`` calls, with the fewest."""
    near = reach(calls.select("src", "dst"), entries.select("node"), depth)
    return near.join(sinks, "node").select("node", "sink", "depth").distinct()


def downstream(emits: DataFrame, listeners: DataFrame) -> DataFrame:
    """(entry, event, listener): the entries that a flow sets off in turn, one event further: its emits (entry, event) met by listeners (entry, event)."""
    heard = listeners.select(F.col("entry").alias("listener"), "event").distinct()
    return emits.select("entry", "event").distinct().join(heard, "event").where("entry != listener").select("entry", "event", "listener")


def merge_partials(parts: DataFrame, key: str, sums: list[str] = (), maxima: list[str] = (), sets: list[str] = (), maps: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """One row for each key from partial results of any number of workers: numbers added or maximised, sets united, maps of counts added up, lists appended and sorted.

    Each fold is associative and commutative, so parts may come in any order
    and are folded before they are shuffled where that makes them smaller.
    """
    flat = lambda c: F.flatten(F.collect_list(c))
    folds = [*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima), *(F.array_sort(F.array_distinct(flat(c))).alias(c) for c in sets), *(F.array_sort(flat(c)).alias(c) for c in lists)]
    out = parts.groupBy(key).agg(*folds) if folds else parts.select(key).distinct()
    for c in maps:  # by entry, so that a large map is never held by one row of a shuffle
        entries = parts.select(key, F.explode(c).alias("_k", "_v")).groupBy(key, "_k").agg(F.sum("_v").alias("_v"))
        folded = entries.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(c))
        out = out.join(folded, key, "left")
    return out


def truth_points(signals: DataFrame) -> DataFrame:
    """(concept, writers, readers, canonical): sorted file lists of each concept's write and read signals (concept, file, role); canonical if one file alone writes it."""
    s = signals.select("concept", "file", "role").distinct()
    pick = lambda role: F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("file").cast("string")))), ",")
    return s.groupBy("concept").agg(pick("write").alias("writers"), pick("read").alias("readers"), (F.count(F.when(F.col("role") == "write", 1)) == 1).alias("canonical"))


def extract_candidates(functions: DataFrame, edges: DataFrame, least: int = 50) -> DataFrame:
    """(node, loc, score_x1000): long functions (node, loc), weighed by how many call them: loc (1 + fan-in / 5)."""
    d = degrees(edges).select("node", "fan_in")
    f = functions.where(F.col("loc") >= least).join(d, "node", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    return f.select("node", "loc", (F.col("loc") * 1000 + F.col("loc") * F.col("fan_in") * 200).cast("bigint").alias("score_x1000"))


def untested_ranking(files: DataFrame, edges: DataFrame, tested: DataFrame, writers: DataFrame, critical: bool = False) -> DataFrame:
    """(file, fan_in, score) of files without a test: 4, 2 or 1 for 20, 5 or 1 importers, and 5 more for a writer of shared state; ``critical`` keeps 3 and more."""
    d = degrees(edges).select(F.col("node").alias("file"), "fan_in")
    left = files.select("file").distinct().join(tested.select("file"), "file", "left_anti").join(d, "file", "left").join(writers.select("file").distinct().withColumn("w", F.lit(5)), "file", "left")
    n = F.coalesce("fan_in", F.lit(0)).cast("bigint")
    score = F.when(n >= 20, 4).when(n >= 5, 2).when(n >= 1, 1).otherwise(0) + F.coalesce("w", F.lit(0))
    out = left.select("file", n.alias("fan_in"), score.cast("bigint").alias("score")).where("score > 0")
    return out.where("score >= 3") if critical else out


def anchor_matches(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(anchor, file): a document's anchor names a file by its whole path, by a suffix after a slash, or by a glob with ``*``.

    Whole paths and suffixes join on equality, over the suffixes of each path.
    A star stays within one part of a path, so an anchor with stars has as many
    parts as its files, and the two meet on that number and on the longest part
    without a star, where there is one; only then is the pattern tried.
    """
    parts = F.split("file", "/")
    ends = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("anchor"))
    size = anchors.agg(F.sum(F.octet_length("anchor") + 64)).head()[0] or 0
    few = lambda a: F.broadcast(a) if size <= BROADCAST_BYTES else a.hint("merge")  # noqa: E731 - never the exploded paths, which plans take for no larger than the files
    plain = ends.join(few(anchors.where(~F.col("anchor").contains("*")).select("anchor").distinct()), "anchor").select("anchor", "file")
    stars = anchors.where(F.col("anchor").contains("*")).select("anchor").distinct()
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("anchor", r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", "[^/]*"), F.lit("$"))
    pieces = F.split("anchor", "/")
    fixed = F.filter(F.transform(pieces, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))), lambda p: ~p["x"].contains("*"))
    keyed = stars.withColumns({"re": pattern, "_n": F.size(pieces), "_f": F.array_max(fixed)}).withColumns({"_i": F.coalesce("_f.i", F.lit(-1)), "_x": F.coalesce("_f.x", F.lit(""))})
    places = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("x"))), F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))))
    cut_up = files.select("file", F.size(parts).alias("_n"), F.explode(places).alias("p")).select("file", "_n", F.col("p.i").alias("_i"), F.col("p.x").alias("_x"))
    starred = cut_up.join(few(keyed), ["_n", "_i", "_x"]).where(F.regexp("file", F.col("re"))).select("anchor", "file")
    return plain.unionByName(starred).distinct()


def stale_mentions(lines: DataFrame, known: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(name, mentions) of names that documents mention (first group of ``pattern``) and that are not known (name)."""
    said = lines.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("name"))
    return said.groupBy("name").agg(F.count("*").alias("mentions")).join(known.select("name"), "name", "left_anti")


def deprecated_calls(declared: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, name, count): callers of names declared deprecated (name)."""
    return calls.join(declared.select("name").distinct(), "name", "left_semi").groupBy("src", "name").agg(F.count("*").alias("count"))


def ranked_counts(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by..., count): the k largest groups; ties by name."""
    return df.groupBy(*by).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *by).limit(k)


def tensions(kinds: dict[str, DataFrame], caps: dict[str, int], order: str = "node") -> DataFrame:
    """(kind, node) of several kinds of findings, each up to its cap in order: a report, not a filter."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col(order).cast("string").alias("node")).distinct().orderBy("node").limit(caps[kind]) for kind, df in kinds.items()])


def suggestions(lists: dict[str, tuple[DataFrame, str]], k: int) -> DataFrame:
    """(kind, node, score) of several scored lists, the k best of each; ties by node."""
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(kind).alias("kind"), F.col("node").cast("string").alias("node"), F.col(score).cast("bigint").alias("score")).orderBy(F.desc("score"), "node").limit(k) for kind, (df, score) in lists.items()],
    )


def repeat_reads(uses: DataFrame, hubs: DataFrame, least: int = 3) -> DataFrame:
    """(session, node, reads) of hubs (node) that one session reads ``least`` times or more."""
    return uses.join(hubs.select("node").distinct(), "node", "left_semi").groupBy("session", "node").agg(F.count("*").alias("reads")).where(F.col("reads") >= least)


def structural_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, value): the number of rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in tables.items()])


def diff_counters(before: dict[str, tuple[DataFrame, list[str]]], after: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(counter, value): rows added, removed and changed in each kind of structure, zeros included.

    A kind is a table and the columns that identify its rows; its other columns
    are what can change. Tables are compared by one join on the key, so counters
    of any number of kinds are one union.
    """
    out = []
    for kind, (old, keys) in before.items():
        new, _ = after[kind]
        rest = [c for c in old.columns if c not in keys]
        tag = lambda df, side: df.select(*keys, F.xxhash64(F.lit(0), *rest).alias(side)).dropDuplicates(keys)  # noqa: B023, E731
        both = tag(old, "_b").join(tag(new, "_a"), keys, "full_outer")
        counts = both.agg(
            F.count(F.when(F.col("_b").isNull(), 1)).alias("added"), F.count(F.when(F.col("_a").isNull(), 1)).alias("removed"), F.count(F.when(F.col("_a") != F.col("_b"), 1)).alias("changed")
        )
        out.append(counts.select(F.explode(F.array(*(F.struct(F.lit(f"{kind} {c}").alias("counter"), F.col(c).alias("value")) for c in ("added", "removed", "changed")))).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, out)


def structural_checks(before: dict[str, DataFrame], after: dict[str, DataFrame], drop: float = 0.1) -> DataFrame:
    """(check, subject) of the five regressions.

    Tables of each side: cycles (id, gated), dead and orphan (concept, state),
    canonical (concept, canonical), signatures (file, name).
    """
    fresh = lambda name, keys: after[name].select(*keys).distinct().join(before[name].select(*keys), keys, "left_anti")
    state = F.concat_ws(".", "concept", "state")
    cycles = after["cycles"].where(~F.col("gated")).select("id").distinct().join(before["cycles"].where(~F.col("gated")).select("id"), "id", "left_anti")
    lost = before["canonical"].where("canonical").select("concept").join(after["canonical"].where("canonical").select("concept"), "concept", "left_anti")
    per = lambda t: t["signatures"].agg((F.count("*") / F.greatest(F.count_distinct("file"), F.lit(1))).alias("r"))
    fell = per(before).select(F.col("r").alias("b")).join(per(after).select(F.col("r").alias("a")), F.lit(True)).where(F.col("b") > 0).where((F.col("b") - F.col("a")) / F.col("b") >= drop)
    rows = lambda check, df, subject: df.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"))
    return reduce(
        DataFrame.unionByName,
        [
            rows("new-cycle", cycles, F.col("id")),
            rows("new-dead-state", fresh("dead", ["concept", "state"]), state),
            rows("new-orphan-state", fresh("orphan", ["concept", "state"]), state),
            rows("lost-canonical", lost, F.col("concept")),
            rows("signature-coverage", fell, F.lit("all")),
        ],
    )


def signature_code(params: Column, kind: Column, returns: Column, lines: Column) -> Column:
    """A signature as 12 bits: parameters (4), kind (2), class of the result (3), log2 of the lines (3)."""
    count = F.least(params, F.lit(15)).cast("long")
    of_kind = F.when(kind == "function", 0).when(kind == "method", 1).when(kind == "arrow", 2).otherwise(3).cast("long")
    low = F.lower(F.coalesce(returns, F.lit("")))
    of_result = F.when(low == "", 0).when(low.isin("void", "undefined", "never"), 1).when(low.startswith("promise"), 2).when(low == "boolean", 3).when(low == "number", 4).when(low == "string", 5).when(low.endswith("[]") | low.startswith("array"), 6).otherwise(7).cast("long")
    size = F.least(F.floor(F.log2(F.greatest(lines, F.lit(1)))), F.lit(7)).cast("long")
    return F.shiftleft(count, 8).bitwiseOR(F.shiftleft(of_kind, 6)).bitwiseOR(F.shiftleft(of_result, 3)).bitwiseOR(size)


def least_squares(df: DataFrame, features: list[str], target: str) -> dict[str, float]:
    """Coefficients (and ``intercept``) of the linear model with the least squared error.

    One aggregate gives the normal equations, whose size is that of the
    features; equations without a unique solution give the shortest one.
    """
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y = F.col(target).cast("double")
    rows = df.dropna(subset=[*features, target])
    sums = [F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]] + [F.sum(a * y) for a in columns]
    got = [v or 0.0 for v in rows.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).head()]
    n = len(columns)
    gram, it = np.zeros((n, n)), iter(got)
    for i in range(n):
        for j in range(i, n):
            gram[i, j] = gram[j, i] = next(it)
    solved = np.linalg.lstsq(gram, np.array(list(it)), rcond=None)[0]
    return dict(zip(["intercept", *features], map(float, solved), strict=True))


def input_hash(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """(group, hash): order-free hash of each group's distinct rows; equal hashes mean that nothing needs computing again."""
    one = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns)).cast("binary"), 256)
    return sorted_digest(rows.select(F.col(group), one.alias("id")), group, "id", "hash").drop("n")


def memory_id(kind: Column, fingerprint: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", kind, fingerprint).cast("binary")), 1, 12)


def recall(entries: DataFrame, scope: str | None = None, kind: str | None = None) -> DataFrame:
    """Entries (id, kind, fingerprint, reason, scope, added, obsolete) that hold, of one scope or kind if asked for."""
    out = entries.where("obsolete is null")
    if scope is not None:
        out = out.where(F.col("scope") == scope)
    return out if kind is None else out.where(F.col("kind") == kind)


def mark_obsolete(entries: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Entries with the given ids (id) marked; those marked already keep their time."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return entries.join(hit, "id", "left").withColumn("obsolete", F.when(F.col("_hit"), F.coalesce(F.col("obsolete"), at)).otherwise(F.col("obsolete"))).drop("_hit")


def node_detail(node: str, nodes: DataFrame, edges: DataFrame, pairs: DataFrame, k: int = 20) -> DataFrame:
    """(section, other, value) of one node: its status, edges in and out, and its k closest co-changing files."""
    own = nodes.where(F.col("node") == node).select(F.lit("status").alias("section"), F.col("status").alias("other"), F.lit(0).cast("long").alias("value"))
    out = edges.where(F.col("src") == node).groupBy(F.col("dst").alias("other")).agg(F.count("*").alias("value")).select(F.lit("out").alias("section"), "other", "value")
    into = edges.where(F.col("dst") == node).groupBy(F.col("src").alias("other")).agg(F.count("*").alias("value")).select(F.lit("in").alias("section"), "other", "value")
    near = pairs.where((F.col("a") == node) | (F.col("b") == node)).select(F.lit("cochange").alias("section"), F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a")).alias("other"), F.col("jaccard_x100").cast("long").alias("value"))
    return own.unionByName(out).unionByName(into).unionByName(near.orderBy(F.desc("value"), "other").limit(k))
