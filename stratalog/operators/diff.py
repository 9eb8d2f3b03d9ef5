"""Snapshots compared, ratchets, and a content-addressed fact store."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import scratch_path, store


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], watched: list[str]) -> DataFrame:
    """keys and change (added, removed, changed) of rows that differ; keys are unique on each side."""
    b = before.select(*keys, F.struct(*(watched or keys)).alias("_b"))
    a = after.select(*keys, F.struct(*(watched or keys)).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return b.join(a, keys, "full_outer").select(*keys, change.alias("change")).where("change is not null")


def array_diff(before: DataFrame, after: DataFrame, key: str, items: str) -> DataFrame:
    """(key, added, removed) of set-valued columns, both sorted."""
    b, a = before.select(key, F.col(items).alias("b")), after.select(key, F.col(items).alias("a"))
    none = F.array().cast(before.schema[items].dataType)
    both = b.join(a, key, "full_outer").select(key, F.coalesce("b", none).alias("b"), F.coalesce("a", none).alias("a"))
    out = both.select(key, F.array_sort(F.array_except("a", "b")).alias("added"), F.array_sort(F.array_except("b", "a")).alias("removed"))
    return out.where("size(added) + size(removed) > 0")


def new_violations(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of current that the baseline lacks."""
    return current.select(*keys).distinct().join(baseline.select(*keys), keys, "left_anti")


def signature_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, reason) of breaking changes; params array<struct<name,type,optional>>, returns string."""
    both = before.select(key, F.col("params").alias("pb"), F.col("returns").alias("rb")).join(after.select(key, F.col("params").alias("pa"), F.col("returns").alias("ra")), key)
    at = lambda i: F.get(F.col("pa"), i)
    indexed = F.transform(F.col("pb"), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    reasons = F.array(
        F.when(F.size("pa") < F.size("pb"), "param removed"),
        F.when(F.exists(indexed, lambda x: at(x["i"])["type"] != x["p"]["type"]), "type changed"),
        F.when(F.exists(indexed, lambda x: x["p"]["optional"] & ~at(x["i"])["optional"]) | F.exists(F.filter(F.col("pa"), lambda p, i: i >= F.size("pb")), lambda p: ~p["optional"]), "became required"),
        F.when(~F.col("ra").eqNullSafe(F.col("rb")), "return changed"),
    )
    return both.select(key, F.explode(F.array_compact(reasons)).alias("reason"))


def coverage_drop(before: DataFrame, after: DataFrame, least: float = 0.10) -> DataFrame:
    """(metric, before, after) of totals (metric, value) that fell by ``least`` or more."""
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric")
    return both.where((F.col("before") > 0) & ((F.col("before") - F.col("after")) / F.col("before") >= least))


def canonical_json(*columns: str) -> Column:
    """A JSON object of the columns with sorted keys; nulls are written."""
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))) for c in sorted(columns)]
    parts = [F.when(F.col(c).isNull(), F.lit(f'"{c}":null')).otherwise(p) for c, p in zip(sorted(columns), parts, strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fact_ids(df: DataFrame, relation: str, columns: list[str]) -> DataFrame:
    """df with id: SHA-256 of the relation, a NUL and the canonical JSON of the row."""
    return df.withColumn("id", F.sha2(F.concat(F.lit(relation), F.lit("\0"), canonical_json(*columns)).cast("binary"), 256))


class Sha256:
    """SHA-256 whose state is bytes, so that one task can carry on where another has ended: OpenSSL's SHA256_Init, _Update and _Final."""

    def __init__(self, state: bytes | None = None):
        self.lib = ctypes.CDLL(ctypes.util.find_library("crypto"))
        self.context = ctypes.create_string_buffer(state or bytes(112), 112)  # SHA256_CTX is 28 words
        if state is None:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.context.raw, 112))
        return out.raw.hex()

    @staticmethod
    def there() -> bool:
        """Whether OpenSSL's library is found and does as hashlib."""
        try:
            first = Sha256()
            first.update(b"a" * 100)
            second = Sha256(first.context.raw)
            second.update(b"b")
            return second.hexdigest() == hashlib.sha256(b"a" * 100 + b"b").hexdigest()
        except (OSError, AttributeError, TypeError):
            return False


def sorted_digest(rows: DataFrame, group: str, item: str, alias: str, each: int = 1_000_000) -> DataFrame:
    """(group, n, alias): SHA-256 of each group's distinct items, sorted and joined by line ends.

    A digest of an order is sequential by nature. A group of up to ``each``
    items is sorted by Spark, which spills, and streams through one task that
    holds nothing of it. Larger ones are dealt into ranges of about as many,
    and a task for each range, one after the other, carries on with the state
    that the last one has left, so that what a task reads does not grow with
    the group. Without OpenSSL's library these too stream through one task.
    """
    items = store(rows.select(group, item).distinct(), "items")
    sizes = items.groupBy(group).agg(F.count("*").alias("n")).where((F.col("n") > each) & F.col(group).isNotNull())
    large = [tuple(r) for r in sizes.collect()] if Sha256.there() else []
    if not large:
        return _digests_in_task(items, group, item, alias)
    hit = F.coalesce(F.col(group).isin([g for g, _ in large]), F.lit(False))
    done = _digests_by_range(items.where(hit), group, item, -(-sum(n for _, n in large) // each))
    kind = rows.schema[group].dataType.simpleString()
    return _digests_in_task(items.where(~hit), group, item, alias).unionByName(rows.sparkSession.createDataFrame(done, f"`{group}` {kind}, n long, {alias} string"))


def _digests_by_range(items: DataFrame, group: str, item: str, parts: int) -> list[tuple]:
    """(group, n, digest) of each group; only states of 112 bytes come to the driver."""
    spark, path = items.sparkSession, scratch_path(items.sparkSession, "ranges")
    ranged = items.select(group, item).repartitionByRange(parts, group, item).withColumn("_run", F.spark_partition_id())
    ranged.write.partitionBy("_run").parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    kind, done, now, n, state = items.schema[group].dataType, [], None, 0, None

    def carry(now: object, n: int, state: bytes | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, out = Sha256(state), []
        for batch in batches:
            keys, texts, end = batch.column(0), batch.column(1), 0
            runs = [(keys[0].as_py(), len(keys))] if len(keys) and keys[0] == keys[-1] else [(k, sum(1 for _ in g)) for k, g in groupby(keys.to_pylist())]
            for key, size in runs:
                if n and key != now:
                    out.append((now, n, None, sha.hexdigest()))
                    n, sha = 0, Sha256()
                sha.update(b"\n" * (n > 0) + "\n".join(texts.slice(end, size).to_pylist()).encode())
                now, n, end = key, n + size, end + size
        out.append((now, n, sha.context.raw, None))
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], to_arrow_type(kind)), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.binary(), pa.string()), strict=True))], names=[group, "n", "state", "digest"])

    for run in sorted(r[0] for r in ranged.select("_run").distinct().collect()):
        own = ranged.where(F.col("_run") == run).select(group, item).coalesce(1).sortWithinPartitions(group, item)
        found = own.mapInArrow(lambda b, x=(now, n, state): carry(*x, b), f"`{group}` {kind.simpleString()}, n long, state binary, digest string").collect()
        done += [(g, m, digest) for g, m, _, digest in found[:-1]]
        now, n, state = found[-1][0], found[-1]["n"], bytes(found[-1]["state"])
    last = Sha256(state)
    return [*done, (now, n, last.hexdigest())]


def _digests_in_task(items: DataFrame, group: str, item: str, alias: str) -> DataFrame:
    kind = items.schema[group].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state, out = None, 0, hashlib.sha256(), []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and key != now:
                    out.append((now, n, state.hexdigest()))
                    n, state = 0, hashlib.sha256()
                now = key
                state.update(b"\n" + text.encode() if n else text.encode())
                n += 1
        out += [(now, n, state.hexdigest())] if n else []
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=[group, "n", alias])

    batch_type = to_arrow_type(items.schema[group].dataType)
    ordered = items.select(group, item).repartition(group).sortWithinPartitions(group, item)
    return ordered.mapInArrow(digest, f"`{group}` {kind}, n long, {alias} string")


def head(ids: DataFrame) -> DataFrame:
    """(relation, n, set_hash): order-free hash of each relation's distinct ids."""
    return sorted_digest(ids, "relation", "id", "set_hash")


def append_new(store: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts (with id) that the store has not, once each."""
    return facts.dropDuplicates(["id"]).join(store.select("id"), "id", "left_anti")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) between two sets of ids."""
    b, a = before.select("id").distinct(), after.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, "id", "left_anti").withColumn("change", F.lit("removed")))


def compact(store: DataFrame, bases: DataFrame, keep: int = 10) -> DataFrame:
    """The stored facts that one of the last ``keep`` bases (base, id) refers to."""
    last = bases.select("base").distinct().orderBy(F.desc("base")).limit(keep)
    used = bases.join(F.broadcast(last), "base", "left_semi").select("id").distinct()
    return store.join(used, "id", "left_semi")


def needs_compaction(stored: int, used: int, size_bytes: int, orphans: float = 0.3, most_bytes: int = 50 << 20) -> bool:
    return size_bytes > most_bytes or (stored > 0 and (stored - used) / stored > orphans)


def upsert(entries: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key by ``order``; a change with an equal order wins over an entry."""
    both = entries.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")
