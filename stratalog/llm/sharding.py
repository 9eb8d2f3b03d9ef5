"""Jump consistent hashing: stable keys to shards without a ring table.

See Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm"
(arXiv:1406.2294).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import free_names, store, with_fields


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key; going from n to n+1 shards moves only the keys that enter shard n."""
    key = keys.astype(np.uint64)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, place and size of every row.

    Returns ``id_col``, size (UTF-8 bytes of the text plus 8), text_crc32, law
    (``key``), shard, slot (gapless from 0 in each shard) and grown_shard (with
    one shard more). Only the key and the number of shards decide the shard: a
    null key has a shard like any other (result columns step aside where it has
    their name), rows with equal keys share one, a null
    text counts as empty. Columns other than the two named are not read.

    The text is reduced to its size and checksum before anything moves. Slots
    need no shuffle of rows: each task numbers its own rows within each shard,
    and the numbers at which the tasks start are sums over a table with one row
    for each task and shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.col(id_col)).alias("_key"),
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, lane = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            key = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            shard, grown = jump(key, shards), jump(key, shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            local = np.empty(len(key), np.int64)
            firsts = np.repeat(np.cumsum(counts) - counts, counts)
            local[order] = np.arange(len(key)) - firsts + begun[shard[order]]
            begun += counts
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(shard), pa.array(grown), pa.array(local), pa.array(np.full(len(key), lane, np.int32))],
                names=["_id", "size", "text_crc32", "shard", "grown_shard", "_local", "_lane"],
            )

    schema = f"_id {kind}, size long, text_crc32 long, shard int, grown_shard int, _local long, _lane int"
    placed = store(slim.mapInArrow(number, schema), "shards")
    ends = placed.groupBy("shard", "_lane").agg((F.max("_local") + 1).alias("n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("shard", "_lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    names = free_names([id_col], "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    columns = [F.col("size"), F.col("text_crc32"), F.lit("key"), F.col("shard"), F.col("_start") + F.col("_local"), F.col("grown_shard")]
    return placed.join(starts, ["shard", "_lane"]).select(F.col("_id").alias(id_col), *(c.alias(n) for c, n in zip(columns, names, strict=True)))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id") -> None:
    """All columns of docs as Parquet, one folder ``_shard=N`` for each shard.

    Rows of a shard are spread over several tasks, so that no shard has to fit in one.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(jump(key, shards))], names=[*batch.schema.names[:-1], "_shard"])

    keyed = docs.withColumn("_shard", F.xxhash64(F.col(id_col)))
    keyed.mapInArrow(place, with_fields(docs.schema, _shard=T.IntegerType())).write.partitionBy("_shard").parquet(path)
