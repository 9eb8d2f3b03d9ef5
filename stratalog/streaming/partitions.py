"""Results kept by partition: after a change of the input, only the partitions whose rows have changed are computed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store


def partition_marks(df: DataFrame, key: str) -> DataFrame:
    """(key, mark): an order-free digest of each partition's rows, repeated ones counted."""
    row = F.xxhash64(*df.columns)
    other = F.xxhash64(F.lit(1), *df.columns)
    wide = lambda c: F.sum(c.cast("decimal(38,0)")).cast("string")
    return df.groupBy(key).agg(F.concat_ws(":", F.count("*").cast("string"), wide(row), wide(other)).alias("mark"))


class PartitionMemo:
    """Results of a function of one partition's rows, for all partitions of an input.

    The function gets rows of any number of whole partitions and gives rows that
    carry the key; it must treat each partition by itself. Marks and results
    are tables, so neither the input nor the results pass the driver, and what
    is computed is in proportion to what has changed.
    """

    def __init__(self, key: str, compute: Callable[[DataFrame], DataFrame]):
        self.key, self.compute = key, compute
        self.marks: DataFrame | None = None
        self.results: DataFrame | None = None
        self.recomputed = self.removed = 0

    def refresh(self, df: DataFrame) -> DataFrame:
        """The results for df; ``recomputed`` and ``removed`` tell how many partitions the last call made anew and dropped."""
        marks = store(partition_marks(df, self.key), "marks")
        if self.marks is None or self.results is None:
            self.results = store(self.compute(df), "results")
            self.recomputed, self.removed, self.marks = marks.count(), 0, marks
            return self.results
        old = self.marks.select(F.col(self.key).alias("_k"), F.col("mark").alias("_m"))
        both = store(marks.join(old, F.col(self.key).eqNullSafe(F.col("_k")), "full_outer"), "compared")
        changed = both.where("mark is not null and not mark <=> _m").select(F.col(self.key).alias("_c"))
        gone = both.where("mark is null").select(F.col("_k").alias("_c"))
        self.recomputed, self.removed, self.marks = changed.count(), gone.count(), marks
        if self.recomputed + self.removed:
            same = F.col(self.key).eqNullSafe(F.col("_c"))
            kept = self.results.join(changed.unionByName(gone), same, "left_anti")
            self.results = store(kept.unionByName(self.compute(df.join(changed, same, "left_semi"))), "results")
        return self.results
