"""Relations as change logs, and rules kept up to date over a stream of changes.

A change is a row (rel, op, row): the relation, ``+`` or ``-``, and the values
as text. Every micro-batch is appended as one folder for each relation it
touches, named by the batch, so that replaying a batch after a failure writes
the same folder again and nothing counts twice. What holds is, for each row,
its latest change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..lang import DatalogError, Program
from ..lang.stratify import dependencies, restricted
from ..plans import evaluate
from ..plans.compiler import KINDS

CHANGE_SCHEMA = "rel string, op string, row array<string>"


class ChangeLog:
    """The input relations of a program below a folder that all executors share."""

    def __init__(self, spark: SparkSession, program: Program, folder: str):
        self.spark, self.program, self.folder = spark, program, folder.rstrip("/")

    def _parts(self, rel: str) -> list[tuple[str, int]]:
        """(base or delta, batch) of the folders that count: the newest base and what came after it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{rel}")
        fs = at.getFileSystem(conf)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{rel}/{n}/_SUCCESS"))]
        parts = sorted((n.rpartition("-")[0], int(n.rpartition("-")[2])) for n in done)
        base = max((b for kind, b in parts if kind == "base"), default=-1)
        return [(kind, b) for kind, b in parts if (kind == "base" and b == base) or (kind == "delta" and b > base)]

    def append(self, changes: DataFrame, batch: int) -> list[str]:
        """Write a batch of (rel, op, row); the relations it touches. Rows of unknown relations or of the wrong width end it."""
        known = {rel: len(self.program.decls[rel].columns) for rel in self.program.inputs}
        good = F.lit(False)
        for rel, width in known.items():
            good |= (F.col("rel") == rel) & (F.size("row") == width) & F.col("op").isin("+", "-")
        checked = changes.withColumn("row", F.when(good, F.col("row")).otherwise(F.raise_error(F.concat(F.lit("[load.badChange] "), F.to_json(F.struct("rel", "op", "row"))))))
        checked = checked.select("rel", "op", "row", F.monotonically_increasing_id().alias("seq")).persist()
        try:
            touched = sorted(r["rel"] for r in checked.select("rel").distinct().collect())
            for rel in touched:
                if rel not in known:
                    raise DatalogError("load.unknownRel", f"{rel} is no input")
                checked.where(F.col("rel") == rel).select("op", "row", "seq").write.mode("overwrite").parquet(f"{self.folder}/{rel}/delta-{batch}")
            return touched
        finally:
            checked.unpersist()

    def current(self, rel: str) -> DataFrame:
        """The rows that hold, under the declared names and types."""
        decl = self.program.decls[rel]
        parts = [self.spark.read.parquet(f"{self.folder}/{rel}/{kind}-{batch}").withColumn("batch", F.lit(batch)) for kind, batch in self._parts(rel)]
        columns = [F.get("row", F.lit(i)).cast(KINDS[kind]).alias(name) for i, (name, kind) in enumerate(decl.columns)]
        if not parts:
            return self.spark.createDataFrame([], "row array<string>").select(*columns)
        log = parts[0]
        for p in parts[1:]:
            log = log.unionByName(p)
        return log.groupBy("row").agg(F.max_by("op", F.struct("batch", "seq")).alias("op")).where("op = '+'").select(*columns)

    def compact(self, rel: str) -> None:
        """Write what holds as a new base, so that later reads pass over the changes before it."""
        parts = self._parts(rel)
        if not parts or parts == [("base", parts[0][1])]:
            return
        row = F.array(*(F.col(name).cast("string") for name, _ in self.program.decls[rel].columns))
        out = self.current(rel).select(F.lit("+").alias("op"), row.alias("row"), F.lit(0).cast("long").alias("seq"))
        out.write.mode("overwrite").parquet(f"{self.folder}/{rel}/base-{max(b for _, b in parts)}")


def affected_outputs(program: Program, touched: list[str]) -> list[str]:
    """Outputs that depend on one of the relations, over any number of rules."""
    reads = dependencies(program)
    dirty, grown = set(touched), True
    while grown:
        new = {rel for rel, needs in reads.items() if rel not in dirty and dirty & set(needs)}
        dirty |= new
        grown = bool(new)
    return [rel for rel in program.outputs if rel in dirty]


def watch(
    spark: SparkSession,
    program: Program,
    changes: DataFrame,
    folder: str,
    on_result: Callable[[int, dict[str, DataFrame]], None],
    trigger: dict | None = None,
    compact_every: int = 50,
    allow_recursion: bool = True,
) -> StreamingQuery:
    """Keep the rules evaluated over a stream of changes.

    ``changes`` is a streaming DataFrame (rel, op, row). After each batch,
    ``on_result`` gets the batch and the outputs that depend on what it
    touched; other outputs stand, and neither they nor relations that only
    they read are computed or scanned. Batches that arrive while one
    runs wait and come together, which is the engine's own debouncing.
    """
    log = ChangeLog(spark, program, f"{folder.rstrip('/')}/relations")

    def step(batch: DataFrame, number: int) -> None:
        touched = log.append(batch, number)
        if not touched:
            return
        if compact_every and number % compact_every == compact_every - 1:
            for rel in touched:
                log.compact(rel)
        wanted = affected_outputs(program, touched)
        if wanted:
            own = restricted(program, wanted)
            result = evaluate(spark, own, {rel: log.current(rel) for rel in own.inputs}, allow_recursion)
            on_result(number, {rel: result.named(rel) for rel in wanted})

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder.rstrip('/')}/progress").trigger(**(trigger or {"availableNow": True})).start()
