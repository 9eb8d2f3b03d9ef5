"""Session factory and scratch storage shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("stratalog")
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session without the setting (tests) gets a folder of its own; on a
    cluster the setting has to be there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Growing:
    """A DataFrame that grows part by part and is read as their union.

    Parts are merged like the digits of a counter, so a row is written again
    only as often as the number of parts has digits; the base never is.
    """

    def __init__(self, base: DataFrame):
        self.base, self.parts = base, []

    def add(self, part: DataFrame) -> None:
        """part should have its lineage cut already."""
        level = 0
        while self.parts and self.parts[-1][0] == level:
            part, level = cut(self.parts.pop()[1].unionByName(part)), level + 1
        self.parts.append((level, part))

    @property
    def df(self) -> DataFrame:
        out = self.base
        for _, part in self.parts:
            out = out.unionByName(part)
        return out


def running_sums(df: DataFrame, group: list[str], order: list[Column], **values: Column) -> DataFrame:
    """df with the running sum of each value within its group, in the order, the row's own included.

    Ranges of the order are summed in a task each, so a large group is spread
    over many; those that begin within a group carry on with the sums of the
    ranges before, of which there is one row for each range.
    """
    group_, own = [F.col(g) for g in group], list(values)
    ranged = store(df.withColumns(values).repartitionByRange(*group_, *order).withColumn("_run", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_run", *group_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(*group_, "_run").agg(*(F.sum(v).alias(v) for v in own))
    before = Window.partitionBy(*group_).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_run").alias("_r"), *(F.sum(v).over(before).alias(f"_c{i}") for i, v in enumerate(own)))
    same = F.col("_run") == F.col("_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = ranged.join(F.broadcast(carried.where("_c0 is not null")), same, "left")  # a range has at most one group that began before it
    here = {v: F.sum(v).over(within) + F.coalesce(f"_c{i}", F.lit(0)) for i, v in enumerate(own)}
    return joined.withColumns(here).select(*df.columns, *own)


def parts_for(rows: int, spark: SparkSession, each: int = 500_000) -> int:
    """As many partitions as give each about ``each`` rows, the session's own number at least: what one task holds does not grow with the rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/stratalog-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; a session that has ended already leaves it to the cluster's cleaner."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the context may be gone at interpreter exit
        return


def store(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: columnar, compressed, survives lost executors."""
    return store_at(df, name)[0]


def store_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``store``, and the path, for what can be removed before the driver ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def free_names(names: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none there is, whatever their case."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """A copy of the schema with more nullable fields."""
    return T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in fields.items())])
