"""Fact files: one tab-separated ``Relation.facts`` for each relation, without header or quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import DatalogError, Decl, Program

KINDS = {"symbol": "string", "number": "bigint"}
SAFE = 2**53 - 1


def facts_frame(df: DataFrame, decl: Decl) -> DataFrame:
    """df's columns, in order, as c0, c1, ... of the declared types; rows with a null are no tuples."""
    if not decl.columns:
        return df.select(F.lit(True).alias("c"))
    if len(df.columns) != len(decl.columns):
        raise DatalogError("load.arityMismatch", f"{decl.name} has {len(decl.columns)} columns, not {len(df.columns)}")
    for (name, kind), f in zip(decl.columns, df.schema.fields, strict=True):
        numeric = isinstance(f.dataType, T.IntegralType)
        if kind == "number" and not numeric:
            raise DatalogError("load.badNumber", f"{decl.name}.{name} is no whole number")
        if kind == "symbol" and not isinstance(f.dataType, T.StringType):
            raise DatalogError("load.badSymbol", f"{decl.name}.{name} is no string")
    out = df.toDF(*(f"c{i}" for i in range(len(decl.columns)))).select(*(F.col(f"c{i}").cast(KINDS[k]).alias(f"c{i}") for i, (_, k) in enumerate(decl.columns)))
    return out.dropna()


def read_relation(spark: SparkSession, path: str, decl: Decl) -> DataFrame:
    """A fact file, checked line by line as it is read; the first bad line found ends the job with its code."""
    n = len(decl.columns)
    lines = spark.read.option("lineSep", "\n").text(path).where("value != '' and value != '\r'")
    if not n:
        return lines.select(F.lit(True).alias("c")).distinct()
    parts = F.split("value", "\t", -1)
    fail = lambda code, why: F.raise_error(F.concat(F.lit(f"[{code}] {decl.name}: {why}: "), F.col("value")))
    columns = [F.get(parts, F.lit(i)) for i in range(n)]
    ok = F.when(F.col("value").rlike("[\\x00-\\x08\\x0A-\\x1F]"), fail("load.controlChar", "control character"))
    ok = ok.when(F.size(parts) != n, fail("load.arityMismatch", f"not {n} columns"))
    for c, (_, kind) in zip(columns, decl.columns, strict=True):
        if kind == "number":
            ok = ok.when(~c.rlike(r"^-?[0-9]+\z"), fail("load.badNumber", "no whole number"))
            big = F.abs(c.try_cast("decimal(38,0)")) > SAFE
            ok = ok.when(F.coalesce(big, F.lit(True)), fail("load.numberOverflow", "number out of range"))
    out = [F.when(ok.otherwise(F.lit("")).isNotNull(), c).cast(KINDS[kind]).alias(f"c{i}") for i, (c, (_, kind)) in enumerate(zip(columns, decl.columns, strict=True))]
    return lines.select(*out).distinct()


def read_facts(spark: SparkSession, folder: str, program: Program) -> dict[str, DataFrame]:
    """The inputs' fact files in a folder; a relation without a file is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = {}
    for rel in sorted(program.inputs):
        at = path(f"{folder}/{rel}.facts")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            out[rel] = read_relation(spark, f"{folder}/{rel}.facts", program.decls[rel])
    return out


def write_facts(df: DataFrame, path: str) -> None:
    """Tab-separated lines; tabs and line ends within values become spaces, numbers lose their fraction."""
    columns = [
        F.regexp_replace(F.col(f.name).cast("string"), "[\t\n\r]", " ") if isinstance(f.dataType, T.StringType) else F.col(f.name).cast("bigint").cast("string")
        for f in df.schema.fields
    ]
    df.select(F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in columns)).alias("value")).write.mode("overwrite").text(path)


def schema_text(relations: dict[str, T.StructType]) -> str:
    """``.decl`` and ``.input`` lines for exported relations."""
    kind = lambda f: "number" if isinstance(f.dataType, T.NumericType) else "symbol"
    return "".join(f".decl {name}({', '.join(f'{f.name}: {kind(f)}' for f in schema.fields)})\n.input {name}\n" for name, schema in relations.items())


def merge_facts(sources: list[DataFrame]) -> DataFrame:
    """Distinct rows of all sources."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df)
    return out.distinct()


def overlay(static: dict[str, DataFrame], runtime: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Relation by relation, the runtime's where there is one."""
    return {**static, **runtime}
