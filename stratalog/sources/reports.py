"""Sinks: relations with their schema, runtime facts, violations as SARIF, versioned snapshots, and structure as Markdown."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import schema_text, write_facts


def export_relations(relations: Mapping[str, DataFrame], folder: str) -> str:
    """A folder of fact files for each relation and ``schema.dl`` for all; returns the schema's text."""
    spark = next(iter(relations.values())).sparkSession
    for name, df in sorted(relations.items()):
        write_facts(df, f"{folder.rstrip('/')}/{name}.facts")
    text = schema_text({name: df.schema for name, df in sorted(relations.items())})
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/schema.dl")
    return text


def sarif_results(violations: DataFrame, level: str = "error") -> DataFrame:
    """(value): one SARIF result object for each violation (rule, file, line, msg), ready to be written as lines at any size."""
    region = F.when(F.col("line") > 0, F.struct(F.col("line").cast("bigint").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    out = F.struct(F.col("rule").alias("ruleId"), F.lit(level).alias("level"), F.struct(F.col("msg").alias("text")).alias("message"), F.array(place).alias("locations"))
    return violations.select(F.to_json(out).alias("value"))


def sarif(violations: DataFrame, tool: str = "stratalog", level: str = "error") -> str:
    """A whole SARIF 2.1.0 document, for result sets that a reader looks through."""
    results = [json.loads(r["value"]) for r in sarif_results(violations.orderBy("rule", "file", "line", "msg"), level).collect()]
    rules = [{"id": r} for r in sorted({x["ruleId"] for x in results})]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, ensure_ascii=False, indent=2)


def write_snapshot(tables: Mapping[str, DataFrame], folder: str, version: int, keep: int = 2) -> str:
    """Each table as Parquet below ``v<version>``, marked complete last; the newest ``keep`` complete versions stay."""
    spark = next(iter(tables.values())).sparkSession
    at = f"{folder.rstrip('/')}/v{version}"
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{at}/_complete")
    for old in complete_versions(spark, folder)[:-keep]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/v{old}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return at


def complete_versions(spark, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{n}/_complete/_SUCCESS")))


def diff_markdown(changes: DataFrame, keys: list[str], title: str, most: int = 50) -> str:
    """A list of changes (keys, change), the first ``most`` of each kind; the counts are whole."""
    lines = [f"## {title}", ""]
    for row in changes.groupBy("change").count().orderBy("change").collect():
        lines += [f"### {row['change']} ({row['count']})", ""]
        first = changes.where(F.col("change") == row["change"]).orderBy(*keys).limit(most).collect()
        lines += [f"- `{' '.join(str(r[k]) for k in keys)}`" for r in first]
        lines += [f"- and {row['count'] - most} more"] * (row["count"] > most) + [""]
    return "\n".join(lines)


def matrix_markdown(order: DataFrame, edges: DataFrame, most: int = 60) -> str:
    """A dependency structure matrix of up to ``most`` nodes: rows and columns in order (node, position), a mark where row depends on column."""
    names = [r["node"] for r in order.orderBy("position").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"a matrix of more than {most} nodes cannot be read; aggregate to containers first")
    known = edges.sparkSession.createDataFrame([(n,) for n in names], edges.select(F.col("src").alias("node")).schema)
    pairs = edges.join(F.broadcast(known.toDF("src")), "src", "left_semi").join(F.broadcast(known.toDF("dst")), "dst", "left_semi").select("src", "dst").distinct()
    marks = {(r["src"], r["dst"]) for r in pairs.collect()}
    head = "| | " + " | ".join(str(i + 1) for i in range(len(names))) + " |"
    body = [f"| {i + 1} {a} | " + " | ".join("■" if i == j else "x" if (a, b) in marks else "" for j, b in enumerate(names)) + " |" for i, a in enumerate(names)]
    return "\n".join([head, "|" + "---|" * (len(names) + 1), *body])


def write_text(spark, path: str, text: str) -> None:
    """One small file under exactly this name, wherever Spark can write; replaced as a whole."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}._writing")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"could not write {path}")
