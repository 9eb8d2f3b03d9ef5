"""Scans of JSON records: snapshots and their history, fact logs, telemetry, session transcripts and CPU profiles.

Schemas are given, never inferred, so a scan reads its files once and only the
fields that a query asks for; malformed lines are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<id string, label string, type string, status string, parent string, tags array<string>, exportCount long, loc long>"
EDGE = "struct<id string, `from` string, `to` string, type string, label string, resolved boolean, line long>"
SNAPSHOT = f"version string, generatedAt string, nodes array<{NODE}>, edges array<{EDGE}>"
TELEMETRY = "ts string, session string, tool string, tokens long, deduplicated boolean, durationMs long"
TRANSCRIPT = "sessionId string, timestamp string, message struct<role string, content array<struct<type string, name string, id string, input map<string,string>>>>"
FRAME = "struct<functionName string, url string, lineNumber long>"
PROFILE = f"nodes array<struct<id long, hitCount long, callFrame {FRAME}, children array<long>>>, samples array<long>, timeDeltas array<long>, startTime long, endTime long"
FACT = "id string, r string, v string"


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a stored snapshot, bare or within a wrapper's ``data`` field."""
    raw = spark.read.schema(f"{SNAPSHOT}, data struct<{SNAPSHOT}>").option("multiLine", True).json(path)
    pick = lambda name: F.coalesce(F.col(name), F.col(f"data.{name}"))
    nodes = raw.select(F.explode(pick("nodes")).alias("n")).select("n.*")
    edges = raw.select(F.explode(pick("edges")).alias("e")).select("e.*")
    return nodes, edges


def read_history(spark: SparkSession, folder: str, schema: str, last: int | None = None) -> DataFrame:
    """Files ``snapshot-<time>.json`` of a folder as rows with snapshot, the time in the name; names sort by time. ``last`` keeps that many of the newest."""
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "snapshot-*.json").json(folder)
    out = files.withColumn("snapshot", F.regexp_extract("_metadata.file_name", r"^snapshot-(.*)\.json$", 1))
    if last is None:
        return out
    newest = out.select("snapshot").distinct().orderBy(F.desc("snapshot")).limit(last)
    return out.join(F.broadcast(newest), "snapshot", "left_semi")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that fit the schema; others are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_telemetry(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Tool calls, the ``last`` by time if asked for."""
    calls = read_lines(spark, path, TELEMETRY)
    return calls if last is None else calls.orderBy(F.desc("ts")).limit(last)


def read_fact_log(spark: SparkSession, path: str) -> DataFrame:
    """(id, r, v): a content-addressed log; v is the record's JSON text."""
    return read_lines(spark, path, FACT).where("id is not null and r is not null")


def read_tool_uses(spark: SparkSession, path: str) -> DataFrame:
    """(session, at, tool, use, input) of the tool calls in session transcripts."""
    lines = read_lines(spark, path, TRANSCRIPT)
    used = lines.select(F.col("sessionId").alias("session"), F.col("timestamp").alias("at"), F.explode("message.content").alias("c"))
    return used.where("c.type = 'tool_use'").select("session", "at", F.col("c.name").alias("tool"), F.col("c.id").alias("use"), F.col("c.input").alias("input"))


def read_profile(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(file, fn, line, samples, self_us) of a CPU profile's own code: frames without a file, of the runtime or of vendored code are left out."""
    raw = spark.read.schema(PROFILE).option("multiLine", True).json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.id", "n.hitCount", "n.callFrame.*")
    ticks = raw.select(F.explode(F.arrays_zip("samples", "timeDeltas")).alias("t")).groupBy(F.col("t.samples").alias("id")).agg(F.count("*").alias("n"), F.sum("t.timeDeltas").alias("us"))
    file = _own_file(F.col("url"), root)
    found = nodes.join(ticks, "id", "left").select(file.alias("file"), F.col("functionName").alias("fn"), F.col("lineNumber").alias("line"), F.coalesce("n", "hitCount").alias("n"), F.coalesce("us", F.lit(0)).alias("us"))
    kept = found.where("file is not null and fn != ''").groupBy("file", "fn", "line").agg(F.sum("n").alias("samples"), F.sum("us").alias("self_us"))
    return kept.where("samples > 0")


def _own_file(url: Column, root: str) -> Column:
    path = F.regexp_replace(url, "^file://", "")
    if root:
        path = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)
    return F.when((path == "") | F.startswith(path, F.lit("/")) | path.contains("node_modules") | path.contains("node:"), None).otherwise(path)
