"""Trace spans to runtime relations. Spans: span_id, parent_id, attributes map<string,string>, start_ms, end_ms, duration_ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distribution import nearest_rank

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def attribute(*names: str) -> Column:
    return F.coalesce(*(F.try_element_at("attributes", F.lit(n)) for n in names))


def symbol(root: str = "") -> tuple[Column, Column]:
    """(file, function) of a span, the project root stripped; null for vendored or other absolute files."""
    path = attribute("code.filepath", "code.file.path")
    if root:
        path = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)
    file = F.when(path.contains("node_modules") | F.startswith(path, F.lit("/")), None).otherwise(path)
    return file, attribute("code.function", "code.function.name")


def sql_verb(statement: Column) -> Column:
    return F.upper(F.regexp_extract(statement, r"(?i)^\s*(select|insert|update|delete)\b", 1))


def sql_table(statement: Column) -> Column:
    return F.lower(F.regexp_extract(statement, r"""(?i)\b(?:from|into|update|join)\s+["`]?(?:\w+["`]?\.["`]?)?(\w+)""", 1))


def symbols_touched(spans: DataFrame, root: str = "") -> DataFrame:
    file, fn = symbol(root)
    s = spans.select(file.alias("file"), fn.alias("fn"), "duration_ms").where("file is not null and fn is not null")
    return s.groupBy("file", "fn").agg(F.count("*").alias("count"), nearest_rank("duration_ms", 0.95).alias("p95"))


def route_hits(spans: DataFrame) -> DataFrame:
    """Grouped by the raw path and reported without the query string, so a reported path can come twice."""
    s = spans.select(attribute("http.request.method", "http.method").alias("method"), attribute("http.route", "url.path", "http.target").alias("raw"), attribute("http.response.status_code", "http.status_code").cast("bigint").alias("status"), "duration_ms")
    g = s.where("method is not null and raw is not null").groupBy("method", "raw", "status").agg(F.count("*").alias("count"), nearest_rank("duration_ms", 0.95).alias("p95"))
    return g.select("method", F.substring_index("raw", "?", 1).alias("path"), F.coalesce("status", F.lit(0)).alias("status"), "count", "p95")


def queries_run(spans: DataFrame) -> DataFrame:
    statement = attribute("db.statement", "db.query.text")
    verb = F.coalesce(attribute("db.operation", "db.operation.name"), sql_verb(statement))
    target = F.coalesce(attribute("db.sql.table", "db.collection.name", "db.mongodb.collection"), sql_table(statement))
    s = spans.where(attribute("db.system", "db.system.name").isNotNull() & (attribute("db.system", "db.system.name") != "redis")).select(target.alias("table"), F.upper(verb).alias("op"), "end_ms")
    return s.where("table != '' and op != ''").groupBy("table", "op").agg(F.count("*").alias("count"), F.floor(F.max("end_ms") / 1000).cast("bigint").alias("last_second"))


def key_pattern(key: Column) -> Column:
    """Numbers and UUIDs between colons become ``*``."""
    return F.regexp_replace(F.regexp_replace(key, f"(?<=^|:)(?:{UUID})(?=:|$)", "*"), r"(?<=^|:)\d+(?=:|$)", "*")


def redis_operations(spans: DataFrame) -> DataFrame:
    statement = attribute("db.statement", "db.query.text")
    s = spans.where(attribute("db.system", "db.system.name") == "redis").select(
        F.upper(F.coalesce(attribute("db.operation", "db.operation.name"), F.regexp_extract(statement, r"^\s*(\S+)", 1))).alias("op"), key_pattern(F.regexp_extract(statement, r"^\s*\S+\s+(\S+)", 1)).alias("pattern")
    )
    return s.where("op != '' and pattern != ''").groupBy("op", "pattern").agg(F.count("*").alias("count"))


def events_emitted(spans: DataFrame) -> DataFrame:
    s = spans.select(attribute("event.type", "event.name").alias("type"), "end_ms").where("type is not null")
    return s.groupBy("type").agg(F.count("*").alias("count"), F.floor(F.max("end_ms") / 1000).cast("bigint").alias("last_second"))


def call_edges(spans: DataFrame, root: str = "") -> DataFrame:
    """(from_file, from_fn, to_file, to_fn, count): parent to child span, where both are symbols."""
    file, fn = symbol(root)
    s = spans.select("span_id", "parent_id", file.alias("file"), fn.alias("fn")).where("file is not null and fn is not null")
    up = s.select(F.col("span_id").alias("parent_id"), F.col("file").alias("from_file"), F.col("fn").alias("from_fn"))
    return s.join(up, "parent_id").groupBy("from_file", "from_fn", F.col("file").alias("to_file"), F.col("fn").alias("to_fn")).agg(F.count("*").alias("count"))


def series_keys(spans: DataFrame, root: str = "") -> DataFrame:
    """(kind, key, start_ms, duration_ms): a span feeds up to four series."""
    file, fn = symbol(root)
    statement = attribute("db.statement", "db.query.text")
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.array(
        pair("symbol", F.concat(file, F.lit(":"), fn)),
        pair("route", F.concat_ws(" ", attribute("http.request.method", "http.method"), F.substring_index(attribute("http.route", "url.path", "http.target"), "?", 1))),
        pair("table", F.when(attribute("db.system", "db.system.name") != "redis", F.coalesce(attribute("db.sql.table"), sql_table(statement)))),
        pair("event", attribute("event.type", "event.name")),
    )
    s = spans.select(F.explode(F.filter(keys, lambda k: k["key"].isNotNull() & (k["key"] != ""))).alias("k"), "start_ms", "duration_ms")
    return s.select("k.kind", "k.key", "start_ms", "duration_ms")
