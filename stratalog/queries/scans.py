"""Sources, sinks, services and streams: each writes what it needs below the shared folder, reads it back and is held against the tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..lang import DatalogError, Decl, parse, stratify
from ..plans import run_dirs, run_string
from ..plans.service import ResultCache, ask
from ..session import scratch_path
from ..sources import facts as S
from ..sources import records as R
from ..sources import reports as W
from ..streaming.changes import CHANGE_SCHEMA, ChangeLog, affected_outputs, watch
from ..streaming.incremental import Database, IncrementalError
from ..streaming.partitions import PartitionMemo
from ..streaming.spans import stream_series
from .common import RING_SQL, ring, table

Query = Callable[[SparkSession, str], DataFrame]
JUNK = ["", "{", "no json at all", '{"ts": 5'] * 3


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("o"), F.col("o_orderstatus").alias("status"))


def _lines(df: DataFrame, path: str, junk: bool = True) -> str:
    """df's rows as JSON lines, with malformed ones among them."""
    out = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    if junk:
        out = out.unionByName(df.sparkSession.createDataFrame([(j,) for j in JUNK], "value string"))
    out.write.text(path)
    return path


def q_facts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "facts")
    S.write_facts(_orders(spark, sf_dir), path)
    return S.read_relation(spark, path, Decl("Orders", (("o", "number"), ("status", "symbol")))).toDF("o", "status")


def q_facts_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema's text, line by line."""
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    text = W.export_relations({"Nation": nation.select("n_nationkey", "n_name"), "Region": region.select("r_name")}, scratch_path(spark, "export"))
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.strip().split("\n"))], "n int, line string")


def q_rules_from_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in two files, facts in two folders."""
    at = scratch_path(spark, "program")
    W.write_text(spark, f"{at}/rules/a.dl", ".decl Orders(o: number, status: symbol)\n.input Orders\n")
    W.write_text(spark, f"{at}/rules/b.dl", '.decl Out(o: number)\n.output Out\nOut(O) :- Orders(O, "P").\n')
    o = _orders(spark, sf_dir)
    S.write_facts(o.where("o % 2 = 0"), f"{at}/even/Orders.facts")
    S.write_facts(o.where("o % 2 = 1"), f"{at}/odd/Orders.facts")
    return run_dirs(spark, [f"{at}/rules"], [f"{at}/even", f"{at}/odd"]).named("Out")


def q_facts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return S.merge_facts([o.where("o % 3 != 0"), o.where("o % 2 = 0")])


def q_facts_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's relation stands before the static one of its name."""
    o = _orders(spark, sf_dir)
    laid = S.overlay({"Hot": o.where("status = 'O'"), "Cold": o.where("status = 'P'")}, {"Hot": o.where("status = 'F'")})
    out = None
    for name, df in laid.items():
        part = df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def q_snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as a stored snapshot within a wrapper."""
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.struct(F.col("n_name").alias("id"), F.lit("file").alias("type")).alias("x")).agg(F.collect_list("x").alias("nodes"))
    edges = n.select(F.struct(F.col("n_name").alias("from"), F.col("n_regionkey").cast("string").alias("to"), F.lit("import").alias("type"), (F.col("n_nationkey") % 2 == 0).alias("resolved")).alias("x")).agg(F.collect_list("x").alias("edges"))
    path = scratch_path(spark, "snapshot")
    nodes.crossJoin(edges).select(F.to_json(F.struct(F.lit("3").alias("v"), F.struct(F.lit("3").alias("version"), "nodes", "edges").alias("data"))).alias("value")).coalesce(1).write.text(path)
    nodes, edges = R.read_snapshot(spark, path)
    return edges.join(nodes.select(F.col("id").alias("from")), "from").select("from", "to", "resolved")


def q_history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each year's orders, of which the last two are read."""
    o, at = table(spark, sf_dir, "orders"), scratch_path(spark, "history")
    for r in o.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).collect():
        W.write_text(spark, f"{at}/snapshot-{r['y']}.json", json.dumps({"version": str(r["y"]), "total": r["n"]}))
    W.write_text(spark, f"{at}/notes.json", '{"total": 1}')
    return R.read_history(spark, at, "version string, total long", last=2).select("snapshot", "total")


def q_telemetry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls, the last hundred by time."""
    e = table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ts"), F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("tool"), F.floor("value").cast("long").alias("tokens"))
    return R.read_telemetry(spark, _lines(e, scratch_path(spark, "telemetry")), last=100).select("ts", "session", "tool", "tokens")


def q_fact_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select(F.sha2(F.col("o").cast("string"), 256).alias("id"), F.lit("Order").alias("r"), F.col("status").alias("v"))
    return R.read_fact_log(spark, _lines(o, scratch_path(spark, "log")))


def q_transcript_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as session lines; a turn's role is a tool that it uses."""
    c = table(spark, sf_dir, "conversations")
    use = F.struct(F.lit("tool_use").alias("type"), F.col("role").alias("name"), F.col("turn").cast("string").alias("id"), F.create_map(F.lit("length"), F.length("text").cast("string")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("map<string,string>").alias("input"))
    rows = c.where("text is not null").select(F.col("conv_id").cast("string").alias("sessionId"), F.lit("t").alias("timestamp"), F.struct(F.lit("assistant").alias("role"), F.array(said, use).alias("content")).alias("message"))
    found = R.read_tool_uses(spark, _lines(rows, scratch_path(spark, "session")))
    return found.select("session", "tool", "use", F.element_at("input", "length").alias("length"))


def q_profile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile in which each part of brand 11 is a function of its own file, and a vendored one."""
    p = table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").orderBy("p_partkey").collect()
    frame = lambda i, url, fn: {"id": i, "hitCount": 0, "callFrame": {"functionName": fn, "url": url, "lineNumber": 3}}
    nodes = [frame(r["p_partkey"], f"file:///app/src/{r['p_partkey']}.js", "run") for r in p] + [frame(0, "file:///app/node_modules/x.js", "y"), frame(-1, "", "(idle)")]
    ticks = [(r["p_partkey"], k) for r in p for k in range(r["p_size"])] + [(0, 1), (-1, 1)]
    path = f"{scratch_path(spark, 'profile')}/profile.json"
    W.write_text(spark, path, json.dumps({"nodes": nodes, "samples": [i for i, _ in ticks], "timeDeltas": [10 for _ in ticks], "startTime": 0, "endTime": 1}))
    return R.read_profile(spark, path, "/app")


def q_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.lit("CYCLES").alias("rule"), F.col("n_name").alias("file"), F.col("n_nationkey").alias("line"), F.lit("part of a cycle").alias("msg"))
    return W.sarif_results(n)


def q_snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four versions written, two kept; the newest read back."""
    at, o = scratch_path(spark, "versions"), _orders(spark, sf_dir)
    for v in (1, 2, 3, 4):
        W.write_snapshot({"orders": o.where(F.col("o") % 4 < v)}, at, v)
    kept = W.complete_versions(spark, at)
    out = None
    for v in kept:
        part = spark.read.parquet(f"{at}/v{v}/orders").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def q_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_regionkey") < 2, "added").otherwise("removed").alias("change"))
    text = W.diff_markdown(changes, ["n_name"], "Nations", most=5)
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "n int, line string")


NATION = ".decl Nation(k: number, name: symbol, r: number)\n.input Nation\n"


def _nation(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"Nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint"), "n_name", F.col("n_regionkey").cast("bigint"))}


def q_canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = run_string(spark, NATION + '.decl Out(k: number, name: symbol)\n.output Out\nOut(K, N) :- Nation(K, N, 1).\nOut(99, "a\\"b\\\\c").', _nation(spark, sf_dir))
    return spark.createDataFrame([(i, line) for i, line in enumerate(result.text().rstrip("\n").split("\n"))], "n int, line string")


def q_json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = run_string(spark, NATION + ".decl Out(r: number, name: symbol)\n.output Out\nOut(R, N) :- Nation(K, N, R), K > 20.", _nation(spark, sf_dir))
    return spark.createDataFrame([tuple(r) for r in json.loads(result.json())["outputs"]["Out"]], "r long, name string")


def q_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ".decl Edge(a: number, b: number)\n.input Edge\n.decl Out(a: number, b: number)\n.output Out\nOut(A, B) :- Edge(A, B).\nOut(A, C) :- Out(A, B), Edge(B, C)."
    stats = run_string(spark, text, {"Edge": ring(spark, sf_dir)}, allow_recursion=True).stats
    return spark.createDataFrame([(k, int(stats[k])) for k in ("rules", "strata", "rounds")], "stat string, value long")


#: (case, program, code that it ends with)
BAD = [
    ("no equality", ".decl A(n: number)\nA(X) :- A(X), X = 5.", "parse.unexpectedChar"),
    ("left side a constant", ".decl A(n: number)\nA(X) :- A(X), 5 > X.", "parse.expected"),
    ("unsafe head", ".decl A(n: number)\nA(Y) :- A(X).", "parse.unsafeHeadVar"),
    ("unsafe negation", ".decl A(n: number)\n.decl B(n: number)\nA(X) :- A(X), !B(Y).", "parse.unsafeNegatedVar"),
    ("unsafe constraint", ".decl A(n: number)\nA(X) :- A(X), M > 5.", "parse.unsafeConstraintVar"),
    ("arity", ".decl A(n: number)\nA(X) :- A(X, X).", "parse.arityMismatch"),
    ("unknown relation", ".decl A(n: number)\nA(X) :- Z(X).", "parse.unknownRel"),
    ("declared twice", ".decl A(n: number)\n.decl A(n: number)", "parse.duplicateDecl"),
    ("aggregate of a symbol", ".decl A(n: symbol)\n.count C(n: symbol) by A(_)", "parse.aggregateLastColMustBeNumber"),
    ("recursion", ".decl A(n: number)\n.decl B(n: number)\nB(X) :- A(X).\nB(X) :- B(X).", "stratify.recursionDisallowed"),
    ("negation through recursion", ".decl A(n: number)\n.decl B(n: number)\nA(1).\nB(X) :- A(X), !B(X).", "stratify.negationInRecursion"),
]


def q_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for case, text, _ in BAD:
        try:
            stratify(parse(text))
            rows.append((case, "none"))
        except DatalogError as e:
            rows.append((case, e.code))
    return spark.createDataFrame(rows, "case string, code string")


def q_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negation over a recursive stratum, and an aggregate over that."""
    text = (
        ".decl E(a: number, b: number)\n.input E\n.decl R(a: number, b: number)\n.decl N(a: number)\n.decl U(a: number, b: number)\n.output U\n.count C(a: number, n: number) by U(A, _)\n.output C\n"
        "R(A, B) :- E(A, B).\nR(A, C) :- R(A, B), E(B, C).\nN(A) :- E(A, _).\nN(B) :- E(_, B).\nU(A, B) :- N(A), N(B), !R(A, B)."
    )
    rows = [(rel, i, s.recursive) for i, s in enumerate(stratify(parse(text), True)) for rel in s.relations]
    order = {rel: i for rel, i, _ in rows}
    return spark.createDataFrame([(rel, order[rel] > order["R"], order[rel] > order["U"], rec) for rel, _, rec in rows], "relation string, after_r boolean, after_u boolean, recursive boolean")


def q_ask_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question whose answer is longer than asked for, and one whose is not."""
    given = {"Nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("r"))}
    answer = ask(spark, ".decl Big(k: number) .output Big Big(K) :- Nation(K, _, R), R > 0. .decl One(name: symbol) .output One One(N) :- Nation(7, N, _).", given, limit=5)
    rows = [(rel, str(r[0]), answer.truncated[rel]) for rel, found in answer.rows.items() for r in found]
    return spark.createDataFrame(rows, "relation string, value string, truncated boolean")


def q_result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the same question, once over other facts: one hit."""
    cache, facts = ResultCache(spark), _nation(spark, sf_dir)
    text = NATION + ".decl Out(k: number)\n.output Out\nOut(K) :- Nation(K, _, 2)."
    counts = [cache.run(text, facts).named("Out").count(), cache.run(text, facts).named("Out").count()]
    counts.append(cache.run(text, {"Nation": facts["Nation"].where("n_nationkey > 10")}).named("Out").count())
    return spark.createDataFrame([(i, n, cache.hits) for i, n in enumerate(counts)], "run int, rows long, hits int")


def q_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells over nation names: counts of words, their sum, and what each change makes anew."""
    db, rows = Database(), []
    db.input("text")

    @db.query("length")
    def length(d: Database, key: str) -> int:
        return len(d.get("text", key))

    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]

    @db.query("total")
    def total(d: Database, key: str) -> int:
        return sum(d.get("length", str(i)) for i in range(len(names)))

    def note(step: str) -> None:
        rows.append((step, total(""), db.stats.misses, db.stats.kept))

    for i, name in enumerate(names):
        db.set("text", str(i), name)
    note("first")
    note("again")
    db.set("text", "0", names[0])
    note("set to the same")
    db.set("text", "0", names[0][::-1])
    note("other text of the same length")
    db.set("text", "0", "")
    note("shorter")
    for step, act in (("unset", lambda: db.get("text", "none")), ("defined twice", lambda: db.input("text"))):
        try:
            act()
        except IncrementalError as e:
            rows.append((f"{step}: {e.code}", 0, 0, 0))
    return spark.createDataFrame(rows, "step string, total long, misses long, kept long")


def q_memo_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each customer's orders, after some orders changed, some customers went and others came."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    memo = PartitionMemo("o_custkey", lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "F", 1)).alias("done")))
    memo.refresh(o.where("o_custkey % 10 != 3"))
    later = o.where("o_custkey % 10 != 7").withColumn("status", F.when(F.col("o_orderkey") % 100 == 1, "F").otherwise(F.col("status")))
    result = memo.refresh(later)
    return result.withColumns({"recomputed": F.lit(memo.recomputed).cast("bigint"), "removed": F.lit(memo.removed).cast("bigint")})


def q_memo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for value in ("a", 7, -1, ("a", 1), ("a", ("b", 2))):
        rows.append((repr(value), scalars.query_key(value).replace("\0", "~").replace("\1", "|")))
    for value in (True, float("nan"), None):
        try:
            scalars.query_key(value)
        except DatalogError as e:
            rows.append((repr(value), e.code))
    return spark.createDataFrame(rows, "value string, key string")


ROUTES = ".decl Orders(o: number, status: symbol)\n.input Orders\n.decl Part(p: number)\n.input Part\n.decl Open(o: number)\n.output Open\n.decl Known(p: number)\n.output Known\nOpen(O) :- Orders(O, \"O\").\nKnown(P) :- Part(P)."


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    row = lambda status: F.array(F.col("o_orderkey").cast("string"), status)
    first = o.select(F.lit("Orders").alias("rel"), F.lit("+").alias("op"), row(F.col("o_orderstatus")).alias("row"))
    later = o.where("o_orderkey % 5 = 0")
    second = later.select(F.lit("Orders").alias("rel"), F.lit("-").alias("op"), row(F.col("o_orderstatus")).alias("row"))
    return first, second


def q_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders come, every fifth goes, the log is compacted, and a batch is played again."""
    log = ChangeLog(spark, parse(ROUTES), scratch_path(spark, "changes"))
    first, second = _changes(spark, sf_dir)
    log.append(first, 0)
    log.append(second, 1)
    log.append(second, 1)
    log.compact("Orders")
    return log.current("Orders")


def q_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes as a stream of files, however many each batch has; only what they touch is evaluated."""
    at, results = scratch_path(spark, "watch"), {}
    stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(f"{at}/in/*")

    def keep(number: int, outputs: dict[str, DataFrame]) -> None:
        for rel, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{at}/out/{rel}-{number}")
            results[rel] = f"{at}/out/{rel}-{number}"

    for i, batch in enumerate(_changes(spark, sf_dir)):
        batch.write.parquet(f"{at}/in/{i}")
        watch(spark, parse(ROUTES), stream, f"{at}/state", keep).awaitTermination()  # takes what is new
    assert set(results) == {"Open"}
    return spark.read.parquet(results["Open"])


def q_affected_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = parse(ROUTES)
    return spark.createDataFrame([(rel, out) for rel in ("Orders", "Part") for out in affected_outputs(program, [rel])], "touched string, output string")


def q_stream_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of a stream of files, in daily buckets."""
    e = table(spark, sf_dir, "events")
    user, at = F.col("user_id").cast("string"), scratch_path(spark, "spans")
    pairs = F.create_map(F.lit("code.filepath"), F.concat(F.lit("/app/"), user, F.lit(".ts")), F.lit("code.function"), F.col("event_type"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = e.select(F.col("event_id").alias("span_id"), (F.col("event_id") - 1).alias("parent_id"), pairs.alias("attributes"), ms.alias("start_ms"), ms.alias("end_ms"), F.floor(F.col("value") * 100).cast("bigint").alias("duration_ms"))
    each = spark.sparkContext.defaultParallelism  # three batches of as many files as there are cores
    rows.repartition(3 * each).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{at}/in")
    series, last = stream_series(stream, 1704067200000, 86_400_000, root="/app"), []

    def keep(whole: DataFrame, number: int) -> None:
        """Each batch brings the whole result; the driver holds the place of the last one only."""
        whole.write.mode("overwrite").parquet(f"{at}/out/{number}")
        last[:] = [f"{at}/out/{number}"]

    series.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(series.schema).parquet(*last)


def q_text_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("a  /* "), F.col("n_name"), F.lit(" */ b // "), F.col("n_name"), F.lit("\n  c"))
    return table(spark, sf_dir, "nation").select("n_name", scalars.strip_comments(text).alias("bare"), scalars.singular(F.concat(F.lower("n_name"), F.lit("s"))).alias("one"))


def _values(rows: list[tuple], *names: str) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as t({', '.join(chr(34) + n + chr(34) for n in names)})"


_SCHEMA_LINES = [".decl Nation(n_nationkey: number, n_name: symbol)", ".input Nation", ".decl Region(r_name: symbol)", ".input Region"]
_MEMO_SQL = """
with n as (select sum(length(n_name)) as t, count(*) as k, max(case when n_nationkey = 0 then length(n_name) end) as f from nation)
select 'first' as step, cast(t as bigint) as total, cast(k + 1 as bigint) as misses, cast(0 as bigint) as kept from n
union all select 'again', t, k + 1, 0 from n union all select 'set to the same', t, k + 1, 0 from n
union all select 'other text of the same length', t, k + 2, 1 from n union all select 'shorter', t - f, k + 4, 1 from n
union all select 'unset: input.unset', 0, 0, 0 union all select 'defined twice: query.duplicateId', 0, 0, 0"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "source_facts": (q_facts_scan, "select distinct cast(o_orderkey as bigint) as o, o_orderstatus as status from orders"),
    "source_program": (q_rules_from_folders, "select cast(o_orderkey as bigint) as o from orders where o_orderstatus = 'P'"),
    "source_snapshot": (q_snapshot_scan, 'select n_name as "from", cast(n_regionkey as varchar) as "to", n_nationkey % 2 = 0 as resolved from nation'),
    "source_history": (q_history_scan, "select cast(year(o_orderdate) as varchar) as snapshot, count(*) as total from orders group by 1 order by 1 desc limit 2"),
    "source_telemetry": (q_telemetry_scan, "select lpad(cast(event_id as varchar), 12, '0') as ts, cast(user_id as varchar) as session, event_type as tool, cast(floor(value) as bigint) as tokens from events order by event_id desc limit 100"),
    "source_fact_log": (q_fact_log_scan, "select sha256(cast(o_orderkey as varchar)) as id, 'Order' as r, o_orderstatus as v from orders"),
    "source_transcript": (q_transcript_scan, "select cast(conv_id as varchar) as session, role as tool, cast(turn as varchar) as use, cast(length(text) as varchar) as length from conversations where text is not null and role is not null"),
    "source_profile": (q_profile_scan, "select 'src/' || p_partkey || '.js' as file, 'run' as fn, cast(3 as bigint) as line, cast(p_size as bigint) as samples, cast(p_size * 10 as bigint) as self_us from part where p_brand = 'Brand#11'"),
    "sink_facts_schema": (q_facts_export, _values(list(enumerate(_SCHEMA_LINES)), "n", "line")),
    "sink_facts_merge": (q_facts_merge, "select cast(o_orderkey as bigint) as o, o_orderstatus as status from orders where o_orderkey % 3 != 0 or o_orderkey % 2 = 0"),
    "sink_facts_overlay": (q_facts_overlay, "select 'Hot' as relation, count(*) as n from orders where o_orderstatus = 'F' union all select 'Cold', count(*) from orders where o_orderstatus = 'P'"),
    "sink_sarif": (
        q_sarif,
        """select '{"ruleId":"CYCLES","level":"error","message":{"text":"part of a cycle"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || n_name || '"}' || case when n_nationkey > 0 then ',"region":{"startLine":' || n_nationkey || '}' else '' end || '}}]}' as value from nation""",
    ),
    "sink_snapshot_versions": (q_snapshot_versions, "select 3 as version, count(*) as n from orders where o_orderkey % 4 < 3 union all select 4, count(*) from orders"),
    "sink_markdown": (
        q_markdown,
        """with c as (select n_name, case when n_regionkey < 2 then 'added' else 'removed' end as change, row_number() over (partition by n_regionkey < 2 order by n_name) as k, count(*) over (partition by n_regionkey < 2) as total from nation),
        l as (select '' as change, 0 as k, '## Nations' as line union all select '', 1, '' union all select distinct change, 0, '### ' || change || ' (' || total || ')' from c union all select distinct change, 1, '' from c
              union all select change, 1 + k, '- `' || n_name || '`' from c where k <= 5 union all select distinct change, 90, '- and ' || (total - 5) || ' more' from c where total > 5 union all select distinct change, 99, '' from c)
        select cast(row_number() over (order by change, k) - 1 as int) as n, line from l""",
    ),
    "dl_canonical_text": (
        q_canonical_text,
        """with l as (select n_nationkey as k, 'Out(' || n_nationkey || ', "' || n_name || '").' as line from nation where n_regionkey = 1 union all select 99, 'Out(99, "a\\"b\\\\c").') select cast(row_number() over (order by k) - 1 as int) as n, line from l""",
    ),
    "dl_json_output": (q_json_output, "select cast(n_regionkey as bigint) as r, n_name as name from nation where n_nationkey > 20"),
    "dl_run_stats": (
        q_run_stats,
        "select 'rules' as stat, cast(2 as bigint) as value union all select 'strata', 2 union all select 'rounds', max(n) from (select count(*) as n from nation group by n_regionkey)",
    ),
    "dl_error_codes": (q_error_codes, _values([(case, code) for case, _, code in BAD], "case", "code")),
    "dl_strata": (q_strata, _values([("C", True, True, False), ("E", False, False, False), ("N", False, False, False), ("R", False, False, True), ("U", True, False, False)], "relation", "after_r", "after_u", "recursive")),
    "dl_ask_truncated": (
        q_ask_truncated,
        "select 'Big' as relation, cast(k as varchar) as value, true as truncated from (select n_nationkey as k from nation where n_regionkey > 0 order by 1 limit 5) union all select 'One', n_name, false from nation where n_nationkey = 7",
    ),
    "dl_result_cache": (
        q_result_cache,
        "with a as (select count(*) as n, count(*) filter (n_nationkey > 10) as m from nation where n_regionkey = 2) select 0 as run, n as rows, 1 as hits from a union all select 1, n, 1 from a union all select 2, m, 1 from a",
    ),
    "memo_cells": (q_memo, _MEMO_SQL),
    "memo_partitions": (
        q_memo_partitions,
        """with l as (select o_custkey, case when o_orderkey % 100 = 1 then 'F' else o_orderstatus end as status, o_orderstatus as was from orders where o_custkey % 10 != 7),
        r as (select count(distinct o_custkey) as recomputed from l where o_custkey % 10 = 3 or status != was), g as (select count(distinct o_custkey) as removed from orders where o_custkey % 10 = 7)
        select o_custkey, count(*) as n, count(*) filter (status = 'F') as done, any_value(recomputed) as recomputed, any_value(removed) as removed from l, r, g group by o_custkey""",
    ),
    "memo_keys": (
        q_memo_keys,
        _values([("'a'", "s~a"), ("7", "n~7"), ("-1", "n~-1"), ("('a', 1)", "t|s~a|n~1"), ("('a', ('b', 2))", "t|s~a|t|s~b|n~2"), ("True", "key.invalidType"), ("nan", "key.notFinite"), ("None", "key.invalidType")], "value", "key"),
    ),
    "change_log": (q_change_log, "select cast(o_orderkey as bigint) as o, o_orderstatus as status from orders where o_orderkey % 5 != 0"),
    "watch_outputs": (q_watch, "select cast(o_orderkey as bigint) as o from orders where o_orderkey % 5 != 0 and o_orderstatus = 'O'"),
    "watch_affected": (q_affected_outputs, _values([("Orders", "Open"), ("Part", "Known")], "touched", "output")),
    "stream_series": (
        q_stream_series,
        "select 'symbol' as kind, user_id || '.ts:' || event_type as key, cast((epoch_ms(ts) - 1704067200000) // 86400000 as bigint) as bucket, count(*) as count, cast(floor(avg(cast(floor(value * 100) as bigint))) as bigint) as mean from events where epoch_ms(ts) >= 1704067200000 group by all",
    ),
    "text_normal": (
        q_text_normal,
        "select n_name, 'a b c' as bare, case when regexp_matches(lower(n_name) || 's', 'ies$') then regexp_replace(lower(n_name) || 's', 'ies$', 'y') when regexp_matches(lower(n_name) || 's', '(s|x|z|ch|sh)es$') then regexp_replace(lower(n_name) || 's', 'es$', '') when regexp_matches(lower(n_name) || 's', '[^s]s$') then regexp_replace(lower(n_name) || 's', 's$', '') else lower(n_name) || 's' end as one from nation",
    ),
}

PROOFS_SQL = f"""
with recursive {RING_SQL},
p as (
  select src as a, dst as b, 1 as k, 'Out(' || src || ', ' || dst || ') (rule 0)' || chr(10) || '  Edge(' || src || ', ' || dst || ') (fact)' as proof from ring
  union all
  select p.a, r.dst, k + 1, 'Out(' || p.a || ', ' || r.dst || ') (rule 1)' || chr(10) || '  ' || replace(proof, chr(10), chr(10) || '  ') || chr(10) || '  Edge(' || r.src || ', ' || r.dst || ') (fact)'
  from p join ring r on r.src = p.b where k < 25)
select 'Out(' || a || ', ' || b || ')' as tuple, cast(case when k = 1 then 0 else 1 end as int) as rule, proof from p qualify row_number() over (partition by a, b order by k) = 1"""


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql} | {"dl_proofs": PROOFS_SQL}
