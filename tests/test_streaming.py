"""The memo, change logs and span streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stratalog.lang import parse
from stratalog.streaming import ChangeLog, Database, IncrementalError, stream_call_edges, stream_series, watch
from stratalog.streaming.changes import CHANGE_SCHEMA, affected_outputs
from stratalog.streaming.incremental import value_hash


@pytest.fixture
def words():
    db, calls = Database(), []
    db.input("text")

    @db.query("count")
    def count(db, key):
        calls.append(("count", key))
        return len(db.get("text", key).split())

    @db.query("total")
    def total(db, key):
        calls.append(("total", key))
        return sum(db.get("count", k) for k in ("a", "b"))

    db.set("text", "a", "one two")
    db.set("text", "b", "three")
    return db, calls, total


def test_only_what_changed_runs_again(words):
    db, calls, total = words
    assert total() == 3 and len(calls) == 3 and total() == 3 and len(calls) == 3
    db.set("text", "a", "one two three")
    assert total() == 4 and calls[3:] == [("count", "a"), ("total", "")]
    db.set("text", "b", "three")  # the same value
    assert total() == 4 and len(calls) == 5


def test_equal_results_stop_the_wave(words):
    db, calls, total = words
    total()
    db.set("text", "a", "uno dos")
    assert total() == 3 and calls[3:] == [("count", "a")] and db.stats.kept == 1


def test_errors(words):
    db, _, _ = words

    def code(f):
        with pytest.raises(IncrementalError) as e:
            f()
        return e.value.code

    db.query("self")(lambda db, key: db.get("self", key))
    db.query("sets")(lambda db, key: db.set("text", "a", "x"))
    assert code(lambda: db.get("self")) == "cycle"
    assert code(lambda: db.get("sets")) == "input.setInsideQuery"
    assert code(lambda: db.get("text", "zzz")) == "input.unset"
    assert code(lambda: db.input("text")) == "query.duplicateId"
    assert not db.running and db.get("total") == 3


def test_peek_reset_and_keys(words):
    db, calls, total = words
    assert db.peek("total") is None
    total()
    assert db.peek("total") == 3 and db.has("text", "a") and not db.has("text", "c")
    db.reset()
    assert db.peek("total") is None and total() == 3 and len(calls) == 6
    db.set("text", 1, "number")
    assert db.get("text", 1) == "number" and not db.has("text", "1"), "keys are typed"


def test_saved_inputs_come_back(words, tmp_path):
    db, _, _ = words
    db.set("text", ("pair", 1), {"k": (1, 2), "s": {3, 1}})
    mark = db.save(tmp_path / "db.jsonl")
    db.set("text", "b", "three four")
    db.save(tmp_path / "db.jsonl", mark)
    assert len((tmp_path / "db.jsonl").read_text().splitlines()) == 5
    other = Database()
    other.load(tmp_path / "db.jsonl")
    assert other.get("text", "b") == "three four" and other.get("text", ("pair", 1)) == {"k": (1, 2), "s": {1, 3}}
    (tmp_path / "old.jsonl").write_text('{"version": 0}\n')
    with pytest.raises(IncrementalError) as e:
        other.load(tmp_path / "old.jsonl")
    assert e.value.code == "persistence.version"


def test_frames_compare_by_their_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "n long, s string")
    assert value_hash(a) == value_hash(a.orderBy(F.desc("n")))
    assert value_hash(a) != value_hash(a.where("n = 1")) != value_hash(a.unionByName(a))
    db = Database()
    db.input("rows")
    runs = []
    db.query("n")(lambda db, key: runs.append(1) or db.get("rows").count())
    db.set("rows", "", a)
    assert db.get("n") == 2
    db.set("rows", "", a.repartition(3))
    assert db.get("n") == 2 and len(runs) == 1


PROGRAM = """.decl E(a: symbol, b: symbol) .input E
.decl Mark(a: symbol, n: number) .input Mark
.decl R(a: symbol, b: symbol) .output R
.decl Big(a: symbol) .output Big
R(A, B) :- E(A, B).
R(A, C) :- R(A, B), E(B, C).
Big(A) :- Mark(A, N), N > 5."""


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, parse(PROGRAM), str(tmp_path))
    change = lambda *rows: spark.createDataFrame(list(rows), CHANGE_SCHEMA)
    now = lambda rel: sorted(tuple(r) for r in log.current(rel).collect())
    assert now("E") == []
    assert log.append(change(("E", "+", ["a", "b"]), ("E", "+", ["b", "c"]), ("Mark", "+", ["a", "7"])), 0) == ["E", "Mark"]
    assert now("E") == [("a", "b"), ("b", "c")] and now("Mark") == [("a", 7)]
    for _ in range(2):  # a replayed batch counts once
        log.append(change(("E", "-", ["a", "b"]), ("E", "+", ["c", "d"])), 1)
    assert now("E") == [("b", "c"), ("c", "d")]
    log.compact("E")
    assert now("E") == [("b", "c"), ("c", "d")]
    log.append(change(("E", "+", ["a", "b"])), 2)
    assert now("E") == [("a", "b"), ("b", "c"), ("c", "d")]
    with pytest.raises(Exception, match="load.badChange"):
        log.append(change(("E", "+", ["only one"])), 3)
    assert affected_outputs(parse(PROGRAM), ["Mark"]) == ["Big"]


def test_watch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    seen = []

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps({"rel": r, "op": op, "row": row}) for r, op, row in rows))

    def drain():
        stream = spark.readStream.schema(CHANGE_SCHEMA).json(str(source))
        q = watch(spark, parse(PROGRAM), stream, str(tmp_path / "state"), lambda n, out: seen.append({k: sorted(tuple(r) for r in v.collect()) for k, v in out.items()}))
        q.awaitTermination()

    put("1.json", ("E", "+", ["a", "b"]), ("E", "+", ["b", "c"]))
    drain()
    put("2.json", ("Mark", "+", ["m", "9"]))
    drain()
    put("3.json", ("E", "-", ["b", "c"]))
    drain()
    assert seen == [{"R": [("a", "b"), ("a", "c"), ("b", "c")]}, {"Big": [("m",)]}, {"R": [("a", "b")]}]


SPANS = "span_id string, parent_id string, attributes map<string,string>, start_ms long, end_ms long, duration_ms long"


def span(i, parent, file, fn, start, ms):
    return (i, parent, {"code.filepath": file, "code.function": fn} if file else {}, start, start + ms, ms)


def test_span_streams(spark, tmp_path):
    from stratalog.operators import series, spans

    rows = [span(f"s{k}", f"s{k // 2}" if k else None, f"f{k % 3}.ts" if k % 5 else None, f"fn{k % 2}", 10_000 + 370 * k, 20 + k) for k in range(40)]
    frame = spark.createDataFrame([*rows, span("early", None, "f0.ts", "fn0", 9_000, 5)], SPANS)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))

    def drained(f, mode):
        stream = f(spark.readStream.schema(SPANS).parquet(str(tmp_path / "in")))
        name = f"t_{mode}_{f.__name__.strip('<>')}"
        stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    got = drained(lambda s: stream_series(s, 10_000, 1000), "complete")
    truth = series.bucketed(spans.series_keys(frame), F.col("start_ms"), 10_000, 1000, F.col("duration_ms"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, truth.select("kind", "key", "bucket", "count", "mean").collect()))
    edges = drained(lambda s: stream_call_edges(s), "append").groupBy("from_file", "from_fn", "to_file", "to_fn").count()
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, spans.call_edges(frame).collect()))


def test_partition_memo(spark):
    """Only changed partitions reach the function; results are those of the whole input each time, null keys and repeated rows included."""
    from stratalog.streaming.partitions import PartitionMemo

    seen = []

    def total(df):
        seen.append(sorted((r["f"] for r in df.select("f").distinct().collect()), key=str))
        return df.groupBy("f").agg(F.sum("v").alias("v"))

    frame = lambda rows: spark.createDataFrame(rows, "f string, v long")
    memo = PartitionMemo("f", total)
    rows = [("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)]
    read = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert read(memo.refresh(frame(rows))) == [("a", 3), ("b", 3), ("c", 5), (None, 4)]
    memo.refresh(frame(rows[::-1]))
    assert len(seen) == 1 and (memo.recomputed, memo.removed) == (0, 0), "an order is no change"
    changed = [("a", 1), ("a", 2), ("a", 2), (None, 9), ("d", 1), ("c", 5)]
    assert read(memo.refresh(frame(changed))) == [("a", 5), ("c", 5), ("d", 1), (None, 9)]
    assert seen[1] == [None, "a", "d"]
    assert (memo.recomputed, memo.removed) == (3, 1)
    assert read(memo.refresh(frame(changed).where("false"))) == [] and memo.removed == 4


def test_stream_result_stays_out_of_the_driver(spark):
    from stratalog.queries import queries

    found = queries()["stream_series"](spark, "/root/testdata/sf0.001")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("series_")], "a table in the driver's memory"
    assert found.inputFiles() and found.count()


def test_watched_changes_keep_their_files(spark, tmp_path, monkeypatch):
    from stratalog.queries import scans

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").repartition(5)
    monkeypatch.setattr(scans, "table", lambda s, d, name: orders)
    monkeypatch.setattr(scans, "scratch_path", lambda s, name: str(tmp_path / name))
    got = {r["o"] for r in scans.q_watch(spark, "").collect()}
    assert got == {r[0] for r in orders.where("o_orderkey % 5 != 0 and o_orderstatus = 'O'").select("o_orderkey").collect()}
    assert len(list((tmp_path / "watch/in/0").glob("*.parquet"))) > 1, "one task wrote a whole batch"
