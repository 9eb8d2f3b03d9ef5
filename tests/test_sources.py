"""Scans, sinks and the asking layer."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stratalog.plans.service import ResultCache, ask, check, main, within
from stratalog.sources import facts, records, reports

RULES = """.decl Size(file: symbol, n: number)
.input Size
.decl Exempt(file: symbol)
.decl Violation(rule: symbol, file: symbol, line: number, msg: symbol)
.output Violation
Violation("BIG", F, 1, "too big") :- Size(F, N), N > 10, !Exempt(F).
"""


def test_snapshots_bare_and_wrapped(spark, tmp_path):
    data = {"nodes": [{"id": "a", "type": "file", "tags": ["x"], "unknown": 1}], "edges": [{"id": "e", "from": "a", "to": "b", "type": "import", "resolved": True}]}
    (tmp_path / "bare.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"version": "3", "data": data}))
    for name in ("bare", "wrapped"):
        nodes, edges = records.read_snapshot(spark, str(tmp_path / f"{name}.json"))
        assert nodes.head()["id"] == "a" and edges.head()["to"] == "b" and edges.count() == 1


def test_history(spark, tmp_path):
    for day in (1, 2, 3):
        (tmp_path / f"snapshot-2026-01-0{day}.json").write_text(json.dumps({"nodes": [{"id": str(day)}], "edges": []}))
    (tmp_path / "snapshot-2026-01-04.json").write_text("{broken")
    (tmp_path / "other.json").write_text("{}")
    rows = records.read_history(spark, str(tmp_path), records.SNAPSHOT, 2).select("snapshot", F.col("nodes")[0]["id"].alias("id")).collect()
    assert sorted(map(tuple, rows)) == [("2026-01-02", "2"), ("2026-01-03", "3")]


def test_lines(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"ts": "1", "session": "s", "tool": "grep", "tokens": 5}\nnot json\n{"ts": "2", "session": "s", "tool": "read", "tokens": 7}\n{"ts": "3", "tokens": "many"}\n')
    assert [r["tool"] for r in records.read_telemetry(spark, str(path)).orderBy("ts").collect()] == ["grep", "read"]
    assert [r["ts"] for r in records.read_telemetry(spark, str(path), 1).collect()] == ["2"]
    path.write_text('{"id": "1", "r": "A", "v": "{}"}\n{"r": "A"}\n')
    assert records.read_fact_log(spark, str(path)).count() == 1


def test_transcripts_and_profiles(spark, tmp_path):
    use = {"type": "tool_use", "name": "Read", "id": "u1", "input": {"path": "a.ts"}}
    (tmp_path / "s.jsonl").write_text(json.dumps({"sessionId": "s", "timestamp": "1", "message": {"role": "x", "content": [{"type": "text"}, use]}}) + "\n")
    row = records.read_tool_uses(spark, str(tmp_path / "s.jsonl")).head()
    assert (row["session"], row["tool"], row["input"]["path"]) == ("s", "Read", "a.ts")
    frame = lambda fn, url: {"functionName": fn, "url": url, "lineNumber": 3}
    nodes = [{"id": 1, "hitCount": 0, "callFrame": frame("(root)", "")}, {"id": 2, "hitCount": 2, "callFrame": frame("work", "file:///app/src/a.ts")}, {"id": 3, "hitCount": 1, "callFrame": frame("lib", "file:///app/node_modules/x.js")}]
    (tmp_path / "p.json").write_text(json.dumps({"nodes": nodes, "samples": [2, 3, 2], "timeDeltas": [10, 5, 20]}))
    assert [tuple(r) for r in records.read_profile(spark, str(tmp_path / "p.json"), "/app").collect()] == [("src/a.ts", "work", 3, 2, 30)]


def test_facts_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a\tb\nc", 2.9), ("x", -2.9)], "file string, n double")
    text = reports.export_relations({"Size": df}, str(tmp_path))
    assert text == ".decl Size(file: symbol, n: number)\n.input Size\n"
    from stratalog.lang import parse

    back = facts.read_relation(spark, str(tmp_path / "Size.facts"), parse(text).decls["Size"])
    assert sorted(map(tuple, back.collect())) == [("a b c", 2), ("x", -2)], "numbers lose their fraction, towards zero"
    assert sorted(map(tuple, facts.merge_facts([back, back, back.limit(1)]).collect())) == sorted(map(tuple, back.collect()))
    assert facts.overlay({"A": 1, "B": 2}, {"B": 3}) == {"A": 1, "B": 3}


def test_sarif(spark):
    v = spark.createDataFrame([("R", "a.ts", 3, 'say "x"'), ("Q", "b.ts", 0, "m")], "rule string, file string, line long, msg string")
    doc = json.loads(reports.sarif(v))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["Q", "R"]
    places = [r["locations"][0]["physicalLocation"] for r in run["results"]]
    assert places[1]["region"] == {"startLine": 3} and "region" not in places[0]
    assert run["results"][1]["message"]["text"] == 'say "x"'


def test_snapshot_versions(spark, tmp_path):
    folder = str(tmp_path / "snaps")
    assert reports.complete_versions(spark, folder) == []
    for v in range(4):
        reports.write_snapshot({"nodes": spark.range(v)}, folder, v)
    assert reports.complete_versions(spark, folder) == [2, 3] and spark.read.parquet(f"{folder}/v3/nodes").count() == 3


def test_markdown(spark):
    changes = spark.createDataFrame([(i, "added") for i in range(4)] + [(9, "removed")], "k long, change string")
    text = reports.diff_markdown(changes, ["k"], "Nodes", 2)
    assert "### added (4)" in text and "- and 2 more" in text and "- `9`" in text
    order = spark.createDataFrame([("a", 0), ("b", 1)], "node string, position long")
    matrix = reports.matrix_markdown(order, spark.createDataFrame([("b", "a")], "src string, dst string"))
    assert matrix.splitlines()[2:] == ["| 1 a | ■ |  |", "| 2 b | x | ■ |"]
    with pytest.raises(ValueError):
        reports.matrix_markdown(order, spark.createDataFrame([], "src string, dst string"), 1)


def test_ask(spark):
    sizes = spark.createDataFrame([(f"f{i}", i) for i in range(30)], "file string, n int")
    answer = ask(spark, ".decl Big(f: symbol)\n.output Big\nBig(F) :- Size(F, N), N > 4.", {"Size": sizes, "Unread": spark.range(3)}, 10)
    assert len(answer.rows["Big"]) == 10 and answer.truncated == {"Big": True} and answer.rows["Big"][0] == ("f10",)
    few = ask(spark, ".decl Big(f: symbol)\n.output Big\nBig(F) :- Size(F, N), N > 27.", {"Size": sizes})
    assert few.rows == {"Big": [("f28",), ("f29",)]} and few.truncated == {"Big": False}


def test_cache(spark):
    a = spark.createDataFrame([("x", 11)], "file string, n long")
    cache = ResultCache(spark)
    first = cache.run(RULES, {"Size": a})
    assert cache.run(RULES, {"Size": a.select("*")}) is first and cache.hits == 1
    assert cache.run(RULES, {"Size": a.where("n > 99")}).rows("Violation") == []
    assert cache.run(RULES, {"Size": a}, {"Size": "version 1"}) is not first


def test_check_and_time_limit(spark):
    v = spark.createDataFrame([("R", "a", 1, "m"), ("R", "a", 1, "m"), ("R", "b", 1, "m")], "a string, b string, c long, d string")
    assert check(v).count() == 2 and [r["file"] for r in check(v, v.limit(1)).collect()] == ["b"]
    assert len(within(spark, 60, spark.range(3))) == 3
    slow = spark.range(0, 1 << 42, numPartitions=2).select(F.sum(F.length(F.sha2(F.col("id").cast("string").cast("binary"), 512))).alias("x"))
    assert within(spark, 2, slow) is None


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r").mkdir()
    (tmp_path / "f").mkdir()
    (tmp_path / "r" / "rules.dl").write_text(RULES)
    (tmp_path / "f" / "Size.facts").write_text("a.ts\t11\nb.ts\t3\n")
    rules, data = str(tmp_path / "r"), str(tmp_path / "f")
    assert main(["parse", str(tmp_path / "r" / "rules.dl")]) == 0 and "1 rules" in capsys.readouterr().out
    assert main(["run", rules, "--facts", data, "--exit-on-output"]) == 1
    assert capsys.readouterr().out == 'Violation("BIG", "a.ts", 1, "too big").\n'
    assert main(["run", rules, "--facts", data, "--proofs", "Violation"]) == 0 and "(rule 0)" in capsys.readouterr().out
    assert main(["run", rules, "--facts", data, "--json", "--proofs", "Violation"]) == 0 and json.loads(capsys.readouterr().out)["proofs"]["Violation"][0]["rule"] == 0
    assert main(["check", rules, "--facts", data, "--update-baseline", str(tmp_path / "base.facts")]) == 1
    assert "a.ts:1: [BIG] too big" in capsys.readouterr().out
    assert main(["check", rules, "--facts", data, "--baseline", str(tmp_path / "base.facts")]) == 0
    (tmp_path / "r" / "bad.dl").write_text("nonsense")
    assert main(["run", rules]) == 2 and "parse." in capsys.readouterr().err
