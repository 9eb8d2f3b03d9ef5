"""Asking: rule text over live relations, result caches, checks with a baseline, time limits, and the command line."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
import threading
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..lang import DatalogError, Program, merge, parse
from ..operators.diff import new_violations
from .engine import RunResult, evaluate, run_dirs

VIOLATION = ["rule", "file", "line", "msg"]


@dataclass
class Answer:
    """Up to ``limit`` sorted tuples of each output, and whether there were more."""

    rows: dict[str, list[tuple]]
    truncated: dict[str, bool]


def ask(spark: SparkSession, text: str, relations: Mapping[str, DataFrame], limit: int = 100, allow_recursion: bool = False) -> Answer:
    """Rule text over live relations. Relations that the text reads but does not declare are declared by their DataFrames.

    Only relations that the text names are scanned, and no more than the
    tuples asked for reach the driver.
    """
    given = {name: df for name, df in relations.items() if name in _names(text)}
    declared = set(parse_declared(text))
    kind = lambda f: "number" if f.dataType.typeName() in ("byte", "short", "integer", "long") else "symbol"
    head = "".join(f".decl {name}({', '.join(f'{f.name}: {kind(f)}' for f in df.schema.fields)})\n.input {name}\n" for name, df in sorted(given.items()) if name not in declared)
    program = merge([("<relations>", head), ("<query>", text)] if head else [("<query>", text)])
    result = evaluate(spark, program, {n: df for n, df in given.items() if n in program.inputs}, allow_recursion)
    rows, more = {}, {}
    for rel, df in result.outputs.items():
        got = df.orderBy(*df.columns).limit(limit + 1).collect()
        rows[rel], more[rel] = [tuple(r) for r in got[:limit]], len(got) > limit
    return Answer(rows, more)


def parse_declared(text: str) -> list[str]:
    from ..lang.parser import tokens

    words = list(tokens(text, "<query>"))
    return [b.text for a, b in zip(words, words[1:], strict=False) if a.text == ".decl"]


def _names(text: str) -> set[str]:
    from ..lang.parser import tokens

    return {t.text for t in tokens(text, "<query>") if t.kind == "name"}


@dataclass
class ResultCache:
    """Results by the hash of rules and facts: parsed programs by text, evaluations by text and the fingerprints of the facts."""

    spark: SparkSession
    programs: dict[str, Program] = field(default_factory=dict)
    results: dict[str, RunResult] = field(default_factory=dict)
    keep: int = 8
    hits: int = 0

    def run(self, text: str, facts: Mapping[str, DataFrame], fingerprints: Mapping[str, str] | None = None, allow_recursion: bool = False) -> RunResult:
        """``fingerprints`` name the state of each relation (a table version, a set hash); without them one aggregate a relation tells."""
        from ..streaming.incremental import frame_hash

        name = hashlib.sha256(text.encode()).hexdigest()
        if name not in self.programs:
            self.programs[name] = parse(text)
        marks = fingerprints or {rel: frame_hash(df) for rel, df in facts.items()}
        key = hashlib.sha256(repr((name, allow_recursion, sorted(marks.items()))).encode()).hexdigest()
        if key in self.results:
            self.hits += 1
            return self.results[key]
        result = evaluate(self.spark, self.programs[name], facts, allow_recursion)
        while len(self.results) >= self.keep:
            self.results.pop(next(iter(self.results)))
        self.results[key] = result
        return result


def check(current: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Violations (rule, file, line, msg) that the baseline lacks, or all of them without one."""
    found = current.toDF(*VIOLATION).distinct()
    return found if baseline is None else new_violations(found, baseline.toDF(*VIOLATION), VIOLATION)


def within(spark: SparkSession, seconds: float, df: DataFrame) -> list | None:
    """All rows of df, or None once the time is up: its jobs are then cancelled on the cluster."""
    tag, done = f"within-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        if not done.is_set():
            expired.append(True)
            spark.sparkContext.cancelJobsWithTag(tag)

    expired: list[bool] = []
    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception:
        if expired:
            return None
        raise
    finally:
        done.set()
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def main(arguments: list[str] | None = None) -> int:
    """``run`` evaluates folders of rules over folders of facts; ``parse`` checks rule files; ``check`` fails on violations that a baseline lacks; ``query`` asks an endpoint over a folder of tables, ``serve`` answers them over HTTP."""
    p = argparse.ArgumentParser(prog="stratalog")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="evaluate rules")
    check_ = sub.add_parser("check", help="report violations")
    for s in (run, check_):
        s.add_argument("rules", nargs="+")
        s.add_argument("--facts", action="append", default=[])
        s.add_argument("--allow-recursion", action="store_true")
    run.add_argument("--json", action="store_true")
    run.add_argument("--proofs", action="append", default=[], metavar="RELATION")
    run.add_argument("--exit-on-output", action="store_true", help="exit 1 if any output has a tuple")
    check_.add_argument("--relation", default="Violation")
    check_.add_argument("--baseline", help="a fact file of accepted violations")
    check_.add_argument("--update-baseline", help="write the violations there")
    check_.add_argument("--sarif", action="store_true")
    check_.add_argument("--timeout", type=float, default=0)
    sub.add_parser("parse", help="check rule files").add_argument("files", nargs="+")
    query = sub.add_parser("query", help="ask an endpoint")
    query.add_argument("endpoint")
    query.add_argument("--data", required=True, help="a folder with a Parquet table for each relation")
    query.add_argument("--limit", type=int, default=1000)
    query.add_argument("--arg", action="append", default=[], metavar="name=value")
    server = sub.add_parser("serve", help="answer endpoints over HTTP")
    server.add_argument("--data", required=True)
    server.add_argument("--port", type=int, default=8321)
    a = p.parse_args(arguments)
    try:
        if a.command == "parse":
            program = merge([(f, Path(f).read_text(encoding="utf-8")) for f in a.files])
            print(f"{len(program.decls)} relations, {len(program.rules)} rules, {len(program.facts)} facts, {len(program.aggregates)} aggregates")
            return 0
        spark = SparkSession.getActiveSession() or SparkSession.builder.appName("stratalog").getOrCreate()
        if a.command in ("query", "serve"):
            return _endpoints(a, spark)
        result = run_dirs(spark, a.rules, a.facts, a.allow_recursion)
        return _run(a, result) if a.command == "run" else _check(a, spark, result)
    except DatalogError as e:
        print(e, file=sys.stderr)
        return 2


def _endpoints(a: argparse.Namespace, spark: SparkSession) -> int:
    from .endpoints import FolderRelations, call, serve

    relations = FolderRelations(spark, a.data)
    if a.command == "serve":
        serve(relations, port=a.port).serve_forever()
        return 0
    try:
        rows, more = call(relations, a.endpoint, a.limit, **dict(x.split("=", 1) for x in a.arg))
    except (KeyError, TypeError, ValueError) as e:
        print(e.args[0] if e.args else e, file=sys.stderr)
        return 2
    for row in rows:
        print(json.dumps(row, default=str, ensure_ascii=False))
    if more:
        print(f"more than {a.limit} rows", file=sys.stderr)
    return 0


def _run(a: argparse.Namespace, result: RunResult) -> int:
    text = result.json(a.proofs) + "\n" if a.json else result.text()
    sys.stdout.write(text)
    for rel in () if a.json else a.proofs:
        for proof in result.proofs(rel).values():
            print(proof.text())
    some = any(not df.isEmpty() for df in result.outputs.values())
    return int(a.exit_on_output and some)


def _check(a: argparse.Namespace, spark: SparkSession, result: RunResult) -> int:
    from ..sources.facts import read_relation, write_facts
    from ..sources.reports import sarif

    decl = result.program.decls[a.relation]
    baseline = read_relation(spark, a.baseline, decl) if a.baseline else None
    found = check(result.catalog.frame(a.relation), baseline)
    if a.update_baseline:
        write_facts(result.catalog.frame(a.relation).toDF(*VIOLATION), a.update_baseline)
    if a.timeout and (rows := within(spark, a.timeout, found)) is None:
        print(f"no answer within {a.timeout:g} s; skipped", file=sys.stderr)
        return 0
    rows = rows if a.timeout else found.orderBy(*VIOLATION).collect()
    if a.sarif:
        print(sarif(found))
    else:
        for r in sorted(tuple(x) for x in rows):
            print(f"{r[1]}:{r[2]}: [{r[0]}] {r[3]}")
    return int(bool(rows))


__all__ = ["Answer", "ResultCache", "ask", "check", "main", "within"]
