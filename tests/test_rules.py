"""Every check over generated facts against DuckDB, and examples worked by hand."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from stratalog import rules as R
from stratalog.rules import extraction as X
from stratalog.rules.schema import RUNTIME, STATIC, relations

KNOWN = {**relations(STATIC), **relations(RUNTIME), "IsConfigFile": [("file", "symbol")], "IsManagedTable": [("name", "symbol")]}
DERIVED = {name: [*((c, "symbol") for c in columns), ("n", "number")] for name, (_, columns) in R.COUNTS.items()}
DERIVED |= {"TaintedSymbol": [("symbol", "symbol")], "RuntimeMutual": [("file", "symbol")]}
KIND = {"symbol": "string", "number": "long"}


def words_of(relation, checks):
    """The literals that conditions on the relation look for, so that generated rows meet them often."""
    texts = [c.where for c in (*checks, *R.CONTEXTS.values()) if c.relation == relation]
    return sorted({w for t in texts for w in re.findall(r"'([^'%]+)'", t)}) or ["none"]


def rows_for(rng, columns, words, n=40):
    """Few names, so that joins meet; numbers on both sides of every limit."""
    def value(name, kind):
        if kind == "number":
            return rng.choice([0, 1, 2, 3, 5, 6, 10, 12, 20, 26, 30, 100, 300, 301, 500, 851, 1501, 2001, 7000, 30000]) if name not in ("line",) else rng.randrange(4)
        return rng.choice([f"f{rng.randrange(6)}", rng.choice(words)])

    return sorted({tuple(value(c, k) for c, k in columns) for _ in range(4 if len(columns) == 1 else n)})


@pytest.mark.parametrize("family", ["STATIC", "RUNTIME"])
def test_checks_match_sql(spark, family):
    """All checks of the table at once, over two sets of generated facts; each check's own SQL gives the expected rows."""
    checks = getattr(R, family)
    rng, fired = random.Random(13), set()
    for _ in range(2):
        tables = {name: rows_for(rng, columns, words_of(name, checks)) for name, columns in {**KNOWN, **DERIVED}.items()}
        frames = {n: spark.createDataFrame(rows, ", ".join(f"`{c}` {KIND[k]}" for c, k in {**KNOWN, **DERIVED}[n])) for n, rows in tables.items()}
        found = sorted(tuple(r) for r in R.violations(frames, checks, R.CONTEXTS).collect())
        con = duckdb.connect()
        for name, rows in tables.items():
            columns = {**KNOWN, **DERIVED}[name]
            con.execute(f'create table "{name}" ({", ".join(f"{chr(34)}{c}{chr(34)} {chr(39) and ("varchar" if k == "symbol" else "bigint")}" for c, k in columns)})')
            if rows:
                con.executemany(f'insert into "{name}" values ({", ".join("?" * len(columns))})', rows)
        wanted = sorted(tuple(r) for c in checks for r in con.execute(R.check_sql(c, R.CONTEXTS, [x for x, _ in {**KNOWN, **DERIVED}[c.relation]])).fetchall())
        assert found == wanted
        fired |= {r[0] for r in found}
    assert len(fired) >= 0.9 * len({c.name for c in checks}), sorted({c.name for c in checks} - fired)


def test_table_is_whole():
    assert all(c.relation in KNOWN or c.relation in DERIVED for c in (*R.STATIC, *R.RUNTIME))
    for c in (*R.STATIC, *R.RUNTIME):
        assert all(u.partition(":")[0] in R.CONTEXTS for u in (*c.needs, *c.lacks)), c
    assert len(R.rule_names()) > 90


def frames(spark, facts):
    return {n: spark.createDataFrame(rows, ", ".join(f"`{c}` {KIND[k]}" for c, k in KNOWN[n])) for n, rows in facts.items()}


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_cycles_and_exemptions(spark):
    facts = frames(spark, {"CycleNode": [("src/a.ts", "cycle-1", "false"), ("src/b.ts", "cycle-1", "false"), ("src/c.ts", "cycle-2", "true")]})
    assert found(R.static_violations(facts, {"CYCLES"})) == [("CYCLES", "src/a.ts", "cycle-1", 0), ("CYCLES", "src/b.ts", "cycle-1", 0)]
    exempt = spark.createDataFrame([("CYCLES", "src/a.ts", "cycle-1"), ("OTHER", "src/b.ts", ""), ("CYCLES", "src/b.ts", "cycle-9")], "rule string, place string, detail string")
    assert found(R.static_violations(facts, {"CYCLES"}, exempt)) == [("CYCLES", "src/b.ts", "cycle-1", 0)]
    whole = spark.createDataFrame([("CYCLES", "src/b.ts", None)], "rule string, place string, detail string")
    assert found(R.static_violations(facts, {"CYCLES"}, whole)) == [("CYCLES", "src/a.ts", "cycle-1", 0)]


def test_missing_relations_pass_a_check_over(spark):
    facts = frames(spark, {"ModuleFanIn": [("a", 30)]})
    with pytest.raises(ValueError):
        R.static_violations(facts, {"COMPOSITE-HUB-UNTESTED"})
    facts |= frames(spark, {"TestedFile": [("b",)]})
    assert found(R.static_violations(facts, {"COMPOSITE-HUB-UNTESTED", "CYCLES"})) == [("COMPOSITE-HUB-UNTESTED", "a", "", 0)]


def test_counts_are_derived(spark):
    facts = frames(spark, {"EnvRead": [("a", 1, "X", "n"), ("b", 1, "X", "n"), ("c", 1, "X", "n"), ("c", 2, "Y", "n"), *((f, 3, "NODE_ENV", "n") for f in "abcd")]})
    assert found(R.static_violations(facts, {"COMPOSITE-ENV-VAR-SPREAD"})) == [("COMPOSITE-ENV-VAR-SPREAD", "X", "", 0)]


def test_taint_is_handed_on(spark):
    """request -> load(0) -> store(1): the sink in store is reached although only load's argument came from outside."""
    facts = frames(spark, {
        "TaintedArgumentToCall": [("r.ts", "route", "load", 0, "req.body"), ("l.ts", "load", "store", 1, "param"), ("x.ts", "other", "quiet", 5, "req.body")],
        "FunctionParam": [("l.ts", "load", "body", 0), ("s.ts", "store", "key", 0), ("s.ts", "store", "value", 1), ("q.ts", "quiet", "p", 0)],
        "TaintSink": [("s.ts", 9, "sql", "query", "store"), ("q.ts", 3, "sql", "query", "quiet"), ("l.ts", 2, "exec", "run", "load")],
        "SanitizerCall": [("l.ts", 1, "shellEscape", "load")],
    })
    names = {"COMPOSITE-CROSS-FN-SQLI", "COMPOSITE-CROSS-FN-CMD-INJECTION", "COMPOSITE-CROSS-FUNCTION-TAINT"}
    assert found(R.static_violations(facts, names)) == [("COMPOSITE-CROSS-FN-SQLI", "s.ts", "", 9), ("COMPOSITE-CROSS-FUNCTION-TAINT", "l.ts", "", 2), ("COMPOSITE-CROSS-FUNCTION-TAINT", "s.ts", "", 9)]


def test_run_without_traffic_is_silent(spark):
    routes = frames(spark, {"RuntimeRouteExpected": [("GET", "/a"), ("GET", "/b")]})
    none = routes | {"HttpRouteHit": spark.createDataFrame([], "method string, routePath string, status long, count long, p95LatencyMs long")}
    assert found(R.runtime_alerts(none, {"DEAD_ROUTE"})) == []
    some = routes | frames(spark, {"HttpRouteHit": [("GET", "/a", 200, 3, 5)]})
    assert found(R.runtime_alerts(some, {"DEAD_ROUTE"})) == [("DEAD_ROUTE", "GET", "/b", 0)]


def test_cycle_confirmed_by_calls_both_ways(spark):
    facts = frames(spark, {"CycleNode": [("a", "c1", "false"), ("b", "c1", "false"), ("z", "c2", "false")], "CallEdgeRuntime": [("a", "f", "b", "g", 1), ("b", "h", "a", "f", 2), ("z", "f", "a", "f", 1)]})
    assert [r[1] for r in found(R.runtime_alerts(facts, {"COMPOSITE_CYCLE_RUNTIME_CONFIRMED"}))] == ["a", "b"]


NUMBER = "file string, line long, valueText string, valueAbs long, parentKind string, parentName string, parentArgIdx long, isScreamingSnake long, isRatio long, isTrivial long"


def test_magic_numbers(spark):
    rows = [
        ("a.ts", 1, "30000", 30000, "CallExpression", "setInterval", 1, 0, 0, 0), ("b.test.ts", 2, "5000", 5000, "CallExpression", "setInterval", 1, 0, 0, 0),
        ("a.ts", 3, "5000", 5000, "CallExpression", "other", 0, 0, 0, 0), ("a.ts", 4, "5", 5, "CallExpression", "other", 0, 0, 0, 0),
        ("a.ts", 5, "7", 7, "PropertyAssignment", "timeoutMs", 0, 0, 0, 0), ("a.ts", 6, "7", 7, "PropertyAssignment", "maxItems", 0, 0, 0, 0),
        ("a.ts", 7, "0.5", 0, "PropertyAssignment", "share", 0, 0, 1, 0), ("a.ts", 8, "9999", 9999, "PropertyAssignment", "share", 0, 0, 0, 0),
        ("a.ts", 9, "4096", 4096, "VariableDeclaration", "SIZE", 0, 1, 0, 0), ("a.ts", 10, "4096", 4096, "VariableDeclaration", "size", 0, 0, 0, 0),
        ("a.ts", 11, "4096", 4096, "BinaryExpression", "", 0, 0, 0, 0), ("a.ts", 12, "0", 0, "CallExpression", "setInterval", 1, 0, 0, 1), ("a.ts", 13, "9000", 9000, "ArrayLiteral", "", 0, 0, 0, 0),
    ]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    facts = {
        "NumericLiteralAst": spark.createDataFrame(rows, NUMBER), "TimeoutFnName": names("setInterval"), "TimeoutPropertyName": names("timeoutMs"),
        "ThresholdPropertyName": names("maxItems", "timeoutMs"), "FileTag": spark.createDataFrame([("b.test.ts", "test")], "file string, tag string"),
    }
    got = {r["line"]: r["category"] for r in X.extract(facts)["MagicNumber"].collect()}
    assert got == {1: "timeout", 3: "large-int", 5: "timeout", 6: "threshold", 7: "ratio", 8: "large-int", 10: "large-int", 11: "large-int"}


def test_decided_candidates(spark):
    call = "file string, line long, calleeKind string, calleeName string, calleeObjectLast string, firstArgKind string, firstArgValue string, isNew long, containingSymbol string"
    facts = {
        "CallExpressionAst": spark.createDataFrame(
            [("a", 1, "Identifier", "eval", "", "", "", 0, "s"), ("a", 2, "Identifier", "Function", "", "", "", 1, "s"), ("a", 3, "Identifier", "Function", "", "", "", 0, "s"),
             ("a", 4, "PropertyAccess", "createHash", "crypto", "string", "md5", 0, "s"), ("a", 5, "PropertyAccess", "createHash", "crypto", "identifier", "x", 0, "s"),
             ("a", 6, "PropertyAccess", "createHash", "crypto", "string", "md5", 0, "s"), ("t", 1, "Identifier", "eval", "", "", "", 0, "s")], call),
        "CryptoMethodName": spark.createDataFrame([("createHash",)], "name string"), "FileTag": spark.createDataFrame([("t", "test")], "file string, tag string"),
        "ExemptionLine": spark.createDataFrame([("a", 6, "crypto-ok"), ("a", 1, "crypto-ok"), ("p", 1, "taint-ok")], "file string, line long, marker string"),
        "BinaryExpressionAst": spark.createDataFrame([("a", 1, "===", "x", "x", 0), ("a", 2, "+", "x", "x", 0), ("a", 3, "===", "x", "y", 0), ("a", 4, "===", "1", "1", 1)], "file string, line long, op string, leftText string, rightText string, leftIsShortLiteral long"),
        "SuspectBinaryOp": spark.createDataFrame([("===",)], "op string"),
        "FunctionScope": spark.createDataFrame([("a", 1, "setOn", 1, 1), ("a", 2, "run", 1, 0), ("a", 3, "setBoth", 2, 1)], "file string, line long, name string, totalParams long, nameMatchesSetterPredicate long"),
        "FunctionParam": spark.createDataFrame([("a", n, 0, "on", "boolean") for n in (1, 2, 3)] + [("a", 3, 1, "name", "string")], "file string, scopeLine long, paramIndex long, paramName string, typeText string"),
        "BooleanParamTypeText": spark.createDataFrame([("boolean",)], "text string"),
        "TaintSinkCandidate": spark.createDataFrame([("p", 1, "sql", "q", "s"), ("p", 2, "sql", "q", "s"), ("t", 2, "sql", "q", "s")], "file string, line long, kind string, callee string, containingSymbol string"),
        "BarrelFileFact": spark.createDataFrame([("t", 3)], "file string, reExportCount long"),
    }
    out = X.extract(facts)
    assert found(out["EvalCall"]) == [("a", 1, "eval", "s"), ("a", 2, "function-constructor", "s")]
    assert found(out["CryptoCall"]) == [("a", 4, "createHash", "md5", "s"), ("a", 5, "createHash", "", "s")]
    assert found(out["DeadCode"]) == [("a", 1, "identical-subexpressions", "===", "x")]
    assert [r[1] for r in found(out["BooleanParamSiteOut"])] == ["run", "setBoth"]
    assert found(out["TaintSinkOut"]) == [("p", 2, "sql", "q", "s")] and found(out["BarrelFileOut"]) == [("t", 3)]
    assert "MagicNumber" not in out
