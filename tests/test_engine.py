"""Programs on Spark against expected tuples, fixtures on disk and the naive evaluator."""

from __future__ import annotations

import json
import random

import pytest

from stratalog.lang import DatalogError, parse
from stratalog.plans import evaluate, run_dirs, run_string

from .naive import evaluate as naive


def run(spark, text, facts=None, recursion=False):
    p = parse(text)
    frames = {}
    for rel, rows in (facts or {}).items():
        columns = ", ".join(f"{n} {'string' if k == 'symbol' else 'long'}" for n, k in p.decls[rel].columns)
        frames[rel] = spark.createDataFrame(rows, columns)
    return evaluate(spark, p, frames, recursion)


def check(spark, text, facts=None, rels=None, recursion=True):
    p, got = parse(text), run(spark, text, facts, recursion)
    truth = naive(p, facts or {})
    for rel in rels or sorted({r.head.rel for r in p.rules} | {a.result.name for a in p.aggregates}):
        assert got.rows(rel) == sorted(truth[rel]), rel


EDGES = ".decl E(a: symbol, b: symbol)\n.input E\n.decl R(a: symbol, b: symbol)\nR(A, B) :- E(A, B).\nR(A, C) :- R(A, B), E(B, C).\n"


def test_aggregates(spark):
    decl = ".decl Item(file: symbol, score: number)\n.input Item\n"
    rows = [("a.ts", 10), ("a.ts", 20), ("a.ts", 30), ("b.ts", 5), ("b.ts", 5)]
    text = decl + "".join(f".{k} {k.title()}(f: symbol, n: number) by Item(F, {'_' if k == 'count' else 'V'})\n" for k in ("count", "sum", "min", "max"))
    got = run(spark, text, {"Item": rows})
    assert got.rows("Count") == [("a.ts", 3), ("b.ts", 1)] and got.rows("Sum") == [("a.ts", 60), ("b.ts", 5)]
    assert got.rows("Min") == [("a.ts", 10), ("b.ts", 5)] and got.rows("Max") == [("a.ts", 30), ("b.ts", 5)]
    assert run(spark, decl + ".count All(n: number) by Item(_, _)", {"Item": []}).rows("All") == []
    assert run(spark, decl + '.count All(n: number) by Item("a.ts", _)\n.decl Big(n: number)\nBig(N) :- All(N), N > 2.', {"Item": rows}).rows("Big") == [(3,)]


@pytest.mark.parametrize(
    ("code", "text"),
    [
        ("eval.aggregateNonNumber", ".sum S(n: number) by A(_, X)"),
        ("eval.aggregateNoValueCol", ".sum S(n: number) by A(_, _)"),
        ("eval.aggregateArityMismatch", ".count S(x: symbol, n: number) by A(_, _)"),
        ("compile.mixedColumn", ".decl B(x: number)\nB(X) :- A(_, X)."),
        ("eval.constraintNonNumber", ".decl B(x: symbol)\nB(X) :- A(_, X), X > 5."),
        ("load.notInput", ".decl B(x: symbol)"),
        ("load.arityMismatch", ""),
    ],
)
def test_error_codes(spark, code, text):
    facts = {"B": [("x",)]} if code == "load.notInput" else {"A": [(1, "x")]}
    with pytest.raises(DatalogError) as e:
        if code == "load.arityMismatch":
            evaluate(spark, parse(".decl A(n: number, x: symbol)\n.input A"), {"A": spark.range(1)})
        else:
            run(spark, ".decl A(n: number, x: symbol)\n.input A\n" + text, facts).rows(list(facts)[0])
    assert e.value.code == code


def test_equality_is_typed(spark):
    text = '.decl S(x: symbol)\n.decl N(x: number)\nS("42"). S("x"). N(42).\n.decl Both(x: symbol)\nBoth(X) :- S(X), N(X).\n.decl Differ(x: symbol)\nDiffer(X) :- S(X), N(Y), X != Y.\n.decl Const(x: number)\nConst(X) :- N(X), S("x").'
    check(spark, text)
    assert run(spark, text).rows("Both") == [] and len(run(spark, text).rows("Differ")) == 2


def test_guards_negation_and_repeats(spark):
    facts = {"P": [("a", "a", 1), ("a", "b", 2), ("b", "b", 3), ("c", "d", 3)], "Q": [("a",), ("z",)]}
    text = """.decl P(x: symbol, y: symbol, n: number) .input P
    .decl Q(x: symbol) .input Q  .decl Any() .decl None() .decl Self(x: symbol) .decl Not(x: symbol) .decl Guarded(x: symbol) .decl Off(x: symbol) .decl Once(x: symbol) .decl Theta(n: number, m: number) .decl Wild(x: symbol)
    Any() :- P(_, _, _).
    None() :- P(_, _, 99).
    Self(X) :- P(X, X, _).
    Not(X) :- P(X, _, _), !Q(X).
    Guarded(X) :- Q(X), Any().
    Off(X) :- Q(X), !None(), !Any().
    Once("yes") :- !None().
    Theta(N, M) :- P(_, _, N), P(_, _, M), N < M.
    Wild(X) :- Q(X), !P(X, _, _)."""
    check(spark, text, facts)
    got = run(spark, text, facts)
    assert got.rows("Any") == [()] and got.rows("None") == [] and got.rows("Once") == [("yes",)] and got.rows("Wild") == [("z",)]


def test_closure_on_a_cycle(spark):
    facts = {"E": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]}
    assert len(run(spark, EDGES, facts, True).rows("R")) == 12
    check(spark, EDGES, facts)


def test_mutual_and_nonlinear_recursion(spark):
    text = EDGES + ".decl Odd(a: symbol, b: symbol)\n.decl Even(a: symbol, b: symbol)\nOdd(A, B) :- E(A, B).\nEven(A, C) :- Odd(A, B), E(B, C).\nOdd(A, C) :- Even(A, B), E(B, C).\n.decl T(a: symbol, b: symbol)\nT(A, B) :- E(A, B).\nT(A, C) :- T(A, B), T(B, C).\n.decl Far(a: symbol)\nFar(A) :- E(A, _), !T(A, A)."
    check(spark, text, {"E": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]})


def test_random_programs(spark):
    """Small random rules over random relations: the compiled result is the naive one."""
    rng = random.Random(12)
    for _ in range(12):
        decls = ".decl A(x: symbol, y: symbol)\n.input A\n.decl B(x: symbol, n: number)\n.input B\n"
        heads, rules = [], []
        for k in range(3):
            name = f"H{k}"
            decls += f".decl {name}(x: symbol, y: symbol)\n"
            for _ in range(rng.randint(1, 2)):
                atoms = [f"A({rng.choice(['X', '_', '\"a\"'])}, Y)", f"A(X, {rng.choice(['Y', 'Z', 'X', '_'])})"]
                if heads and rng.random() < 0.6:
                    atoms.append(f"{rng.choice(heads)}({rng.choice('XY')}, {rng.choice(['Z', '_', 'Y'])})")
                if rng.random() < 0.5:
                    atoms += ["B(Y, N)", f"N {rng.choice(['>', '<=', '!='])} {rng.randint(0, 3)}"]
                if heads and rng.random() < 0.5:
                    atoms.append(f"!{rng.choice(heads)}(X, {rng.choice(['_', 'Y'])})")
                if rng.random() < 0.3:
                    atoms.append("X != Y")
                rules.append(f"{name}(X, Y) :- {', '.join(atoms)}.")
            heads.append(name)
        facts = {"A": list({(rng.choice("abcd"), rng.choice("abcd")) for _ in range(8)}), "B": list({(rng.choice("abcd"), rng.randint(0, 3)) for _ in range(6)})}
        check(spark, decls + "\n".join(rules), facts)


def test_proofs(spark):
    got = run(spark, EDGES, {"E": [("a", "b"), ("b", "c")]}, True)
    proofs = got.proofs("R")
    assert sorted(proofs) == ['R("a", "b")', 'R("a", "c")', 'R("b", "c")']
    deep = proofs['R("a", "c")']
    assert deep.rule == 1 and [b.tuple for b in deep.body] == ['R("a", "b")', 'E("b", "c")'] and deep.body[0].rule == 0
    assert deep.text().splitlines()[0].startswith('R("a", "c")') and deep.as_dict()["body"][1]["rule"] is None


def test_text_and_json(spark):
    got = run_string(spark, '.decl A(x: symbol, n: number)\n.output A\nA("b", 2). A("a", -1). A("a", 10). A("q\\"", 0).')
    assert got.text() == 'A("a", -1).\nA("a", 10).\nA("b", 2).\nA("q\\"", 0).\n'
    assert json.loads(got.json())["outputs"]["A"][0] == ["a", -1]


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "project").mkdir()
    (tmp_path / "facts").mkdir()
    (tmp_path / "rules" / "a-schema.dl").write_text(".decl EmitsLiteral(file: symbol, line: number, eventName: symbol)\n.input EmitsLiteral\n.decl Exempted(file: symbol)\n.decl Violation(rule: symbol, file: symbol, line: number, msg: symbol)\n.output Violation\n")
    (tmp_path / "rules" / "b-rule.dl").write_text('Violation("R-1", F, L, "untyped") :- EmitsLiteral(F, L, _), !Exempted(F).\n')
    (tmp_path / "project" / "exempt.dl").write_text('Exempted("src/old.ts").\n')
    (tmp_path / "facts" / "EmitsLiteral.facts").write_bytes(b"src/old.ts\t3\tx\n\nsrc/new.ts\t-7\ty z\n\r\nsrc/new.ts\t-7\ty z\n")
    return tmp_path


def test_folders_and_ratchet(spark, folders):
    without = run_dirs(spark, [folders / "rules"], [folders / "facts"])
    assert without.rows("Violation") == [("R-1", "src/new.ts", -7, "untyped"), ("R-1", "src/old.ts", 3, "untyped")]
    texts = {run_dirs(spark, [folders / "rules", folders / "project"], [folders / "facts"]).text() for _ in range(2)}
    assert texts == {'Violation("R-1", "src/new.ts", -7, "untyped").\n'}
    with pytest.raises(DatalogError) as e:
        run_dirs(spark, [folders / "facts"])
    assert e.value.code == "runner.noRules"


@pytest.mark.parametrize(("code", "line"), [("load.badNumber", "a\t1.5\tx"), ("load.numberOverflow", "a\t9007199254740992\tx"), ("load.arityMismatch", "a\t1"), ("load.controlChar", "a\t1\tx\x01")])
def test_bad_fact_files(spark, folders, code, line):
    (folders / "facts" / "EmitsLiteral.facts").write_text(line + "\n")
    with pytest.raises(Exception) as e:
        run_dirs(spark, [folders / "rules"], [folders / "facts"]).rows("Violation")
    assert code in str(e.value)


def test_missing_fact_file_is_empty(spark, folders):
    (folders / "facts" / "EmitsLiteral.facts").unlink()
    assert run_dirs(spark, [folders / "rules"], [folders / "facts"]).rows("Violation") == []


def test_filters_reach_the_scan(spark, sf):
    from stratalog.queries.common import table

    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    got = evaluate(spark, parse('.decl O(k: number, s: symbol)\n.input O\n.decl F(k: number)\nF(K) :- O(K, "F").'), {"O": orders})
    plan = got.catalog.frame("F")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "EqualTo(o_orderstatus,F)" in plan.replace(" ", "")


def test_proofs_of_some_tuples(spark):
    """Derivations are a relation; a proof asked for one tuple holds what that one rests on, and no more."""
    text = ".decl E(a: number, b: number)\n.input E\n.decl R(a: number, b: number)\n.output R\nR(A, B) :- E(A, B).\nR(A, C) :- R(A, B), E(B, C).\nR(7, 8)."
    got = run_string(spark, text, {"E": spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")}, allow_recursion=True)
    found = {r["tuple"]: (r["round"], r["rule"], list(r["body"])) for r in got.derivations("R").collect()}
    assert len(found) == 21 and found["R(0, 1)"] == (1, 0, ["E(0, 1)"]) and found["R(0, 4)"] == (4, 1, ["R(0, 3)", "E(3, 4)"])
    proofs = got.proofs("R", ["R(1, 4)", "R(7, 8)", "R(9, 9)"])
    assert sorted(proofs) == ["R(1, 4)", "R(7, 8)"] and proofs["R(7, 8)"].rule is None
    assert proofs["R(1, 4)"].text().split("\n") == ["R(1, 4) (rule 1)", "  R(1, 3) (rule 1)", "    R(1, 2) (rule 0)", "      E(1, 2) (fact)", "    E(2, 3) (fact)", "  E(3, 4) (fact)"]
