"""One rule, or one aggregate, as a DataFrame.

Variables become columns named ``v_<name>``. Types are settled before any
join is built: a variable or constant that meets both types equals nothing, so
no cast can sneak in, and a head whose types differ from its declaration is an
error.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import Aggregate, Atom, Const, Constraint, DatalogError, Decl, Rule, Var, Wildcard

KINDS = {"symbol": T.StringType(), "number": T.LongType()}


def schema_of(decl: Decl) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", KINDS[kind]) for i, (_, kind) in enumerate(decl.columns)] or [T.StructField("c", T.BooleanType())])


def empty(spark: SparkSession, decl: Decl) -> DataFrame:
    return spark.createDataFrame([], schema_of(decl))


def kind_of(value: str | int) -> str:
    return "symbol" if isinstance(value, str) else "number"


@dataclass
class Catalog:
    """Declarations and the DataFrames of what has been derived so far; a relation without columns has one that says it holds."""

    spark: SparkSession
    decls: dict[str, Decl]
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def frame(self, rel: str) -> DataFrame:
        if rel not in self.decls:
            raise DatalogError("eval.unknownRel", f"{rel} is not declared")
        return self.frames.get(rel) if rel in self.frames else empty(self.spark, self.decls[rel])

    def kinds(self, rel: str) -> list[str]:
        return [kind for _, kind in self.decls[rel].columns]


def tuple_text(rel: str, kinds: list[str]) -> Column:
    """``Rel(1, "a")`` of a row, the key of its proof."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))
    parts = [quote(F.col(f"c{i}")) if kind == "symbol" else F.col(f"c{i}").cast("string") for i, kind in enumerate(kinds)]
    return F.concat(F.lit(f"{rel}("), F.concat_ws(", ", *parts) if parts else F.lit(""), F.lit(")"))


def variable_kinds(rule: Rule, catalog: Catalog) -> tuple[dict[str, str], bool]:
    """Type of each variable, and whether one has two: the rule then derives nothing."""
    kinds: dict[str, str] = {}
    clash = False
    for atom in rule.positive:
        for term, kind in zip(atom.terms, catalog.kinds(atom.rel), strict=True):
            if isinstance(term, Var):
                clash |= kinds.setdefault(term.name, kind) != kind
            elif isinstance(term, Const):
                clash |= kind_of(term.value) != kind
    return kinds, clash


def check_head(rule: Rule, catalog: Catalog) -> None:
    kinds, clash = variable_kinds(rule, catalog)
    if clash:
        return
    for term, (name, kind) in zip(rule.head.terms, catalog.decls[rule.head.rel].columns, strict=True):
        own = kinds[term.name] if isinstance(term, Var) else kind_of(term.value)
        if own != kind:
            raise DatalogError("compile.mixedColumn", f"{rule.head.rel}.{name} is a {kind}, the rule gives a {own}", rule.head.where)


def _matching(atom: Atom, df: DataFrame, kinds: list[str], wanted: set[str], proof: str | None = None) -> DataFrame | None:
    """The atom's rows with a column for each wanted variable; None where a constant's type rules them all out."""
    conditions, first = [], {}
    for i, (term, kind) in enumerate(zip(atom.terms, kinds, strict=True)):
        if isinstance(term, Const):
            if kind_of(term.value) != kind:
                return None
            conditions.append(F.col(f"c{i}") == F.lit(term.value))
        elif isinstance(term, Var):
            if term.name in first:
                conditions.append(F.col(f"c{first[term.name]}") == F.col(f"c{i}"))
            else:
                first[term.name] = i
    for c in conditions:
        df = df.where(c)
    columns = [F.col(f"c{i}").alias(f"v_{name}") for name, i in first.items() if name in wanted]
    if proof:
        columns.append(tuple_text(atom.rel, kinds).alias(proof))
    return df.select(*columns) if columns else df.select(F.lit(True).alias("_any"))


def _constraint(c: Constraint, kinds: dict[str, str]) -> Column:
    def side(t) -> tuple[Column, str]:
        return (F.col(f"v_{t.name}"), kinds[t.name]) if isinstance(t, Var) else (F.lit(t.value), kind_of(t.value))

    (a, ka), (b, kb) = side(c.left), side(c.right)
    if c.op == "!=":
        return a != b if ka == kb else F.lit(True)
    if ka != "number" or kb != "number":
        raise DatalogError("eval.constraintNonNumber", f"{c.op} needs numbers on both sides", c.where)
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[c.op]


def compile_rule(rule: Rule, catalog: Catalog, delta: dict[int, DataFrame] | None = None, proofs: bool = False) -> DataFrame:
    """Head tuples (not yet distinct) as c0, c1, ...; ``delta`` replaces the rows of single positive atoms.

    A variable that occurs once is as good as a wildcard, so its column is
    pruned; an atom that then binds nothing new is a semi-join, which cannot
    multiply rows. Atoms join in an order that shares variables wherever one
    exists. With ``proofs`` a column ``body`` holds the tuples used.
    """
    check_head(rule, catalog)
    kinds, clash = variable_kinds(rule, catalog)
    head = catalog.decls[rule.head.rel]
    if clash:
        out = empty(catalog.spark, head)
        return out.withColumn("body", F.array().cast("array<string>")) if proofs else out
    uses = Counter(t.name for a in [*rule.positive, *rule.negative, rule.head] for t in a.terms if isinstance(t, Var))
    uses.update(t.name for c in rule.constraints for t in (c.left, c.right) if isinstance(t, Var))
    wanted = {name for name, n in uses.items() if n > 1}

    todo = list(enumerate(rule.positive))
    env, bound = None, set()
    while todo:
        at = next((k for k, (_, a) in enumerate(todo) if env is None or (a.vars & wanted) & bound), 0)
        i, atom = todo.pop(at)
        df = (delta or {}).get(i, catalog.frame(atom.rel))
        rows = _matching(atom, df, catalog.kinds(atom.rel), wanted, f"p_{i}" if proofs else None)
        own = atom.vars & wanted
        shared = [f"v_{n}" for n in sorted(own & bound)]
        if env is None:
            env = rows
        elif own <= bound and not proofs:
            env = env.join(rows, shared, "left_semi") if shared else env.join(rows.limit(1), F.lit(True), "left_semi")
        else:
            env = env.join(rows, shared) if shared else env.crossJoin(rows)
        bound |= own
    if env is None:
        env = catalog.spark.range(1).select(F.lit(True).alias("_any"))
    for c in rule.constraints:
        env = env.where(_constraint(c, kinds))
    for atom in rule.negative:
        clash = any(isinstance(t, Var) and kinds[t.name] != k for t, k in zip(atom.terms, catalog.kinds(atom.rel), strict=True))
        rows = None if clash else _matching(atom, catalog.frame(atom.rel), catalog.kinds(atom.rel), atom.vars)
        if rows is None:
            continue
        shared = [f"v_{n}" for n in sorted(atom.vars)]
        env = env.join(rows, shared, "left_anti") if shared else env.join(rows.limit(1), F.lit(True), "left_anti")
    columns = [(F.col(f"v_{t.name}") if isinstance(t, Var) and t.name in wanted else F.lit(t.value)).alias(f"c{i}") for i, t in enumerate(rule.head.terms)]
    columns = columns or [F.lit(True).alias("c")]
    if proofs:
        columns.append(F.array(*(F.col(f"p_{i}") for i in range(len(rule.positive)))).cast("array<string>").alias("body"))
    return env.select(*columns)


def compile_aggregate(agg: Aggregate, catalog: Catalog) -> DataFrame:
    """Groups of the (deduplicated) source; no rows, no group, even without keys."""
    source = agg.source
    if source.rel not in catalog.decls:
        raise DatalogError("eval.aggregateUnknownSource", f"{source.rel} is not declared", source.where)
    kinds = catalog.kinds(source.rel)
    places = [i for i, t in enumerate(source.terms) if isinstance(t, Var) and i < len(kinds)]
    value = None
    if agg.kind != "count":
        if not places:
            raise DatalogError("eval.aggregateNoValueCol", f".{agg.kind} needs a variable to take values from", source.where)
        value = places.pop()
        if kinds[value] != "number":
            raise DatalogError("eval.aggregateNonNumber", f".{agg.kind} needs numbers", source.where)
    if len(places) != len(agg.result.columns) - 1:
        raise DatalogError("eval.aggregateArityMismatch", f"{agg.result.name} has {len(agg.result.columns) - 1} keys, the pattern {len(places)}", source.where)
    for i, (name, kind) in zip(places, agg.result.columns, strict=False):
        if kinds[i] != kind:
            raise DatalogError("compile.mixedColumn", f"{agg.result.name}.{name} is a {kind}, the source gives a {kinds[i]}", source.where)
    df = catalog.frame(source.rel)
    for i, t in enumerate(source.terms):
        if isinstance(t, Const):
            df = df.where(F.col(f"c{i}") == F.lit(t.value) if i < len(kinds) and kind_of(t.value) == kinds[i] else F.lit(False))
        elif not isinstance(t, Var | Wildcard):
            raise DatalogError("eval.aggregateArityMismatch", "unknown term in an aggregate", source.where)
    if agg.kind == "count":
        measure = F.count(F.lit(1))
    else:
        measure = {"sum": F.sum, "min": F.min, "max": F.max}[agg.kind](f"c{value}")
    grouped = df.groupBy(*(F.col(f"c{i}").alias(f"k{n}") for n, i in enumerate(places))).agg(measure.alias("n"), F.count(F.lit(1)).alias("_rows"))
    return grouped.where("_rows > 0").select(*(F.col(f"k{n}").alias(f"c{n}") for n in range(len(places))), F.col("n").alias(f"c{len(places)}"))
