"""Evaluation of whole programs, stratum by stratum."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang import DatalogError, Program, merge, parse, stratify
from ..session import Growing, cut, store
from ..sources.facts import facts_frame, read_facts
from .compiler import Catalog, check_head, compile_aggregate, compile_rule, empty, kind_of, schema_of, tuple_text


@dataclass
class Proof:
    tuple: str
    rule: int | None = None  #: None for a fact
    body: list[Proof] = field(default_factory=list)

    def text(self, depth: int = 0) -> str:
        own = "  " * depth + self.tuple + (" (fact)" if self.rule is None else f" (rule {self.rule})")
        return "\n".join([own, *(b.text(depth + 1) for b in self.body)])

    def as_dict(self) -> dict:
        return {"tuple": self.tuple, "rule": self.rule, "body": [b.as_dict() for b in self.body]}


@dataclass
class RunResult:
    program: Program
    catalog: Catalog
    outputs: dict[str, DataFrame]
    stats: dict[str, float]

    def rows(self, rel: str) -> list[tuple]:
        """Sorted tuples of a relation."""
        decl = self.program.decls[rel]
        rows = self.catalog.frame(rel).distinct().collect()
        return [()] * bool(rows) if not decl.columns else sorted(tuple(r) for r in rows)

    def named(self, rel: str) -> DataFrame:
        """A relation under its declared column names."""
        return self.catalog.frame(rel).toDF(*(name for name, _ in self.program.decls[rel].columns))

    def text(self) -> str:
        """Sorted ``Rel("a", 1).`` lines of all outputs."""
        quote = lambda v: str(v) if not isinstance(v, str) else '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
        return "".join(f"{rel}({', '.join(map(quote, row))}).\n" for rel in self.outputs for row in self.rows(rel))

    def json(self, proofs: Sequence[str] = ()) -> str:
        """Outputs and statistics, with proof trees of the relations named."""
        out = {"outputs": {rel: [list(r) for r in self.rows(rel)] for rel in self.outputs}, "stats": self.stats}
        if proofs:
            out["proofs"] = {rel: [p.as_dict() for p in self.proofs(rel).values()] for rel in proofs}
        return json.dumps(out, ensure_ascii=False)

    def derivations(self, rel: str) -> DataFrame:
        """(tuple, round, rule, body): of every tuple that ``rel`` rests on and that no fact gives, its first derivation by round, rule and body.

        All ways to derive a tuple are listed once. Each round settles the
        tuples whose bodies hold by then, and strikes them from the bodies of
        the ways still open, so what is written shrinks from round to round;
        nothing is collected.
        """
        needed, todo = set(), [rel]
        while todo:
            name = todo.pop()
            if name not in needed:
                needed.add(name)
                todo += [a.rel for r in self.program.rules if r.head.rel == name for a in r.positive]
        text = lambda name: tuple_text(name, self.catalog.kinds(name))
        ways = [
            compile_rule(rule, self.catalog, proofs=True).select(text(rule.head.rel).alias("tuple"), F.lit(i).alias("rule"), "body").distinct()
            for i, rule in enumerate(self.program.rules)
            if rule.head.rel in needed
        ]
        spark = self.catalog.spark
        none = spark.createDataFrame([], "tuple string, round int, rule int, body array<string>")
        if not ways:
            return none
        given = _union([self.catalog.given[name].select(text(name).alias("tuple")) for name in sorted(needed)]).distinct()
        open_ = store(_union(ways).join(given, "tuple", "left_anti").withColumn("way", F.monotonically_increasing_id()), "ways")
        heads = open_.select("tuple").distinct()
        wants = cut(open_.select("way", F.explode(F.array_distinct("body")).alias("want")).join(heads.withColumnRenamed("tuple", "want"), "want", "left_semi"))
        out, n = Growing(none), 0
        while True:
            n += 1
            fit = open_.join(wants.select("way"), "way", "left_anti").join(out.df.select("tuple"), "tuple", "left_anti")
            first = fit.groupBy("tuple").agg(F.min(F.struct("rule", "body")).alias("d"))
            new = cut(first.select("tuple", F.lit(n).alias("round"), F.col("d.rule").alias("rule"), F.col("d.body").alias("body")))
            if new.isEmpty():
                return out.df
            out.add(new)
            wants = cut(wants.join(new.select(F.col("tuple").alias("want")), "want", "left_anti"))

    def proofs(self, rel: str, tuples: Sequence[str] | None = None) -> dict[str, Proof]:
        """Proof trees of tuples of a relation, given as text, or of all of it: only what these trees hold is collected."""
        found = self.derivations(rel)
        own = self.catalog.frame(rel).select(tuple_text(rel, self.catalog.kinds(rel)).alias("tuple")).distinct()
        if tuples is not None:
            own = own.where(F.col("tuple").isin(list(tuples)))
        asked = sorted(r["tuple"] for r in own.collect())
        spark, known, front = self.catalog.spark, {}, asked
        while front:
            if tuples is None and len(known) == 0:
                rows = found.collect()
            else:
                rows = found.join(F.broadcast(spark.createDataFrame([(t,) for t in front], "tuple string")), "tuple").collect()
            known |= {r["tuple"]: (r["rule"], list(r["body"])) for r in rows}
            front = [] if tuples is None else sorted({b for r in rows for b in r["body"]} - known.keys())

        trees: dict[str, Proof] = {}

        def tree(t: str) -> Proof:
            stack = [t]
            while stack:
                top = stack[-1]
                rule, body = known.get(top, (None, []))
                left = [b for b in body if b not in trees]
                if left:
                    stack += left
                else:
                    trees[top] = Proof(top, rule, [trees[b] for b in body])
                    stack.pop()
            return trees[t]

        return {t: tree(t) for t in asked}


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def evaluate(spark: SparkSession, program: Program, facts: Mapping[str, DataFrame] | None = None, allow_recursion: bool = False, max_rounds: int = 10_000) -> RunResult:
    """Derive everything the program says from the facts (DataFrames with the declared columns in order).

    Strata without recursion stay lazy plans for Catalyst to optimise as a
    whole. Recursive ones run semi-naively: each round joins only what the
    last one found, and a checkpoint cuts the lineage. Aggregates are strata of
    their own; a program in which one depends on itself is refused.
    """
    began = time.time()
    strata = stratify(program, allow_recursion)
    catalog = Catalog(spark, program.decls)
    for rule in program.rules:
        check_head(rule, catalog)
    for rel in facts or {}:
        if rel not in program.decls:
            raise DatalogError("load.unknownRel", f"{rel} is not declared")
        if rel not in program.inputs:
            raise DatalogError("load.notInput", f"{rel} is no input")
    inline: dict[str, list[tuple]] = {}
    for fact in program.facts:
        for value, (name, kind) in zip(fact.values, program.decls[fact.rel].columns, strict=True):
            if kind_of(value) != kind:
                raise DatalogError("compile.mixedColumn", f"{fact.rel}.{name} is a {kind}", fact.where)
        inline.setdefault(fact.rel, []).append(fact.values or (True,))
    given: dict[str, DataFrame] = {}
    for rel, decl in program.decls.items():
        parts = []
        if rel in (facts or {}):
            parts.append(facts_frame(facts[rel], decl))
        if rel in inline:
            parts.append(spark.createDataFrame(sorted(set(inline[rel])), schema_of(decl)))
        given[rel] = _union(parts).distinct() if parts else empty(spark, decl)
    catalog.given = given
    rounds = 0
    for stratum in strata:
        for agg in program.aggregates:
            if agg.result.name in stratum.relations:
                given[agg.result.name] = _union([given[agg.result.name], compile_aggregate(agg, catalog)])
        rules = [r for r in program.rules if r.head.rel in stratum.relations]
        if not stratum.recursive:
            for rel in stratum.relations:
                own = [compile_rule(r, catalog) for r in rules]
                has = rel in inline or rel in (facts or {}) or any(a.result.name == rel for a in program.aggregates)
                catalog.frames[rel] = _union([*([given[rel]] if has or not own else []), *own])
                if own:
                    catalog.frames[rel] = catalog.frames[rel].distinct()
            continue
        rounds += _fixpoint(catalog, stratum.relations, rules, given, max_rounds)
    outputs = {rel: catalog.frame(rel) for rel in program.outputs}
    return RunResult(program, catalog, outputs, {"rules": len(program.rules), "strata": len(strata), "rounds": rounds, "seconds": time.time() - began})


def _fixpoint(catalog: Catalog, rels: Sequence[str], rules: list, given: Mapping[str, DataFrame], max_rounds: int) -> int:
    """Semi-naive evaluation of a recursive stratum; the number of rounds. What is known is the union of what the rounds have found, not written anew by each."""
    own = set(rels)
    base = [r for r in rules if not any(a.rel in own for a in r.positive)]
    step = [r for r in rules if any(a.rel in own for a in r.positive)]
    delta: dict[str, DataFrame] = {}
    whole: dict[str, Growing] = {}
    for rel in rels:
        delta[rel] = cut(_union([given[rel], *(compile_rule(r, catalog) for r in base if r.head.rel == rel)]).distinct())
        catalog.frames[rel], whole[rel] = delta[rel], Growing(delta[rel])
    for n in range(1, max_rounds + 1):
        fresh: dict[str, list[DataFrame]] = {}
        for rule in step:
            for i, atom in enumerate(rule.positive):
                if atom.rel in delta:
                    fresh.setdefault(rule.head.rel, []).append(compile_rule(rule, catalog, {i: delta[atom.rel]}))
        found: dict[str, DataFrame] = {}
        for rel, parts in fresh.items():
            new = _union(parts).distinct()
            known = catalog.frames[rel]
            new = cut(new.join(known, new.columns, "left_anti"))
            if not new.isEmpty():
                found[rel] = new
        if not found:
            return n
        for rel, new in found.items():
            whole[rel].add(new)
            catalog.frames[rel] = whole[rel].df
        delta = found
    raise DatalogError("eval.roundLimit", f"no fixpoint after {max_rounds} rounds")


def run_string(spark: SparkSession, text: str, facts: Mapping[str, DataFrame] | None = None, allow_recursion: bool = False) -> RunResult:
    return evaluate(spark, parse(text), facts, allow_recursion)


def _rule_texts(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(path, text) of the rule files of a folder, which are as few and small as people write them."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.dl").text(folder)
    rows = files.select("_metadata.file_path", "value").collect() if Path(folder).is_dir() or "://" in folder else []
    return sorted((r[0].removeprefix("file://").removeprefix("file:"), r[1]) for r in rows)


def run_dirs(spark: SparkSession, rule_dirs: Sequence[str], fact_dirs: Sequence[str] = (), allow_recursion: bool = False) -> RunResult:
    """All ``*.dl`` files of the folders, in the order of the folders and by name within one, over the fact files of the others. Folders may be anywhere that Spark can read."""
    parts = [part for d in rule_dirs for part in _rule_texts(spark, str(d))]
    if not parts:
        raise DatalogError("runner.noRules", f"no rules in {', '.join(map(str, rule_dirs)) or 'no folder'}")
    program = merge(parts)
    loaded: dict[str, list[DataFrame]] = {}
    for d in fact_dirs:
        for rel, df in read_facts(spark, str(d), program).items():
            loaded.setdefault(rel, []).append(df)
    return evaluate(spark, program, {rel: _union(dfs) for rel, dfs in loaded.items()}, allow_recursion)
