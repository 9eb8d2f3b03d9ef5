"""Checks over extracted facts: input relations, tables of checks of source structure and of what a run has shown, and extraction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import CONTEXTS, COUNTS, RUNTIME, STATIC
from .checks import Check, Context, check_sql, counted, findings, tainted_symbols, violations
from .extraction import extract


def derived(facts: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The facts and what checks derive from them: counts, functions that tainted data enters, pairs that call each other."""
    out = dict(facts)
    for name, (source, columns) in COUNTS.items():
        if source in facts and name not in facts:
            out[name] = counted(facts[source], *columns)
    if {"TaintedArgumentToCall", "FunctionParam"} <= set(facts):
        out["TaintedSymbol"] = tainted_symbols(facts["TaintedArgumentToCall"], facts["FunctionParam"])
    if "CallEdgeRuntime" in facts:
        pairs = facts["CallEdgeRuntime"].select(F.col("fromFile").alias("file"), F.col("toFile").alias("other")).distinct()
        back = pairs.select(F.col("other").alias("file"), F.col("file").alias("other"))
        out["RuntimeMutual"] = pairs.join(back, ["file", "other"], "left_semi").select("file").distinct()
    return out


def static_violations(facts: Mapping[str, DataFrame], names: set[str] | None = None, exempt: DataFrame | None = None) -> DataFrame:
    """(rule, place, detail, number) of the checks of source structure, all or those named."""
    return violations(derived(facts), [c for c in STATIC if names is None or c.name in names], CONTEXTS, exempt)


def runtime_alerts(facts: Mapping[str, DataFrame], names: set[str] | None = None, exempt: DataFrame | None = None) -> DataFrame:
    """(rule, place, detail, number) of the checks of what a run has shown."""
    return violations(derived(facts), [c for c in RUNTIME if names is None or c.name in names], CONTEXTS, exempt)


def rule_names() -> list[str]:
    return sorted({c.name for c in (*STATIC, *RUNTIME)})


__all__ = ["CONTEXTS", "COUNTS", "RUNTIME", "STATIC", "Check", "Context", "check_sql", "derived", "extract", "findings", "rule_names", "runtime_alerts", "static_violations", "violations"]
