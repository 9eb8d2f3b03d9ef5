"""Checks as tables: rows of one relation that meet conditions, in contexts that other relations give.

A check names a relation, a condition on its columns, and contexts that a row
has to lie in (``needs``) or must not lie in (``lacks``). A context is itself a
relation with a condition, matched by columns. So a check is a filter, some
semi-joins and some anti-joins, whatever it is about; exemptions are one
anti-join for all checks together.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Facts = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Context:
    relation: str
    columns: tuple[str, ...] = ()  #: matched one by one with the row's; none: the relation has a row at all
    where: str = "true"


@dataclass(frozen=True)
class Check:
    name: str
    relation: str
    where: str = "true"
    needs: tuple[str, ...] = ()  #: names of contexts, after a colon the row's own columns that they match (``file`` if none are named)
    lacks: tuple[str, ...] = ()
    place: str = ""  #: SQL of what is reported first, by default the column ``file`` or else the first
    detail: str = ""  #: SQL of what is reported beside it
    number: str = ""  #: SQL of the number reported, by default ``line`` or else 0


def _columns(check: Check, names: list[str]) -> tuple[Column, Column, Column]:
    place = check.place or ("file" if "file" in names else names[0])
    number = check.number or ("line" if "line" in names else "0")
    return F.expr(place).cast("string"), F.expr(check.detail or "''").cast("string"), F.expr(number).cast("bigint")


def in_context(rows: DataFrame, facts: Facts, contexts: Mapping[str, Context], use: str, wanted: bool) -> DataFrame:
    """The rows that lie in the context, or those that do not."""
    name, _, columns = use.partition(":")
    context = contexts[name]
    own = columns.split(",") if columns else ["file"]
    held = facts[context.relation].where(context.where)
    if not context.columns:
        some = held.limit(1).select(F.lit(1).alias("_some")).hint("broadcast")  # one row at most
        return rows.join(some, F.lit(True), "left_semi" if wanted else "left_anti")
    held = held.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(context.columns))).distinct()
    match = F.lit(True)
    for i, c in enumerate(own[: len(context.columns)]):
        match &= F.col(c) == F.col(f"_k{i}")
    return rows.join(held, match, "left_semi" if wanted else "left_anti")


def findings(facts: Facts, check: Check, contexts: Mapping[str, Context]) -> DataFrame:
    """The rows of the check's relation that meet it, with their own columns."""
    rows = facts[check.relation].where(check.where)
    for use in check.needs:
        rows = in_context(rows, facts, contexts, use, True)
    for use in check.lacks:
        rows = in_context(rows, facts, contexts, use, False)
    return rows


def violations(facts: Facts, checks: Iterable[Check], contexts: Mapping[str, Context], exempt: DataFrame | None = None) -> DataFrame:
    """(rule, place, detail, number) of all checks whose relations are among the facts, each once.

    ``exempt`` holds (rule, place, detail); an empty or null detail exempts a
    place as a whole. Checks over relations that are not given are passed over.
    """
    out = None
    for check in checks:
        if any(r not in facts for r in reads(check, contexts)):
            continue
        rows = findings(facts, check, contexts)
        place, detail, number = _columns(check, rows.columns)
        rows = rows.select(F.lit(check.name).alias("rule"), place.alias("place"), detail.alias("detail"), number.alias("number"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no check has all its relations")
    if exempt is not None:
        e = exempt.select(F.col("rule").alias("_r"), F.col("place").alias("_p"), F.coalesce("detail", F.lit("")).alias("_d")).distinct()
        same = (F.col("rule") == F.col("_r")) & (F.col("place") == F.col("_p"))
        out = out.join(e.where("_d = ''"), same, "left_anti").join(e.where("_d != ''"), same & (F.col("detail") == F.col("_d")), "left_anti")
    return out.distinct()


def reads(check: Check, contexts: Mapping[str, Context]) -> set[str]:
    """The relations that a check reads."""
    return {check.relation, *(contexts[use.partition(":")[0]].relation for use in (*check.needs, *check.lacks))}


def check_sql(check: Check, contexts: Mapping[str, Context], columns: list[str]) -> str:
    """The check as one SQL query over tables with the relations' names; ``columns`` are those of its relation."""
    quoted = lambda text: text.replace("`", '"')
    parts = [f"({check.where})"]
    for use, wanted in (*((u, "") for u in check.needs), *((u, "not ") for u in check.lacks)):
        name, _, own = use.partition(":")
        context = contexts[name]
        match = "".join(f' and o."{c}" = t."{x}"' for c, x in zip(context.columns, own.split(",") if own else ["file"], strict=False))
        parts.append(f'{wanted}exists (select 1 from (select * from "{context.relation}" where {context.where}) o where true{match})')
    place = check.place or ("file" if "file" in columns else f'"{columns[0]}"')
    number = check.number or ("line" if "line" in columns else "0")
    return (
        f"select distinct '{check.name}' as rule, cast({quoted(place)} as varchar) as place, cast({quoted(check.detail) or chr(39) * 2} as varchar) as detail, "
        f'cast({number} as bigint) as number from "{check.relation}" t where {" and ".join(parts)}'
    )


# --- relations that checks derive first -------------------------------------------------------


def counted(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows for each value of the columns."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def tainted_symbols(arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """(symbol): functions that tainted data can enter: by an argument that is tainted, or handed on by such a function to another's parameter.

    arguments: (callerSymbol, callee, paramIndex), parameters: (symbol, paramIndex).
    """
    from ..operators.graph import reach

    entered = arguments.join(parameters.select(F.col("symbol").alias("callee"), "paramIndex").distinct(), ["callee", "paramIndex"])
    seeds = entered.select(F.col("callee").alias("node")).distinct()
    onward = entered.select(F.col("callerSymbol").alias("src"), F.col("callee").alias("dst")).distinct()
    return reach(onward, seeds).select(F.col("node").alias("symbol")).distinct()
