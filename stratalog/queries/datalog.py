"""Rule programs over the tables, one for each construct of the language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans import run_string
from .common import RING_SQL, TREE_SQL, ring, table, tree

DECLS = {
    "Orders": (".decl Orders(o: number, c: number, status: symbol, cents: number) .input Orders", "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "cast(round(o_totalprice * 100) as bigint)"]),
    "Line": (".decl Line(o: number, p: number, s: number, qty: number, flag: symbol) .input Line", "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "cast(l_quantity as bigint)", "l_returnflag"]),
    "Customer": (".decl Customer(c: number, n: number, seg: symbol) .input Customer", "customer", ["c_custkey", "c_nationkey", "c_mktsegment"]),
    "Supplier": (".decl Supplier(s: number, n: number) .input Supplier", "supplier", ["s_suppkey", "s_nationkey"]),
    "Nation": (".decl Nation(n: number, name: symbol, r: number) .input Nation", "nation", ["n_nationkey", "n_name", "n_regionkey"]),
    "Region": (".decl Region(r: number, name: symbol) .input Region", "region", ["r_regionkey", "r_name"]),
    "Part": (".decl Part(p: number, brand: symbol, type: symbol, size: number) .input Part", "part", ["p_partkey", "p_brand", "p_type", "p_size"]),
    "Event": (".decl Event(e: number, u: number, kind: symbol) .input Event", "events", ["event_id", "user_id", "event_type"]),
}


@dataclass(frozen=True)
class Case:
    """A program whose relation ``Out`` is the result."""

    program: str
    sql: str
    tables: tuple[str, ...] = ()
    graphs: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    recursive: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        text = "\n".join(DECLS[t][0] for t in self.tables) + "\n" + self.program
        facts = {t: table(spark, sf_dir, DECLS[t][1]).selectExpr(*DECLS[t][2]) for t in self.tables}
        facts |= {name: make(spark, sf_dir) for name, make in self.graphs.items()}
        return run_string(spark, text, facts, allow_recursion=self.recursive).named("Out")


EDGE = ".decl Edge(a: number, b: number) .input Edge\n"
UP = ".decl Up(a: symbol, b: symbol) .input Up\n"

CASES = {
    "dl_join": Case(
        ".decl Out(o: number, name: symbol) .output Out\nOut(O, N) :- Orders(O, C, _, _), Customer(C, K, _), Nation(K, N, _).",
        "select distinct o_orderkey as o, n_name as name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
        ("Orders", "Customer", "Nation"),
    ),
    "dl_const_filter": Case(
        '.decl Out(o: number, tag: symbol) .output Out\nOut(O, "open") :- Orders(O, _, "O", _).',
        "select distinct o_orderkey as o, 'open' as tag from orders where o_orderstatus = 'O'",
        ("Orders",),
    ),
    "dl_self_eq": Case(
        ".decl Pair(a: number, b: number)\n.decl Out(a: number) .output Out\nPair(N, R) :- Nation(N, _, R).\nOut(X) :- Pair(X, X).",
        "select distinct cast(n_nationkey as bigint) as a from nation where n_nationkey = n_regionkey",
        ("Nation",),
    ),
    "dl_wildcard_project": Case(
        ".decl Out(brand: symbol) .output Out\nOut(B) :- Part(_, B, _, _).", "select distinct p_brand as brand from part", ("Part",)
    ),
    "dl_neg": Case(
        ".decl Buys(c: number)\n.decl Out(c: number) .output Out\nBuys(C) :- Orders(_, C, \"P\", _).\nOut(C) :- Customer(C, _, _), !Buys(C).",
        "select c_custkey as c from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
        ("Orders", "Customer"),
    ),
    "dl_neg_wildcard": Case(
        '.decl Out(o: number) .output Out\nOut(O) :- Orders(O, _, _, _), not Line(O, _, _, _, "R").',
        "select o_orderkey as o from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
        ("Orders", "Line"),
    ),
    "dl_union_heads": Case(
        ".decl Out(n: number) .output Out\nOut(N) :- Customer(_, N, \"BUILDING\").\nOut(N) :- Supplier(_, N).",
        "select cast(c_nationkey as bigint) as n from customer where c_mktsegment = 'BUILDING' union select s_nationkey from supplier",
        ("Customer", "Supplier"),
    ),
    "dl_intersection": Case(
        '.decl Out(p: number) .output Out\nOut(P) :- Line(_, P, _, _, "R"), Line(_, P, _, _, "A"), Line(_, P, _, _, "N").',
        "select l_partkey as p from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'N'",
        ("Line",),
    ),
    "dl_constraint_gt": Case(
        ".decl Out(p: number, size: number) .output Out\nOut(P, S) :- Part(P, _, _, S), S > 30, S <= 45.",
        "select p_partkey as p, cast(p_size as bigint) as size from part where p_size > 30 and p_size <= 45",
        ("Part",),
    ),
    "dl_neq": Case(
        ".decl Out(p: number, s1: number, s2: number) .output Out\nOut(P, A, B) :- Line(_, P, A, 50, _), Line(_, P, B, 50, _), A != B.",
        "select distinct a.l_partkey as p, a.l_suppkey as s1, b.l_suppkey as s2 from lineitem a join lineitem b on a.l_partkey = b.l_partkey where a.l_quantity = 50 and b.l_quantity = 50 and a.l_suppkey != b.l_suppkey",
        ("Line",),
    ),
    "dl_theta": Case(
        ".decl Out(o: number, p: number) .output Out\nOut(O, P) :- Line(O, P, _, Q, _), Part(P, _, _, S), Q > S, Q >= 48.",
        "select distinct l_orderkey as o, l_partkey as p from lineitem join part on l_partkey = p_partkey where l_quantity > p_size and l_quantity >= 48",
        ("Line", "Part"),
    ),
    "dl_typed_inequality": Case(
        ".decl Out(n: number, name: symbol) .output Out\nOut(N, M) :- Nation(N, M, _), N != M.",
        "select cast(n_nationkey as bigint) as n, n_name as name from nation",
        ("Nation",),
    ),
    "dl_cross_guard": Case(
        '.decl AnyReturn()\n.decl Out(r: number) .output Out\nAnyReturn() :- Line(_, _, _, _, "R").\nOut(R) :- Region(R, _), AnyReturn().',
        "select cast(r_regionkey as bigint) as r from region where exists (select 1 from lineitem where l_returnflag = 'R')",
        ("Line", "Region"),
    ),
    "dl_cross_product": Case(
        ".decl Out(r: number, n: number) .output Out\nOut(R, N) :- Region(R, _), Nation(N, _, _).",
        "select cast(r_regionkey as bigint) as r, cast(n_nationkey as bigint) as n from region cross join nation",
        ("Region", "Nation"),
    ),
    "dl_self_join": Case(
        ".decl Out(a: number, b: number) .output Out\nOut(A, B) :- Nation(A, _, R), Nation(B, _, R), A < B.",
        "select cast(a.n_nationkey as bigint) as a, cast(b.n_nationkey as bigint) as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
        ("Nation",),
    ),
    "dl_semi_join": Case(
        ".decl Out(p: number, brand: symbol) .output Out\nOut(P, B) :- Part(P, B, _, _), Line(_, P, _, 1, _).",
        "select p_partkey as p, p_brand as brand from part where p_partkey in (select l_partkey from lineitem where l_quantity = 1)",
        ("Part", "Line"),
    ),
    "dl_inline_facts": Case(
        '.decl Watch(status: symbol, level: number)\nWatch("O", 1). Watch("P", 2). Watch("P", 2).\n.decl Out(o: number, level: number) .output Out\nOut(O, L) :- Orders(O, _, S, _), Watch(S, L).',
        "select o_orderkey as o, cast(case o_orderstatus when 'O' then 1 else 2 end as bigint) as level from orders where o_orderstatus in ('O', 'P')",
        ("Orders",),
    ),
    "dl_ratchet": Case(
        '.decl Known(name: symbol)\nKnown("NATION_3"). Known("NATION_7").\n.decl Out(adr: symbol, name: symbol, msg: symbol) .output Out\nOut("ADR-1", N, "nation in region 3 or 2") :- Nation(_, N, R), R >= 2, R != 4, !Known(N).',
        "select 'ADR-1' as adr, n_name as name, 'nation in region 3 or 2' as msg from nation where n_regionkey in (2, 3) and n_name not in ('NATION_3', 'NATION_7')",
        ("Nation",),
    ),
    "dl_count": Case(
        ".count Out(c: number, n: number) by Orders(_, C, _, _)\n.output Out",
        "select o_custkey as c, count(*) as n from (select distinct o_custkey, o_orderstatus, round(o_totalprice * 100), o_orderkey from orders) group by 1",
        ("Orders",),
    ),
    "dl_sum": Case(
        ".sum Out(p: number, qty: number) by Line(_, P, _, Q, _)\n.output Out",
        "select l_partkey as p, cast(sum(q) as bigint) as qty from (select distinct l_orderkey, l_partkey, l_suppkey, cast(l_quantity as bigint) as q, l_returnflag from lineitem) group by 1",
        ("Line",),
    ),
    "dl_min": Case(
        '.min Out(brand: symbol, size: number) by Part(_, B, _, S)\n.output Out', "select p_brand as brand, cast(min(p_size) as bigint) as size from part group by 1", ("Part",)
    ),
    "dl_max": Case(
        '.max Out(brand: symbol, type: symbol, size: number) by Part(_, B, T, S)\n.output Out',
        "select p_brand as brand, p_type as type, cast(max(p_size) as bigint) as size from part group by 1, 2",
        ("Part",),
    ),
    "dl_count_const": Case(
        '.count Out(c: number, n: number) by Orders(_, C, "F", _)\n.output Out', "select o_custkey as c, count(*) as n from orders where o_orderstatus = 'F' group by 1", ("Orders",)
    ),
    "dl_count_zero_key": Case(".count Out(n: number) by Event(_, _, _)\n.output Out", "select count(*) as n from events", ("Event",)),
    "dl_count_zero_key_empty": Case(
        '.count Out(n: number) by Event(_, _, "no such kind")\n.output Out', "select count(*) as n from events where event_type = 'no such kind' having count(*) > 0", ("Event",)
    ),
    "dl_agg_threshold": Case(
        ".count PerCustomer(c: number, n: number) by Orders(_, C, _, _)\n.decl Out(c: number, n: number) .output Out\nOut(C, N) :- PerCustomer(C, N), N > 12.",
        "select o_custkey as c, count(*) as n from orders group by 1 having count(*) > 12",
        ("Orders",),
    ),
    "dl_closure_acyclic": Case(
        UP + ".decl Out(a: symbol, b: symbol) .output Out\nOut(A, B) :- Up(A, B).\nOut(A, C) :- Out(A, B), Up(B, C).",
        f"with recursive {TREE_SQL}, o as (select src as a, dst as b from tree union select a, dst from o join tree on b = src) select a, b from o",
        graphs={"Up": tree},
        recursive=True,
    ),
    "dl_closure_cyclic": Case(
        EDGE + ".decl Out(a: number, b: number) .output Out\nOut(A, B) :- Edge(A, B).\nOut(A, C) :- Out(A, B), Edge(B, C).",
        f"with recursive {RING_SQL}, o as (select src as a, dst as b from ring union select a, dst from o join ring on b = src) select a, b from o",
        graphs={"Edge": ring},
        recursive=True,
    ),
    "dl_closure_nonlinear": Case(
        EDGE + ".decl Out(a: number, b: number) .output Out\nOut(A, B) :- Edge(A, B).\nOut(A, C) :- Out(A, B), Out(B, C).",
        f"with recursive {RING_SQL}, o as (select src as a, dst as b from ring union select a, dst from o join ring on b = src) select a, b from o",
        graphs={"Edge": ring},
        recursive=True,
    ),
    "dl_mutual_recursion": Case(
        EDGE + ".decl Odd(a: number, b: number)\n.decl Out(a: number, b: number) .output Out\nOdd(A, B) :- Edge(A, B).\nOut(A, C) :- Odd(A, B), Edge(B, C).\nOdd(A, C) :- Out(A, B), Edge(B, C).",
        f"with recursive {RING_SQL}, w as (select src as a, dst as b, 1 as odd from ring union select a, dst, 1 - odd from w join ring on b = src) select distinct a, b from w where odd = 0",
        graphs={"Edge": ring},
        recursive=True,
    ),
    "dl_closure_plus_neg": Case(
        UP + ".decl Above(a: symbol, b: symbol)\n.decl Out(a: symbol, b: symbol) .output Out\nAbove(A, B) :- Up(A, B).\nAbove(A, C) :- Above(A, B), Up(B, C).\nOut(A, B) :- Above(A, B), !Up(A, B).",
        f"with recursive {TREE_SQL}, o as (select src as a, dst as b from tree union select a, dst from o join tree on b = src) select a, b from o except select src, dst from tree",
        graphs={"Up": tree},
        recursive=True,
    ),
    "dl_open_unreturned": Case(
        '.decl Returned(o: number)\n.decl Out(o: number, cents: number) .output Out\nReturned(O) :- Line(O, _, _, _, "R").\nOut(O, P) :- Orders(O, _, "O", P), P > 10000000, !Returned(O).',
        "select o_orderkey as o, cast(round(o_totalprice * 100) as bigint) as cents from orders where o_orderstatus = 'O' and round(o_totalprice * 100) > 10000000 and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
        ("Orders", "Line"),
    ),
}


def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First derivations of the reachable pairs of the ring, as text."""
    text = EDGE + ".decl Out(a: number, b: number) .output Out\nOut(A, B) :- Edge(A, B).\nOut(A, C) :- Out(A, B), Edge(B, C)."
    proofs = run_string(spark, text, {"Edge": ring(spark, sf_dir)}, allow_recursion=True).proofs("Out")
    return spark.createDataFrame([(t, p.rule, p.text()) for t, p in proofs.items()], "tuple string, rule int, proof string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: case.run for name, case in CASES.items()} | {"dl_proofs": _proofs}


def oracle_sql() -> dict[str, str]:
    return {name: case.sql for name, case in CASES.items()}
