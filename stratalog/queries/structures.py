"""Usage, coverage, flows and rankings over the tables, and their DuckDB statements."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import graph as G
from ..operators import structure as T
from .common import SUPPLY_SQL, TREE_SQL, supply, table, tree

Query = Callable[[SparkSession, str], DataFrame]


def q_usage(s: SparkSession, d: str) -> DataFrame:
    """Event types as names, users as readers."""
    return T.usage_spread(table(s, d, "events"), "event_type", "user_id")


USAGE_SQL = """with p as (select event_type, user_id, count(*) as n from events group by all),
k as (select *, row_number() over (partition by event_type order by user_id) as k from p)
select event_type, cast(sum(n) as bigint) as reads, count(*) as readers, count(*) < 2 as low, string_agg(user_id::varchar, ',' order by user_id) filter (where k <= 3) as samples from k group by 1"""


def _sources(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parts as sources, suppliers as tests, deliveries as imports, brands' parts as re-exports."""
    p, u = table(s, d, "part"), table(s, d, "supplier")
    files = p.select(F.concat(F.lit("p"), "p_partkey").alias("file"), (F.col("p_partkey") % 997).cast("string").alias("stem"))
    tests = u.where("s_nationkey < 5").select(F.concat(F.lit("s"), "s_suppkey").alias("file"), F.col("s_suppkey").cast("string").alias("stem"))
    again = p.where("p_size < 10").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("p"), (F.col("p_partkey") + 1)).alias("dst"))
    return files, tests, supply(s, d), again


LINKS_SQL = f"""{SUPPLY_SQL}, src as (select 'p' || p_partkey as file, (p_partkey % 997)::varchar as stem from part),
t as (select 's' || s_suppkey as file, s_suppkey::varchar as stem from supplier where s_nationkey < 5),
again as (select 'p' || p_partkey as src, 'p' || (p_partkey + 1) as dst from part where p_size < 10),
direct as (select dst as file, src as test from supply where src in (select file from t)),
links as (select src.file, t.file as test from src join t using (stem) union select file, test from direct where file in (select file from src)
  union select dst, test from direct join again on again.src = direct.file where dst in (select file from src))"""


def q_links(s: SparkSession, d: str) -> DataFrame:
    return T.test_links(*_sources(s, d))


def q_coverage(s: SparkSession, d: str) -> DataFrame:
    return T.coverage(_sources(s, d)[0], q_links(s, d))


def q_flows(s: SparkSession, d: str) -> DataFrame:
    """From customers over nations and regions; regions and the world are sinks."""
    t = tree(s, d)
    entries = t.where("src like 'c%'").select(F.col("src").alias("node")).distinct()
    sinks = t.where("src like 'r%'").select(F.col("src").alias("node"), F.lit("region").alias("sink")).unionByName(t.where("dst = 'world'").select(F.col("dst").alias("node"), F.lit("root").alias("sink")).distinct())
    return T.flows(t, entries, sinks)


def q_truth(s: SparkSession, d: str) -> DataFrame:
    """Market segments as concepts, nations as files: those with a debtor write, the others read."""
    c = table(s, d, "customer").select(F.col("c_mktsegment").alias("concept"), F.col("c_nationkey").alias("file"), F.when(F.col("c_acctbal") < 0, "write").otherwise("read").alias("role"))
    return T.truth_points(c)


TRUTH_SQL = """with s as (select distinct c_mktsegment as concept, c_nationkey::varchar as file, case when c_acctbal < 0 then 'write' else 'read' end as role from customer)
select concept, coalesce(string_agg(file, ',' order by file) filter (where role = 'write'), '') as writers, coalesce(string_agg(file, ',' order by file) filter (where role = 'read'), '') as readers,
       count(*) filter (where role = 'write') = 1 as canonical from s group by 1"""


def q_extract(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), (F.col("p_size") * 3).cast("bigint").alias("loc"))
    return T.extract_candidates(p, supply(s, d))


EXTRACT_SQL = f"""with {SUPPLY_SQL}, i as (select dst as node, count(*) as n from supply group by 1)
select 'p' || p_partkey as node, cast(p_size * 3 as bigint) as loc, cast(p_size * 3 * 1000 + p_size * 3 * coalesce(n, 0) * 200 as bigint) as score_x1000
from part left join i on node = 'p' || p_partkey where p_size * 3 >= 50"""


def q_untested(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("file"), "p_brand", "p_size")
    return T.untested_ranking(p, supply(s, d), p.where("p_size % 3 = 0"), p.where("p_size > 40"))


UNTESTED_SQL = f"""with {SUPPLY_SQL}, i as (select dst as file, count(*) as n from supply group by 1),
u as (select 'p' || p_partkey as file, coalesce(n, 0) as n, p_size from part left join i on i.file = 'p' || p_partkey where p_size % 3 <> 0),
r as (select file, n as fan_in, cast(case when n >= 20 then 4 when n >= 5 then 2 when n >= 1 then 1 else 0 end + case when p_size > 40 then 5 else 0 end as bigint) as score from u)
select * from r where score > 0"""


def _paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.concat_ws("/", F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.concat(F.lit("f"), "p_partkey", F.lit(".ts"))).alias("file"))


def q_anchors(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([("f7.ts",), ("f11.ts",), ("brand-1*/f2*.ts",), ("7.ts",), ("*.ts",)], "anchor string")
    return T.anchor_matches(names, _paths(s, d))


ANCHORS_SQL = """with f as (select lower(replace(p_brand, '#', '-')) || '/f' || p_partkey || '.ts' as file from part)
select a as anchor, file from f, (values ('f7.ts'), ('f11.ts')) v(a) where ends_with(file, '/' || a)
union select 'brand-1*/f2*.ts', file from f where regexp_matches(file, '^brand-1[^/]*/f2[^/]*\\.ts$')"""


def q_stale(s: SparkSession, d: str) -> DataFrame:
    """Event properties that name an unknown nation's number."""
    lines = table(s, d, "orders").select(F.concat(F.lit("see nation #"), (F.col("o_custkey") % 40), F.lit(", and #"), (F.col("o_orderkey") % 30)).alias("text"))
    known = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"))
    return T.stale_mentions(lines, known, "#([0-9]+)")


STALE_SQL = """with m as (select (o_custkey % 40)::varchar as name from orders union all select (o_orderkey % 30)::varchar from orders)
select name, count(*) as mentions from m where name not in (select n_nationkey::varchar from nation) group by 1"""


def q_deprecated(s: SparkSession, d: str) -> DataFrame:
    calls = table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("name"))
    return T.deprecated_calls(table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("name")), calls)


def q_ranked(s: SparkSession, d: str) -> DataFrame:
    return T.ranked_counts(table(s, d, "part"), ["p_brand"], 10)


def q_tensions(s: SparkSession, d: str) -> DataFrame:
    p, c = table(s, d, "part"), table(s, d, "customer")
    return T.tensions({"large": p.where("p_size > 45").select(F.col("p_partkey").alias("node")), "debtor": c.where("c_acctbal < 0").select(F.col("c_custkey").alias("node"))}, {"large": 7, "debtor": 5})


TENSIONS_SQL = """select * from (select 'large' as kind, p_partkey::varchar as node from part where p_size > 45 order by node limit 7)
union all select * from (select 'debtor', c_custkey::varchar as node from customer where c_acctbal < 0 order by node limit 5)"""


def q_suggestions(s: SparkSession, d: str) -> DataFrame:
    p, u = table(s, d, "part"), G.degrees(supply(s, d))
    return T.suggestions({"size": (p.select(F.col("p_partkey").alias("node"), "p_size"), "p_size"), "fan_in": (u, "fan_in")}, 10)


SUGGESTIONS_SQL = f"""with {SUPPLY_SQL}, i as (select dst as node, count(*) as n from supply group by 1)
select * from (select 'size' as kind, p_partkey::varchar as node, cast(p_size as bigint) as score from part order by score desc, node limit 10)
union all select * from (select 'fan_in', node, n from i order by n desc, node limit 10)"""


def q_repeats(s: SparkSession, d: str) -> DataFrame:
    uses = table(s, d, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("node"))
    return T.repeat_reads(uses, table(s, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node")))


def q_summary(s: SparkSession, d: str) -> DataFrame:
    return T.structural_summary({name: table(s, d, name) for name in ("nation", "part", "orders")})


def _sides(s: SparkSession, d: str) -> tuple[dict, dict]:
    o, n, p = table(s, d, "orders"), table(s, d, "nation"), table(s, d, "part")
    late = F.col("o_orderdate") >= F.lit("1997-01-01")
    pair = lambda df: df.select(F.col("o_orderpriority").alias("concept"), (F.col("o_custkey") % 50).cast("string").alias("state")).distinct()

    def side(after: bool) -> dict:
        own = o.where(late if after else ~late)
        return {
            "cycles": n.select(F.col("n_name").alias("id"), (F.col("n_nationkey") % (2 if after else 3) == 0).alias("gated")),
            "dead": pair(own.where("o_totalprice > 400000")),
            "orphan": pair(own.where("o_orderstatus = 'P'")),
            "canonical": n.select(F.col("n_name").alias("concept"), (F.col("n_regionkey") != (2 if after else 9)).alias("canonical")),
            "signatures": p.where("p_size > 10" if after else "true").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name")),
        }

    return side(False), side(True)


def q_checks(s: SparkSession, d: str) -> DataFrame:
    return T.structural_checks(*_sides(s, d))


CHECKS_SQL = """with a as (select * from orders where o_orderdate >= '1997-01-01'), b as (select * from orders where not (o_orderdate >= '1997-01-01')),
k(t, p, c) as (select 'ad', o_orderpriority, (o_custkey % 50)::varchar from a where o_totalprice > 400000 union select 'bd', o_orderpriority, (o_custkey % 50)::varchar from b where o_totalprice > 400000
  union select 'ao', o_orderpriority, (o_custkey % 50)::varchar from a where o_orderstatus = 'P' union select 'bo', o_orderpriority, (o_custkey % 50)::varchar from b where o_orderstatus = 'P')
select 'new-cycle' as "check", n_name as subject from nation where n_nationkey % 2 <> 0 and n_nationkey % 3 = 0
union all select 'new-dead-state', p || '.' || c from k where t = 'ad' and (p, c) not in (select (p, c) from k where t = 'bd')
union all select 'new-orphan-state', p || '.' || c from k where t = 'ao' and (p, c) not in (select (p, c) from k where t = 'bo')
union all select 'lost-canonical', n_name from nation where n_regionkey = 2
union all select 'signature-coverage', 'all' from (select count(*)::double / count(distinct p_brand) as b, (select count(*)::double / count(distinct p_brand) from part where p_size > 10) as a from part) where (b - a) / b >= 0.1"""


def q_codes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    kind = F.element_at(F.array(F.lit("function"), F.lit("method"), F.lit("arrow"), F.lit("other")), (F.col("p_partkey") % 4 + 1).cast("int"))
    returns = F.element_at(F.array(F.lit("void"), F.lit("Promise<x>"), F.lit("number"), F.lit("string[]"), F.lit("Foo")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", T.signature_code((F.col("p_size") % 20).cast("int"), kind, returns, (F.col("p_size") * 7).cast("int")).alias("code"))


CODES_SQL = """select p_partkey, cast((least(p_size % 20, 15) << 8) | ((p_partkey % 4) << 6) | ([1, 2, 4, 6, 7][(p_partkey % 5 + 1)::int] << 3) | least(floor(log2(p_size * 7)), 7)::bigint as bigint) as code from part"""


def q_squares(s: SparkSession, d: str) -> DataFrame:
    """Line price by quantity, in whole thousandths."""
    fit = T.least_squares(table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return s.createDataFrame([(math.floor(fit["l_quantity"] * 10 + 0.5),)], "slope_x10 bigint")


def q_recall(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").where("p_size < 20")
    entries = p.select(
        T.memory_id(F.col("p_brand"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("kind"), F.col("p_partkey").cast("string").alias("fingerprint"),
        F.lit("r").alias("reason"), F.lit("s").alias("scope"), F.lit(1).alias("added"), F.when(F.col("p_size") == 7, 5).alias("obsolete"),
    )
    gone = entries.where("cast(fingerprint as int) % 2 = 0").select("id")
    return T.recall(T.mark_obsolete(entries, gone, F.lit(9)), kind="Brand#11").select("id", "fingerprint")


def q_detail(s: SparkSession, d: str) -> DataFrame:
    from .analytics import _pairs

    e = table(s, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    pairs = _pairs(s, d).select(F.concat(F.lit("p"), "a").alias("a"), F.concat(F.lit("p"), "b").alias("b"), "jaccard_x100")
    nodes = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_brand").alias("status"))
    return T.node_detail("p7", nodes, e, pairs)


def _detail_sql() -> str:
    from .analytics import PAIRS

    return f"""with {PAIRS}
select 'status' as section, p_brand as other, 0::bigint as value from part where p_partkey = 7
union all select 'in', 's' || l_suppkey, count(*) from lineitem where l_partkey = 7 group by 2
union all select * from (select 'cochange', 'p' || (case when a = 7 then b else a end) as other, jaccard_x100 from p where a = 7 or b = 7 order by jaccard_x100 desc, other limit 20)"""


def q_chains(s: SparkSession, d: str) -> DataFrame:
    """Suppliers emit the brands they deliver; the regions' first suppliers listen."""
    n = table(s, d, "nation")
    emits = n.select(F.col("n_name").alias("file"), F.concat(F.lit("e"), "n_regionkey").alias("event"))
    listens = n.where("n_nationkey % 4 = 0").select(F.concat(F.lit("e"), (F.col("n_regionkey") + 1) % 5).alias("event"), F.col("n_name").alias("file"))
    return G.event_chains(emits, listens)


CHAINS_SQL = """with e as (select n_name as file, 'e' || n_regionkey as event from nation), l as (select 'e' || ((n_regionkey + 1) % 5) as event, n_name as "to" from nation where n_nationkey % 4 = 0),
step as (select file, min((event, "to")) as s from e join l using (event) where file <> "to" group by 1),
one as (select file as start, struct_extract(s, 2) as place, [struct_extract(s, 1)] as events from step),
two as (select start, coalesce(struct_extract(s, 2), place) as place, case when s is not null and not list_contains(events, struct_extract(s, 1)) then list_append(events, struct_extract(s, 1)) else events end as events from one left join step on place = file),
three as (select start, case when s is not null and not list_contains(events, struct_extract(s, 1)) then list_append(events, struct_extract(s, 1)) else events end as events from two left join step on place = file)
select distinct array_to_string(events, '>') as events, cast(len(events) as int) as length from three"""


def q_signatures(s: SparkSession, d: str) -> DataFrame:
    """Parts' signatures before and after: large ones lose a parameter, others change."""
    p = table(s, d, "part").select("p_partkey", "p_size", F.col("p_brand").alias("t"))
    param = lambda name, kind, optional: F.struct(F.lit(name).alias("name"), kind.alias("type"), optional.alias("optional"))
    two = lambda t, o: F.array(param("a", t, F.lit(False)), param("b", F.lit("x"), o))
    old = p.select("p_partkey", two(F.col("t"), F.lit(True)).alias("params"), F.lit("void").alias("returns"))
    new = p.select(
        "p_partkey",
        F.when(F.col("p_size") > 45, F.array(param("a", F.col("t"), F.lit(False)))).otherwise(two(F.when(F.col("p_size") < 5, F.lit("y")).otherwise(F.col("t")), F.col("p_size") != 20)).alias("params"),
        F.when(F.col("p_size") == 30, "int").otherwise("void").alias("returns"),
    )
    return D.signature_changes(old, new, "p_partkey")


SIGNATURES_SQL = """select p_partkey, 'param removed' as reason from part where p_size > 45 union all select p_partkey, 'type changed' from part where p_size < 5
union all select p_partkey, 'became required' from part where p_size = 20 union all select p_partkey, 'return changed' from part where p_size = 30"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "usage_spread": (q_usage, USAGE_SQL),
    "test_links": (q_links, f"with {LINKS_SQL} select file, test from links"),
    "test_coverage": (q_coverage, f"with {LINKS_SQL}, n as (select count(*) as files, (select count(distinct file) from links) as tested from src) select files, tested, cast(floor(tested * 1000 / files + 0.5) as bigint) as covered_x1000 from n"),
    "bounded_flows": (q_flows, f"with {TREE_SQL} select 'r' || r_regionkey as node, 'region' as sink, 2 as depth from region where r_regionkey in (select n_regionkey from nation join customer on c_nationkey = n_nationkey) union all select 'world', 'root', 3"),
    "truth_points": (q_truth, TRUTH_SQL),
    "extract_candidates": (q_extract, EXTRACT_SQL),
    "untested_ranking": (q_untested, UNTESTED_SQL),
    "anchor_matches": (q_anchors, ANCHORS_SQL),
    "stale_mentions": (q_stale, STALE_SQL),
    "deprecated_calls": (q_deprecated, "select l_suppkey as src, l_partkey as name, count(*) as count from lineitem where l_partkey in (select p_partkey from part where p_size = 1) group by all"),
    "ranked_counts": (q_ranked, "select p_brand, count(*) as count from part group by 1 order by count desc, p_brand limit 10"),
    "tensions": (q_tensions, TENSIONS_SQL),
    "suggestions": (q_suggestions, SUGGESTIONS_SQL),
    "repeat_reads": (q_repeats, "select l_suppkey as session, l_partkey as node, count(*) as reads from lineitem where l_partkey in (select p_partkey from part where p_size <= 25) group by all having count(*) >= 3"),
    "structural_summary": (q_summary, "select 'nation' as metric, count(*) as value from nation union all select 'part', count(*) from part union all select 'orders', count(*) from orders"),
    "structural_checks": (q_checks, CHECKS_SQL),
    "signature_codes": (q_codes, CODES_SQL),
    "signature_changes": (q_signatures, SIGNATURES_SQL),
    "least_squares": (q_squares, "select cast(floor(regr_slope(l_extendedprice, l_quantity) * 10 + 0.5) as bigint) as slope_x10 from lineitem"),
    "memory_recall": (q_recall, "select left(sha1(p_brand || ':' || p_partkey), 12) as id, p_partkey::varchar as fingerprint from part where p_size < 20 and p_size <> 7 and p_partkey % 2 = 1 and p_brand = 'Brand#11'"),
    "node_detail": (q_detail, _detail_sql()),
    "event_chains": (q_chains, CHAINS_SQL),
    "input_hash": (
        lambda s, d: T.input_hash(table(s, d, "nation"), "n_regionkey", "n_nationkey", "n_name"),
        "select n_regionkey, sha256(string_agg(id, chr(10) order by id)) as hash from (select n_regionkey, sha256(n_nationkey || chr(0) || n_name) as id from nation) group by 1",
    ),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
