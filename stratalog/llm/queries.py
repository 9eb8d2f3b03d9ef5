"""The queries of this package and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination_report
from .licenses import COMMON, HINTS, TAG, TEMPLATES, scan_licences
from .packing import pack_documents
from .pii import pseudonymise
from .quality_classifier import quality_scores
from .quality_rules import quality_verdicts
from .sharding import assign_shards
from .simhash import near_duplicate_classes
from .url_filters import url_verdicts
from .warc import archive_and_index

#: (host, path, verdict)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Stands in for the secret that whoever runs the operator keeps.
PSEUDONYM_KEY = b"demonstration key, not a secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)[0]


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a tree with a directory for each language and up to two more below; texts of up to 1,000 characters are its licence files."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    folders = F.array(
        F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.lit("a"), number % 3), F.concat(F.lit("b"), number % 5)
    )
    name = F.when(F.length(F.coalesce("text", F.lit(""))) <= 1000, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    path = F.concat_ws("/", F.array_join(F.slice(folders, F.lit(1), (F.lit(2) + F.floor(number / 7) % 3).cast("int")), "/"), name)
    return scan_licences(table(spark, sf_dir, "documents"), path)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), metadata=("n_chars",))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3_quality_rules: its counts and base test."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10_sharding: nothing is lost, sizes add up, and the slots of each shard run from 0 without a gap."""
    shards = op10_sharding(spark, sf_dir).groupBy("shard").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), ((F.min("slot") == 0) & (F.max("slot") == F.count("*") - 1) & (F.count_distinct("slot") == F.count("*"))).alias("gapless"),
        F.count(F.when((F.col("grown_shard") != F.col("shard")) & (F.col("grown_shard") != 24), 1)).alias("strays"),
    )
    return shards.agg(F.sum("n").alias("docs"), F.sum("size").alias("size"), F.bool_and("gapless").alias("gapless"), F.sum("strays").alias("strays"), F.bool_and(F.col("shard").between(0, 23)).alias("within"))


_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

OP2_SQL = """
with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as payload_bytes from pages),
d as (select page_id, payload_bytes, sha1(body) as payload_digest from p),
f as (select payload_digest, max(page_id) as head from d where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, d.payload_digest, case when page_id < head then 'revisit' else 'response' end as record_type,
       case when page_id < head then head end as refers_to
from d left join f on d.payload_digest = f.payload_digest
"""

OP4_SQL = f"""
with rules(rh, rp, rv) as (values {_RULE_ROWS}),
cut as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
best as (
  select host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as verdict
  from (select distinct host, path from cut) join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  group by host, path)
select page_id, cut.host, cut.path, rule, coalesce(verdict, 'allow') as verdict
from cut left join best on cut.host = best.host and cut.path = best.path
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
with d as (select doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWERED}, '{_ALNUM}') as w from benchmark),
bw as (
  select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
m as (select doc_id, dw.n, i, item from dw join bw on dw.n = bw.n and dw.win = bw.win),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from m group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits on d.doc_id = hits.doc_id left join items on d.doc_id = items.doc_id
"""

_TEXTS = ", ".join("({}, '{}', {}, '{}')".format(i, licence, kind == "title", text.replace("'", "''")) for i, (licence, kind, text) in enumerate(TEMPLATES))
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HINTED = " or ".join(f"contains(lower(body), '{h}')" for h in HINTS)

OP7_SQL = f"""
with templates(template, licence, title, wording) as (values {_TEXTS}),
tw as (select template, generate_subscripts(w, 1) - 1 as place, unnest(w) as term from (select template, regexp_extract_all({_LOW.format("wording")}, '[a-z0-9]+') as w from templates)),
total as (select ln(1 + count(*)) + 1 as other, count(*) as t from templates),
idf as (select term, ln((1 + any_value(t))::double / (1 + count(distinct template))) + 1 as idf from tw, total group by term),
tf as (select template, term, count(*) as n, any_value(idf) as idf from tw join idf using (term) group by all),
weights as (select template, term, n * idf / norm as weight from tf join (select template, sqrt(sum(pow(n * idf, 2))) as norm from tf group by template) using (template)),
shapes as (select template, licence, title, m from templates join (select template, count(*) as m from tw group by template) using (template)),
files as (
  select row_number() over () as r, doc_id, coalesce(text, '') as body, coalesce(doc_id, 0) as k,
         [coalesce(source, 'unknown'), coalesce(lang, 'unknown'), 'a' || (coalesce(doc_id, 0) % 3), 'b' || (coalesce(doc_id, 0) % 5)] as folders
  from documents),
placed as (
  select *, array_to_string(folders[1 : 2 + (k // 7) % 3], '/') as dir, case when length(body) <= 1000 then 'LICENSE-' || k else k || '.txt' end as name from files),
hinted as (select r, length(body) <= 1000 as named, regexp_extract_all({_LOW.format("body")}, '[a-z0-9]+') as w from placed where {_HINTED}),
votes as (
  select r, template, pos - place as start, count(*) as n
  from (select r, generate_subscripts(w, 1) - 1 as pos, unnest(w) as term from hinted) join tw using (term)
  where term not in ({", ".join(f"'{w}'" for w in COMMON)}) group by all),
laid as (select r, template, arg_max(start, struct_pack(n := n, first := -start)) as start from votes group by all),
under as (
  select r, template, licence, unnest(w[greatest(start, 0) + 1 : greatest(start, 0) + m]) as term
  from hinted join laid using (r) join shapes using (template) where named or not title),
counts as (select r, template, licence, term, count(*) as n from under group by all),
scored as (
  select r, template, licence, round(sum(n * coalesce(idf, other) * weight) / sqrt(sum(pow(n * coalesce(idf, other), 2))), 6) as cosine
  from counts left join idf using (term) left join weights using (term, template), total group by all),
best as (select r, max(struct_pack(cosine := cosine, licence := licence)) as m from scored where cosine >= 0.8 group by r),
tags as (select r, regexp_replace(nullif(regexp_extract(body, '{TAG}', 1), ''), '[ \t]+', ' ', 'g') as tag from placed),
own as (
  select doc_id, dir || '/' || name as path, dir, name like 'LICENSE-%' as named, coalesce(tag, m.licence) as licence,
         case when tag is not null then 'tag' when m is not null then 'header' end as basis, case when tag is not null then 1.0::double else m.cosine end as cosine
  from placed left join best using (r) left join tags using (r)),
speaking as (select dir as given_by, arg_min(licence, path) as given from own where named and licence is not null group by dir),
above as (
  select dir, max(struct_pack(depth := length(given_by), given_by := given_by, given := given)) as near
  from (select distinct dir from own) join speaking on given_by = '' or dir = given_by or starts_with(dir, given_by || '/') group by dir)
select doc_id, path, coalesce(licence, near.given) as licence, coalesce(basis, case when near is not null then 'inherited' end) as basis,
       case when licence is null then near.given_by end as licence_dir, cosine
from own left join above using (dir)
"""


_BLANK = r"\x20\x09-\x0D"

COUNTS_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') as w from documents),
g as (select r, i, count(*) over (partition by r, g) as n from (select r, i, array_to_string(w[i : i + 2], ' ') as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3))),
p as (select r, count(distinct k) as n from (select r, unnest([i, i + 1, i + 2]) as k from g where n > 1) group by r),
l as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(body, chr(10))) as line from d) where regexp_matches(line, '[^{_BLANK}]') group by r),
c as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(l.n, 0) as bigint) as n_dup_lines, cast(coalesce(p.n, 0) as bigint) as n_repeat_words
  from d left join p using (r) left join l using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
"""

TOTALS_SQL = "select count(*) as docs, cast(sum(coalesce(strlen(text), 0) + 8) as bigint) as size, true as gapless, cast(0 as bigint) as strays, true as within from documents"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_warc": op2_warc,
        "op3_quality_rules": op3_quality_rules,
        "op4_url_filters": op4_url_filters,
        "op5_decontamination": op5_decontamination,
        "op6_simhash": op6_simhash,
        "op7_licences": op7_licences,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
        "quality_rule_counts": quality_rule_counts,
        "shard_totals": shard_totals,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op4_url_filters": OP4_SQL, "op5_decontamination": OP5_SQL, "op7_licences": OP7_SQL, "quality_rule_counts": COUNTS_SQL, "shard_totals": TOTALS_SQL}
