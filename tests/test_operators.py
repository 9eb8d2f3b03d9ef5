"""Operators whose queries have no SQL statement, or whose edges the tables do not reach."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.operators import diff as D
from stratalog.operators import distribution as V
from stratalog.operators import relational as R
from stratalog.operators import series as S
from stratalog.operators import structure as T
from stratalog.session import Growing, parts_for, running_sums


def test_nearest_rank(spark):
    rng = random.Random(1)
    rows = [(n, rng.randrange(50)) for n in range(1, 121) for _ in range(n)] + [(0, None)]
    df = spark.createDataFrame(rows, "n long, v long")
    got = {r["n"]: (r["a"], r["b"]) for r in df.groupBy("n").agg(V.nearest_rank("v", 0.5).alias("a"), V.nearest_rank("v", 0.95).alias("b")).collect()}
    assert got.pop(0) == (0, 0)
    for n, (a, b) in got.items():
        values = sorted(v for k, v in rows if k == n)
        assert (a, b) == (values[int(n * 0.5)], values[int(n * 0.95)])


def test_compression_distance(spark):
    base = "function f(a, b) { return a.map(x => x + b).filter(Boolean) } " * 4
    texts = [(1, "f", base), (2, "f", base.replace("Boolean", "Number")), (3, "f", "".join(chr(33 + i * 7 % 90) for i in range(250))), (4, "alone", base)]
    got = {(r["a"], r["b"]): r["ncd_x1000"] for r in V.compression_distance(spark.createDataFrame(texts, "id long, name string, text string"), "id", "name", "text").collect()}
    size = lambda s: len(zlib.compress(s.encode(), 6))
    x, y = base, texts[1][2]
    truth = (size(x + y) - min(size(x), size(y))) / max(size(x), size(y))
    assert set(got) == {(1, 2)} and abs(got[1, 2] - truth * 1000) <= 60


def test_hashes_ignore_order(spark):
    df = spark.createDataFrame([("r", i, f"v{i}") for i in range(50)], "g string, a long, b string")
    one = lambda d: T.input_hash(d, "g", "a", "b").head()["hash"]
    assert one(df) == one(df.orderBy(F.desc("a")).repartition(3)) == one(df.unionByName(df)) != one(df.where("a > 0"))
    ids = D.fact_ids(df, "R", ["a", "b"]).withColumn("relation", F.lit("R"))
    row = lambda d: tuple(D.head(d).head())
    assert row(ids) == row(ids.repartition(5).unionByName(ids)) and row(ids)[1] == 50
    assert len(ids.head()["id"]) == 64 and ids.select("id").distinct().count() == 50


def test_fact_id_does_not_depend_on_column_order(spark):
    df = spark.createDataFrame([(1, "é\"\\\n", None)], "n long, s string, z string")
    a, b = (D.fact_ids(df, "R", c).head()["id"] for c in (["n", "s", "z"], ["z", "n", "s"]))
    import hashlib

    assert a == b == hashlib.sha256('R\0{"n":1,"s":"é\\"\\\\\\n","z":null}'.encode()).hexdigest()


def test_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = 2 + x @ np.array([1.0, -3.0, 0.5]) + rng.normal(scale=0.01, size=300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    got = T.least_squares(df, ["a", "b", "c"], "y")
    truth = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)[0]
    assert np.allclose([got["intercept"], got["a"], got["b"], got["c"]], truth, atol=1e-6)
    assert T.least_squares(df.where("false"), ["a"], "y") == {"intercept": 0.0, "a": 0.0}


def test_max_coverage_and_empty_inputs(spark):
    sets = spark.createDataFrame([("t1", "a", 5), ("t1", "b", 1), ("t2", "a", 5), ("t2", "c", 2), ("t3", "d", 1)], "t string, f string, w long")
    got = [tuple(r) for r in V.max_coverage(sets, "t", "f", "w", 5).orderBy("step").collect()]
    assert [g[1:] for g in got] == [("t2", 7), ("t1", 1), ("t3", 1)]
    assert V.max_coverage(sets.where("false"), "t", "f", "w").count() == 0
    assert V.entropy(sets.where("false"), "t", "f").count() == 0
    assert V.entropy(spark.createDataFrame([("k", "x")] * 4, "k string, v string"), "k", "v").head()["entropy_x1000"] == 0
    assert V.entropy(spark.createDataFrame([("k", "x"), ("k", "y")] * 2, "k string, v string"), "k", "v").head()["entropy_x1000"] == 1000


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(spark, parts):
    """One group with most rows, nulls among the groups, ties broken by the key."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2, 2]), i, rng.randrange(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, k int, v int").repartition(parts)
    with_parts = spark.conf.get("spark.sql.shuffle.partitions")
    out = {r["k"]: (r["s"], r["n"]) for r in running_sums(df, ["g"], [F.col("k").desc()], s=F.col("v"), n=F.lit(1)).collect()}
    assert with_parts and len(out) == 500
    for g, k, _ in rows:
        before = [v for h, j, v in rows if h == g and j >= k]
        assert out[k] == (sum(before), len(before))
    assert running_sums(df.where("false"), ["g"], [F.col("k")], s=F.col("v")).count() == 0


def test_growing_sets_are_written_seldom(spark):
    whole, seen = Growing(spark.range(0)), 0
    for i in range(11):
        whole.add(spark.range(10 * i, 10 * i + 10))
        seen += 10
        assert whole.df.count() == seen and len(whole.parts) == bin(i + 1).count("1")


def test_anchors_with_stars(spark):
    files = ["src/a.ts", "src/b.ts", "src/x/a.ts", "a.ts", "lib/src/a.ts", "src/ab.spec.ts", "é/(x).ts"]
    anchors = ["src/*.ts", "*/a.ts", "a.ts", "*", "src/*/*.ts", "*/*", "src/a*.ts", "x/a.ts", "é/(*).ts", "nothing/*"]
    got = {tuple(r) for r in T.anchor_matches(spark.createDataFrame([(a,) for a in anchors], "anchor string"), spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    wanted = set()
    for a in anchors:
        for f in files:
            if "*" in a:
                hit = re.fullmatch("".join("[^/]*" if c == "*" else re.escape(c) for c in a), f)
            else:
                hit = f == a or f.endswith("/" + a)
            wanted |= {(a, f)} if hit else set()
    assert got == wanted


def spiky(spark, files, functions, days=20, seed=7):
    rng = random.Random(seed)
    rows = [("symbol", f"f{i}:g{j}", d, 1) for i, n in zip(range(files), functions, strict=True) for j in range(n) for d in rng.sample(range(days), rng.randrange(2, 7))]
    return spark.createDataFrame(rows, "kind string, key string, bucket long, count long"), rows


def test_lag_excess_joins_nothing_after_its_blocks(spark):
    df, rows = spiky(spark, 3, (9, 12, 7))
    rows += [("symbol", f"f{i}:copy", d, 1) for i in range(3) for d in (1, 4, 9, 13)]
    df = spark.createDataFrame(rows, df.schema)
    at = {}
    for _, k, d, _ in rows:
        at.setdefault(f"symbol:{k}", set()).add(d)
    truth = set()
    for a, x in at.items():
        able = len([d for d in x if d < 19])
        for b, y in at.items():
            joint = len({d + 1 for d in x} & y)
            if a != b and able >= 3 and joint and joint / able - len(y) / 20 >= 0.15:
                truth.add((a, b, able, joint, int(np.floor((joint / able - len(y) / 20) * 1000))))
    for block, members in ((1024, 1000), (5, 2)):
        found = S.lag_excess(df, 20, block=block, members=members)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("FlatMapGroupsIn") and "Join" not in plan[: plan.index("FlatMapGroupsIn")]
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(truth) and set(got) == truth


def test_lag_rollup_is_the_rollup_of_pairs(spark):
    df, _ = spiky(spark, 40, (1500, *[3] * 38, 0))
    whole = {tuple(r) for r in S.file_rollup(S.lag_excess(df, 20, min_excess=0.3)).collect()}
    for block in (4096, 60):
        found = S.lag_rollup(df, 20, min_excess=0.3, block=block)
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsIn")[0]
        got = [tuple(r) for r in found.collect()]
        assert whole and len(got) == len(whole) and set(got) == whole


def test_anchors_travel_and_paths_do_not(spark):
    anchors = spark.createDataFrame([("f7.ts",), ("d1/f*.ts",)], "anchor string")
    files = spark.createDataFrame([(f"d{i % 3}/f{i}.ts",) for i in range(30)], "file string")
    found = T.anchor_matches(anchors, files)
    assert {tuple(r) for r in found.collect()} == {("f7.ts", "d1/f7.ts")} | {("d1/f*.ts", f"d1/f{i}.ts") for i in range(1, 30, 3)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2


def test_partitions_follow_the_rows(spark):
    assert parts_for(10, spark) == int(spark.conf.get("spark.sql.shuffle.partitions")) and parts_for(50_000_001, spark) == 101


def test_hamming_pairs_are_spread_by_their_number(spark):
    rows = [(i, i % 2, (i * 7) % 64) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g int, code long")
    found = V.hamming_pairs(df, "i", "code", ["g"], 1)
    truth = {(a, b, (x ^ y).bit_count()) for a, g, x in rows for b, h, y in rows if a < b and g == h and (x ^ y).bit_count() <= 1}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(truth) and set(got) == truth
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


def test_sorted_digest_by_ranges_that_carry_on(spark, monkeypatch):
    import hashlib

    sizes = {"a": 1, "b": 700, "c": 3, "d": 250, "e": 40}
    items = [(g, f"{g}é{i * 7919 % 1000:04d}{'x' * (i % 90)}") for g, n in sizes.items() for i in range(n)]
    known = {g: (n, hashlib.sha256("\n".join(sorted(t for h, t in items if h == g)).encode()).hexdigest()) for g, n in sizes.items()}
    df, held, own = spark.createDataFrame(items + items[:50], "g string, t string"), [], D._digests_in_task
    monkeypatch.setattr(D, "_digests_in_task", lambda rows, *a: held.append(rows.groupBy("g").count().agg({"count": "max"}).head()[0]) or own(rows, *a))
    assert {g: (n, h) for g, n, h in D.sorted_digest(df, "g", "t", "h", each=60).collect()} == known
    assert max(held) <= 60, "a task read a larger group"
    assert {g: (n, h) for g, n, h in D.sorted_digest(df, "g", "t", "h").collect()} == known


def test_shared_edges_over_blocks(spark, monkeypatch):
    """Names of many blocks, of one, and of one side alone; repeated rows, nulls and nodes that stand on both sides."""
    for name, size in (("BLOCK", 12), ("RUN", 5), ("FEW", 2)):
        monkeypatch.setattr(R, name, size)
    left = [(f"n{i}", i % 3) for i in range(90)] + [("n0", 0), ("n0", 1), (None, 0), ("n1", None), ("lone", 7)]
    right = [(f"n{i}", i % 2) for i in range(60, 140)] + [("n60", 0), (None, 1), ("n99", None), ("alone", 8)]
    got = R.shared_edges(spark.createDataFrame(left, "node string, name int"), spark.createDataFrame(right, "node string, name int"), "name")
    want = {(a, b, x) for a, x in left for b, y in right if x is not None and x == y and a and b and a != b}
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["src", "dst", "name"] and len(rows) == len(want) and set(rows) == want
    none = spark.createDataFrame([], "node string, name int")
    assert R.shared_edges(none, none, "name").count() == 0


def test_shared_edges_of_one_name_are_spread(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 50, raising=False)
    left, right = (spark.range(500).select(F.concat(F.lit(side), "id").alias("node"), F.lit("one").alias("name")) for side in "sc")
    tasks = [r["count"] for r in R.shared_edges(left, right, "name").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 250_000 and max(tasks) < 25_000


def test_shared_edges_take_little_of_a_file(spark, tmp_path):
    """Every node of the right stands with the same run of nodes of the left, so that edges take a fraction of a byte each."""
    left = spark.range(2_500).select(F.concat(F.lit("s"), "id").alias("node"), F.pmod(F.xxhash64("id"), F.lit(25)).alias("name"))
    right = spark.range(25_000).select(F.concat(F.lit("c"), "id").alias("node"), F.pmod(F.xxhash64("id"), F.lit(25)).alias("name"))
    out = R.shared_edges(left, right, "name")
    out.write.parquet(str(tmp_path / "edges"))
    rows = spark.read.parquet(str(tmp_path / "edges")).count()
    assert rows == left.join(right, "name").count()
    assert sum(f.stat().st_size for f in (tmp_path / "edges").glob("*.parquet")) < 0.7 * rows
