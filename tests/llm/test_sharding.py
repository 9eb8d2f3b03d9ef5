from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from stratalog.llm import sharding as S

from .helpers import HARD, empty_docs, hard_docs


def jump_one(key: int, n: int) -> int:
    """One key at a time, in whole numbers."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_matches_scalar_form():
    keys = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2, 24, 1000):
        assert S.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64)
    for n in (1, 7, 24):
        a, b = S.jump(keys, n), S.jump(keys, n + 1)
        assert set(b[a != b]) <= {n} and abs((a != b).mean() * (n + 1) - 1) < 0.1


def check(rows, texts):
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
    wanted = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == wanted
    home: dict = {}
    for r in rows:
        assert 0 <= r["shard"] < 24 and r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
        assert home.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
    for shard in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_shards_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = S.assign_shards(docs.repartition(5)).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    again = {r["doc_id"]: r["shard"] for r in S.assign_shards(docs.coalesce(1)).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in rows}, "the layout of the input decides nothing"


def test_hard_rows(spark):
    check(S.assign_shards(hard_docs(spark)).collect(), HARD)
    assert S.assign_shards(empty_docs(spark)).count() == 0


def test_written_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    S.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.drop("_shard").exceptAll(docs).isEmpty()
