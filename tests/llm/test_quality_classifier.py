from __future__ import annotations

import zlib

import numpy as np
import pytest

from stratalog.llm import quality_classifier as C

from .helpers import HARD, LONG, empty_docs, hard_docs

LABELS = "doc_id long, quality int, text string"


def area(scores, labels):
    """Chance that a sound document scores above a poor one."""
    scores, labels = np.array(scores), np.array(labels)
    good, poor = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > poor) + 0.5 * (good[:, None] == poor)).mean()


def test_identity_equals_all_pairs():
    rng = np.random.default_rng(2)
    m = C.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    at, x = np.array([1, 5, 7, 19, 2, 3]), rng.random(6)
    raw, _ = m.raw(at, x, np.array([0, 4]))
    for begin, end, found in ((0, 4, raw[0]), (4, 6, raw[1])):
        a, v = at[begin:end], x[begin:end]
        pairs = sum(m.v[a[i]] @ m.v[a[j]] * v[i] * v[j] for i in range(len(a)) for j in range(i))
        assert found == pytest.approx(m.bias + m.w[a] @ v + pairs)


def test_pairs_are_learnt():
    """Exclusive or of two features: no weight of single features can tell it."""
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (600, 2))
    rows = [(np.array([a, 2 + b]), np.ones(2)) for a, b in bits]
    labels = (bits[:, 0] ^ bits[:, 1]).astype(float)
    m = C.train(rows, labels, 4, rank=4, rounds=60)
    scores = [float(m.score(a, x, np.zeros(1, np.int64))[0]) for a, x in rows]
    assert ((np.array(scores) > 0.5) == labels).mean() > 0.95


def test_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = C.quality_scores(docs, labels, metadata=("n_chars",)).collect()
    assert len(rows) == docs.count()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    own = [r for r in rows if r["held_out"] and quality.get(r["doc_id"]) is not None]
    assert area([r["score"] for r in own], [quality[r["doc_id"]] for r in own]) > 0.9
    sound = [r["predicted"] for r in own if quality[r["doc_id"]] == 1]
    assert np.mean(sound) > 0.9


def test_held_out_labels_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in C.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_inputs_of_the_score(spark, sf):
    """Language, source and id say nothing: texts that are equal score the same."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("other")})
    a, b = ({r["doc_id"]: r["score"] for r in C.quality_scores(d, labels).collect()} for d in (docs, other))
    assert a == b


def test_hard_rows(spark):
    labels = spark.createDataFrame([(6, 1, None), (4, 0, None), (7, 1, None), (7, 1, None), (None, 1, None), (5, None, None), (99, 0, None)], LABELS)
    rows = C.quality_scores(hard_docs(spark), labels, metadata=("n_chars",)).collect()
    assert len(rows) == len(HARD) and all(0 <= r["score"] <= 1 for r in rows)
    by_text: dict = {}
    for (i, text), r in zip(HARD, rows, strict=True):
        assert r["doc_id"] == i and by_text.setdefault(text, r["score"]) == r["score"]
    kept = C.drop_low_quality(hard_docs(spark), labels)
    assert kept.columns == hard_docs(spark).columns and kept.count() <= len(HARD)
    assert C.quality_scores(empty_docs(spark), labels).count() == 0
    assert {r["predicted"] for r in C.quality_scores(hard_docs(spark), labels.where("false")).collect()} == {1}, "nothing learnt rejects nothing"


def test_whole_texts_are_read():
    a, x = C.features(LONG, [])
    b, y = C.features(LONG + " unseen", [])
    assert len(a) != len(b) or not np.array_equal(x, y)
