from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import decontaminate as D

from .helpers import HARD, LONG, empty_docs, hard_docs, lower_ascii

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
ITEMS = "item_id string, text string, doc_id string, _words int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def report(docs, items):
    windows: dict = {}
    for name, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name or "")
    out = []
    for i, text in docs:
        w = words(text)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    names |= own
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_matches_brute_force(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    truth = report([(r["doc_id"], r["text"]) for r in docs.collect()], [(str(r["item_id"]), r["text"]) for r in items.collect()])
    assert any(r[-1] for r in truth)
    assert result(D.contamination_report(docs, items)) == truth
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)  # the way for large benchmarks
    monkeypatch.setattr(D, "MAP_BITS", 1 << 8)  # a map that lets nearly all through
    assert result(D.contamination_report(docs, items)) == truth


def test_random_overlaps(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(9)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k % 30}", text(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(40)] + [("null", None), (None, text(12)), ("x,y", text(10))]
    docs = [(k, text(rng.choice([0, 1, 5, 30, 200]))) for k in range(60)]
    for k, (_, t) in enumerate(items[:20]):
        docs.append((100 + k, f"{text(5)}; {(t or '').upper()}! {text(4)}"))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(a, b, None, None) for a, b in items], ITEMS)
    truth = report(docs, items)
    assert result(D.contamination_report(*frames)) == truth
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(D, "MAP_BITS", 1 << 6)
    assert result(D.contamination_report(*frames)) == truth


def test_hard_rows(spark):
    tail = " ".join(LONG.split()[-12:])
    items = spark.createDataFrame([("a", tail, None, None), ("b", "", None, None), ("c", None, None, None), ("d", "word", None, None)], ITEMS)
    docs = hard_docs(spark)
    assert result(D.contamination_report(docs, items)) == report(HARD, [("a", tail), ("b", ""), ("c", None), ("d", "word")])
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    # "word" is an item of one word: the documents that say it, and the long ones, go
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 0, 1, 2, 3, 5, 6, 9, 9, 10]
    assert D.contamination_report(empty_docs(spark), items).count() == 0
    none = D.contamination_report(docs, items.where("false")).collect()
    assert len(none) == len(HARD) and not any(r["contaminated"] for r in none)


@settings(deadline=None)
@given(st.lists(st.integers(0, 20), min_size=6, max_size=80), st.integers(1, 9))
def test_every_window_keeps_a_gram(values, width):
    grams = np.array(values, np.uint64)
    kept = set(D.winnow(grams, width).tolist())
    for i in range(len(values) - width + 1):
        own = range(i, i + width)
        assert any(j in kept and values[j] == min(values[k] for k in own) for j in own)


def test_equal_hashes_of_different_words_are_no_hit(spark, monkeypatch):
    """With every word hashed alike all places are candidates; the words decide."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    items = [("a", text(14)), ("b", text(10)), ("c", text(3))]
    docs = [(i, text(40)) for i in range(6)] + [(10, f"{text(7)} {items[0][1]} {text(5)}"), (11, items[1][1]), (12, f"x {items[2][1]} y")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(a, b, None, None) for a, b in items], ITEMS)
    monkeypatch.setattr(D, "mix", lambda x: x * np.uint64(0))
    assert sorted((r["doc_id"], r["n_hit"]) for r in _local_report(*frames)) == sorted((r[0], r[2]) for r in report(docs, items))


def _local_report(docs, benchmark):
    """contamination_report with the scans run in this process, where patches hold."""
    scanner = D.Scanner(np.full(1 << 10, (1 << 64) - 1, np.uint64), list(range(1, 11)))
    prints = []
    for r in benchmark.collect():
        own = D.alnum_words(r["text"])
        n = min(10, len(own))
        for at, p in zip(*D.prints_of(D.word_hashes(own, len(own)), n), strict=True):
            prints.append((int(p), n, *D.around(own, int(at), n), r["item_id"]))
    for r in docs.collect():
        ((_, found),) = scanner.scan([r["text"]])
        hit = set()
        for f in found:
            for p, n, left, right, _ in prints:
                if (p, n) == (np.int64(f["print"]).view(np.uint64), f["n"]):
                    before = next((k for k, (x, y) in enumerate(zip(left, f["left"], strict=False)) if x != y), min(len(left), len(f["left"])))
                    after = next((k for k, (x, y) in enumerate(zip(right, f["right"], strict=False)) if x != y), min(len(right), len(f["right"])))
                    if before + after >= n and after >= min(5, n):
                        hit |= set(range(f["at"] - before, f["at"] + after))
        yield {"doc_id": r["doc_id"], "n_hit": len(hit)}


def test_a_passage_in_very_many_rows(spark):
    """Copies and near copies of one text that holds an item, and items that share their words."""
    item = " ".join(f"p{i}" for i in range(12))
    items = [(f"i{k}", f"{item} own{k}") for k in range(30)]
    docs = [(i, f"before {item} after") for i in range(200)] + [(1000 + i, f"{i} {item}") for i in range(50)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(a, b, None, None) for a, b in items], ITEMS)
    assert result(D.contamination_report(*frames)) == report(docs, items)
    assert D.drop_contaminated(*frames).count() == 0


def test_names_step_aside(spark):
    docs = spark.createDataFrame([(1, "one two")], "n_hit long, text string")
    out = D.contamination_report(docs, spark.createDataFrame([("a", "two", None, None)], ITEMS), id_col="n_hit")
    assert out.columns == ["n_hit", "n_words", "n_hit_", "n_items", "items_sha256", "contaminated"] and out.collect()[0]["n_hit_"] == 1
