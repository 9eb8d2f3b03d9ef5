from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from stratalog.llm import quality_rules as Q

from .helpers import HARD, blank_words, empty_docs, hard_docs

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base(text):
    text = text or ""
    words = blank_words(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if blank_words(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def test_counts_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = Q.quality_verdicts(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert (*(r[c] for c in COUNTS), r["base_failed"]) == base(texts[r["doc_id"]]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_hard_rows(spark):
    rows = Q.quality_verdicts(hard_docs(spark)).collect()
    key = lambda x: repr((x[0], *x[1:]))
    assert sorted(((r["doc_id"], *(r[c] for c in COUNTS), r["base_failed"]) for r in rows), key=key) == sorted(((i, *base(t)) for i, t in HARD), key=key)
    assert Q.quality_verdicts(empty_docs(spark)).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(5)
    n, good = 40_000, rng.random(40_000) < 0.8
    called = np.array([0.75, 0.6, 0.5, 0.8])  # poor documents called poor
    alarm = np.array([0.05, 0.1, 0.02, 0.04])  # sound ones called poor
    poor = np.where(good[:, None], rng.random((n, 4)) < alarm, rng.random((n, 4)) < called)
    votes = np.where(rng.random((n, 4)) < 0.2, 0, np.where(poor, -1, 1))
    patterns, weight = np.unique(votes, axis=0, return_counts=True)
    model = Q.fit(patterns, weight.astype(float))
    assert abs(model.prior - 0.8) < 0.04
    assert np.abs(model.accuracies[:, 0] - called).max() < 0.08 and np.abs(model.accuracies[:, 1] - (1 - alarm)).max() < 0.05
    found = model.posterior(votes) >= 0.5
    assert (found == good).mean() > 0.93


def test_abstaining_says_nothing():
    model = Q.fit(np.array([[1, 1], [-1, -1]]), np.array([8.0, 2.0]))
    assert model.posterior(np.zeros((1, 2), int))[0] == pytest.approx(model.prior)
    assert Q.fit(np.zeros((0, 3), int), np.zeros(0)).prior == 0.8


def test_verdicts_agree_with_labels(spark):
    """Over the larger table: sound documents stay, and poor ones go more often than sound ones."""
    path = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in Q.quality_verdicts(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{path}/labels.parquet").collect()
    share = {q: np.mean([kept[r["doc_id"]] for r in labels if r["quality"] == q]) for q in (0, 1)}
    assert share[1] > 0.9 and share[0] < share[1] - 0.3, share


@pytest.mark.parametrize("odd", ["noise", "inverted"])
def test_a_rule_that_is_wrong(odd):
    """Four sound rules and one that votes by chance, or the wrong way round: the verdicts stay those of the four."""
    rng = np.random.default_rng(8)
    n = 40_000
    good = rng.random(n) < 0.8
    called, alarm = np.array([0.75, 0.6, 0.7, 0.8]), np.array([0.05, 0.1, 0.02, 0.04])
    poor = np.where(good[:, None], rng.random((n, 4)) < alarm, rng.random((n, 4)) < called)
    last = rng.random(n) < 0.3 if odd == "noise" else np.where(good, rng.random(n) < 0.5, rng.random(n) < 0.1)
    votes = np.where(np.column_stack([poor, last]), -1, 1)
    patterns, weight = np.unique(votes, axis=0, return_counts=True)
    model = Q.fit(patterns, weight.astype(float))
    with_it = model.posterior(votes) >= 0.5
    four, four_weight = np.unique(votes[:, :4], axis=0, return_counts=True)
    without = Q.fit(four, four_weight.astype(float)).posterior(votes[:, :4]) >= 0.5
    assert (without == good).mean() > 0.95
    assert (with_it == good).mean() > (without == good).mean() - 0.01
    assert model.accuracies[4, 1] <= 0.75, "what calls many sound documents poor is not believed to be exact"
