"""One document of each class of near duplicates, against brute force over all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from stratalog.llm import similar as N

from .helpers import blank_words, components, empty_docs, hard_docs, lower_ascii


def shingles(text):
    words = blank_words(lower_ascii(text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def alike_components(sets, least):
    """Classes of documents whose sets of shingles have a Jaccard similarity of ``least`` or more."""
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets.items(), 2) if len(a & b) >= least * len(a | b)]
    return components(sets, links)


def test_near_duplicates_of_hard_rows(spark):
    out = N.drop_near_duplicates(hard_docs(spark))
    assert out.columns == hard_docs(spark).columns
    texts = [r["text"] for r in out.collect()]
    assert sum(1 for t in texts if not (t or "").strip()) == 1, "null, empty and blank are one class"
    assert len(texts) == len({t for t in texts}) and len([t for t in texts if t and len(t) > 1000]) == 1
    assert N.drop_near_duplicates(empty_docs(spark)).count() == 0


def test_near_duplicates_with_edits(spark):
    rng = random.Random(8)
    rows = []
    for base in range(40):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(200)]
        for copy in range(3):
            own = list(words)
            for _ in range(copy):
                own[rng.randrange(len(own))] = "edited"
            rows.append((base * 10 + copy, " ".join(own)))
    kept = [r["doc_id"] // 10 for r in N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(set(kept)) == list(range(40)) and len(kept) <= 41


def pairs_near(rng, n, low, high, sizes=(60, 200)):
    """Pairs of texts of invented words, their Jaccard similarity drawn between low and high."""
    out = []
    while len(out) < n:
        size = rng.randrange(*sizes)
        a = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        b = list(a)
        for _ in range(rng.randrange(1, 1 + size // 8)):
            b[rng.randrange(size)] = f"x{rng.randrange(10**9)}"
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if low <= len(x & y) / len(x | y) < high:
            out += [(" ".join(a), " ".join(b))]
    return out


def test_near_duplicates_at_the_threshold(spark):
    """Just above 0.8 all pairs are found, just below it none is."""
    rng = random.Random(21)
    pairs = [*pairs_near(rng, 200, 0.8, 0.82), *pairs_near(rng, 200, 0.75, 0.8), *pairs_near(rng, 100, 0.8, 0.85, (9, 40))]
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    sets = {i: shingles(t) for i, t in rows}
    kept = [r["doc_id"] for r in N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(kept) == sorted(set(alike_components(sets, 0.8).values()))


def test_near_duplicates_of_a_chain(spark):
    """Neighbours alone are alike; the least candidate of many is not, so shards of several classes have to link them."""
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
    rng.shuffle(rows)
    sets = {n: shingles(t) for n, (_, t) in enumerate(rows)}
    data = [(n, t) for n, (_, t) in enumerate(rows)]
    kept = [r["doc_id"] for r in N.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(kept) == sorted(set(alike_components(sets, 0.8).values()))


def test_near_duplicates_are_those_of_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    root = alike_components(sets, 0.8)
    kept = [r["doc_id"] for r in N.drop_near_duplicates(docs).collect()]
    assert sorted(root[i] for i in kept) == sorted(set(root.values()))


def test_recall_just_above_the_similarity(spark):
    """A thousand pairs of 0.8 to 0.85: all but one in a hundred share a shard by calculation; at most one in a hundred may be missed."""
    rng = random.Random(77)
    pairs = pairs_near(rng, 1000, 0.8, 0.85, (20, 150))
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    kept = {r["doc_id"] for r in N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert all(2 * i in kept for i in range(1000))
    assert sum(2 * i + 1 in kept for i in range(1000)) <= 10


def edited(rng, words, n):
    own = list(words)
    for _ in range(n):
        own[rng.randrange(len(own))] = f"x{rng.randrange(10**9)}"
    return " ".join(own)


@pytest.mark.parametrize("block", [2048, 40, 5])
def test_shards_in_blocks(spark, monkeypatch, block):
    """Shards well over the limit: every two members of different classes are compared all the same."""
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, edited(rng, base, rng.randrange(1, 3))) for i in range(150)]
    sets = {i: N.shingle_set(t) for i, t in rows}
    classes = {i: 0 if i < 60 else 1 + i % 7 if i < 80 else 100 + i for i in sets}
    prints = {i: N.set_fingerprint(h).view(np.int64).tolist() for i, h in sets.items()}
    nodes = spark.createDataFrame([(i, *prints[i], [int(x) for x in h.view(np.int64)]) for i, h in sets.items()], "node long, a long, b long, hashes array<long>")
    mixed = spark.createDataFrame([(key, i, classes[i], len(h)) for key in (1, 2) for i, h in sets.items() if key == 1 or i % 2], "key long, node long, class long, n long")
    found = [tuple(r) for r in N.compare_shards(mixed, nodes, 0.8).collect()]
    near = {(i, j) for (i, a), (j, b) in itertools.combinations(sets.items(), 2) if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))}
    same = [(i, j) for i, j in itertools.combinations(sets, 2) if classes[i] == classes[j]]
    assert len(near) > 500 and {tuple(sorted(p)) for p in found} <= near
    assert components(sets, [*found, *same]) == components(sets, [*near, *same])


def test_group_of_many_edited_copies(spark):
    """Pairs on both sides of the similarity in one group: brute force gives the classes, and links stay far fewer than pairs."""
    rng = random.Random(31)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, base, rng.randrange(1, 8))) for i in range(400)]
    root = alike_components({i: shingles(t) for i, t in rows}, 0.8)
    kept = [r["doc_id"] for r in N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert len(set(root.values())) > 20
    assert sorted(kept) == sorted(set(root.values()))


def test_fingerprint_bit_by_bit():
    for n in (0, 1, 2, 7, 300):
        hashes = N.shingle_set(" ".join(f"a{i}" for i in range(n)))
        a, b = N.set_fingerprint(hashes).tolist()
        for word, at in ((a, 0), (b, 0x9E3779B97F4A7C15)):
            own = [int(N.mix(np.array([(int(h) + at) % 2**64], np.uint64))[0]) for h in hashes]
            assert word == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > len(own))


def test_shards_bring_together_by_similarity():
    """How many of the tables a pair shares follows the sixth power of its similarity."""
    rng = np.random.default_rng(4)
    for s, low, high in ((0.9, 0.48, 0.58), (0.8, 0.22, 0.31), (0.5, 0.008, 0.025), (0.1, 0, 0.001)):
        shared = []
        for _ in range(400):
            both = rng.integers(0, 1 << 63, 200, np.uint64)
            k = round(200 * 2 * s / (1 + s))
            x, y = both.copy(), np.concatenate([both[:k], rng.integers(0, 1 << 63, 200 - k, np.uint64)])
            shared.append((N.shard_keys(x) == N.shard_keys(y)).mean())
        assert low <= np.mean(shared) <= high, (s, np.mean(shared))


def test_joined_classes_read_their_steps_once_or_twice(spark):
    rng = random.Random(5)
    steps = [(c, rng.randrange(c), rng.randrange(100)) for c in range(1, 60) for _ in range(2)]
    first = {c: min((f, t) for x, t, f in steps if x == c)[1] for c in {c for c, _, _ in steps}}

    def after(c, n=8):
        return after(first[c], n - 1) if n and c in first else c

    new = N.joined_classes(None, spark.createDataFrame(steps, "class long, to long, first long"))
    assert dict(new.collect()) == {c: after(c) for c in first}
    old = spark.createDataFrame([(n, n - 1) for n in range(2, 60, 2)], "node long, class long")
    both = N.joined_classes(old, spark.createDataFrame(steps, "class long, to long, first long"))
    rows = both.collect()
    held = dict(old.collect())
    assert len(rows) == len(dict(rows)) and dict(rows) == {n: after(held.get(n, n)) for n in {*first, *held}}
    leaves = both._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves <= 4, f"the plan reads {leaves} tables"
