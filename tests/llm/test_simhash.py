from __future__ import annotations

import itertools
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import simhash as S

from .helpers import HARD, blank_words, components, empty_docs, hard_docs, lower_ascii


def print_of(text):
    """The contract, bit by bit."""
    words = blank_words(lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [print_of(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = components(distinct, [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 2])
    least: dict = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(S.near_duplicate_classes(docs)) == expected(rows)


def test_hard_rows(spark):
    assert result(S.near_duplicate_classes(hard_docs(spark))) == expected(HARD)
    assert S.near_duplicate_classes(empty_docs(spark)).count() == 0


def test_names_step_aside(spark):
    docs = spark.createDataFrame([(2, "a b c d"), (1, "a b c d")], "fp long, text string")
    assert sorted(tuple(r) for r in S.near_duplicate_classes(docs, "fp").select("fp", "component_id").collect()) == [(1, 1), (2, 1)]
    out = S.near_duplicate_classes(docs.withColumnRenamed("fp", "fingerprint"), "fingerprint")
    assert out.columns == ["fingerprint", "fingerprint_", "component_id"]


def test_long_text_is_read_to_its_end():
    text = " ".join(f"w{i}" for i in range(70_000))
    assert S.fingerprint(text) == print_of(text)


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 2**64 - 1), st.integers(0, 40))
def test_tree_search_is_complete(values, value, radius):
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    found = sorted(tree.values[i] for i in tree.near(value, radius))
    assert found == sorted(v for v in values if (v ^ value).bit_count() <= radius)


def test_masks_lose_no_pair():
    """Whatever two bits differ, two fingerprints agree on one mask of each level, and on a child of every mask they agree on."""
    for a, b in itertools.combinations(range(64), 2):
        flipped = 1 << a | 1 << b
        agreed = [i for i, m in enumerate(S.MASKS[0]) if not m & flipped]
        assert agreed
        for level in range(1, len(S.MASKS)):
            children = [[c for c in range(3 * i, 3 * i + 3) if not S.MASKS[level][c] & flipped] for i in agreed]
            assert all(children)
            agreed = [c for own in children for c in own]
    assert all(1 << (64 - m.bit_count()) <= S.SHARD_LIMIT for m in S.MASKS[-1]) and len(S.MASKS[-1]) == 6 * 27


def test_a_large_dense_cluster(spark):
    """Three thousand fingerprints within a few bits of one centre, all in one shard of every level but the last."""
    rng, centre = random.Random(17), random.Random(5).getrandbits(64)
    values = set()
    while len(values) < 3000:
        v = centre
        for b in rng.sample(range(14), rng.randrange(8)):
            v ^= 1 << b
        values.add(v)
    loners = [v ^ (0x7 << 40) for v in sorted(values)[:40]]
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in [*values, *loners]]
    links = [(r[0] & (1 << 64) - 1, r[1] & (1 << 64) - 1) for r in S.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    everything = [*values, *loners]
    near = {v: [v ^ (1 << a) ^ (1 << b) for a in range(14) for b in range(a)] + [v ^ (1 << a) for a in range(14)] for v in everything}
    present = set(everything)
    truth = [(v, w) for v, around in near.items() for w in around if w in present]
    assert components(everything, links) == components(everything, truth)


@pytest.mark.parametrize("limit", [1024, 4])
def test_links_of_dense_shards(spark, limit):
    """Chains of one-bit and two-bit steps around few centres fill shards well over the limit."""
    rng = random.Random(3)
    values = set()
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(60):
            values.add(v)
            for _ in range(rng.choice([1, 1, 2, 3])):
                v ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = [(r[0] & (1 << 64) - 1, r[1] & (1 << 64) - 1) for r in S.fingerprint_links(spark.createDataFrame(signed, "fp long"), limit).collect()]
    truth = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2]
    assert components(values, links) == components(values, truth)
