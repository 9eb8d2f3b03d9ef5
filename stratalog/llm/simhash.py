"""SimHash near-duplicate detection with BK-trees over fingerprint shards.

Charikar, "Similarity estimation techniques from rounding algorithms";
Burkhard and Keller, "Some approaches to best-match file searching".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, free_names, store
from .text import lower_words, small_batches

#: The bits of a fingerprint in four blocks: fingerprints that differ in two bits at most agree on two blocks at least.
BLOCKS = ((0, 16), (16, 16), (32, 16), (48, 16))
RADIUS = 2
#: A shard of more fingerprints is dealt out again by a third of its remaining bits, and so on.
SHARD_LIMIT = 1024


def _mask(start: int, bits: int) -> int:
    return ((1 << bits) - 1) << start


def _thirds(mask: int) -> list[int]:
    """The mask with each third of the other bits; two fingerprints that differ in two of the others at most agree on one of these."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [0, len(free) // 3, 2 * len(free) // 3, len(free)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


#: Bits on which the members of a shard agree, at the first level and after each refinement: 32, 42 or 43, 49 or 50, 54 or 55.
#: What is left at last are 10 bits, so no shard of distinct fingerprints can be over the limit then.
MASKS = [[_mask(*a) | _mask(*b) for i, a in enumerate(BLOCKS) for b in BLOCKS[i + 1 :]]]
while any(64 - m.bit_count() > SHARD_LIMIT.bit_length() - 1 for m in MASKS[-1]):
    MASKS.append([child for m in MASKS[-1] for child in _thirds(m)])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats counted; a bit is set if more than half of the hashes set it. No words: 0."""
    words = lower_words(text)
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(width)), strict=False)
    hashes = np.fromiter((digest(join(s), 42) for s in shingles), "<u8", len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return of(text)


class BKTree:
    """Children hang on edges numbered by their Hamming distance to the parent, so a search follows only edges within the radius of its own distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of all values within the radius."""
        found, todo, values, edges = [], [0] if self.values else [], self.values, self.edges
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in edges[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.edges[at]:
                self.edges[at][d] = new
                break
            at = self.edges[at][d]
        self.values.append(value)
        self.edges.append({})


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning set of the links among distinct values: at most one for each value, joining the same values as all links do."""
    tree, parent, out = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for new, value in enumerate(values):
        for at in tree.near(value, radius):
            a, b = root(at), root(new)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((values[at], value))
        tree.add(value)
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal shards in sorted (shard, fp) batches."""
    key, values, found = None, [], []
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                found += shard_links(values)
                key, values = k, []
            values.append(v & 0xFFFFFFFFFFFFFFFF)
        if found:
            yield _links(found)
            found = []
    found += shard_links(values)
    yield _links(found)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["src", "dst"])


def fingerprint_links(fps: DataFrame, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (src, dst) among distinct fingerprints (column fp) that connect whatever a radius of two connects.

    A shard holds the fingerprints that agree on two of the four blocks, 32
    bits, so that it stays small in a corpus of any size; each gets a BK-tree.
    Where texts are so alike that a shard has more than ``shard_limit``
    fingerprints, these are dealt out once more by each third of the other
    bits, which loses no pair within the radius, and again as long as shards
    are over the limit. After three times only ten bits are left to differ in:
    no tree can be larger than the limit, and a fingerprint has 27 rows for
    each of its six first shards at most. Only counts are looked at in between.
    """
    way = lambda masks: F.array(*(F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    rows, small = fps.select("fp", F.explode(way(MASKS[0])).alias("k")).select("fp", "k.way", "k.key"), []
    for level in range(len(MASKS)):
        sizes = rows.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = store(rows.join(sizes, ["way", "key"]), "shards")
        small.append(shared.where(F.col("n") <= shard_limit).select(F.xxhash64(F.lit(level), "way", "key").alias("shard"), "fp"))
        large = shared.where(F.col("n") > shard_limit)
        if level + 1 == len(MASKS):
            small.append(large.select(F.xxhash64(F.lit(level), "way", "key").alias("shard"), "fp"))
        elif large.isEmpty():
            break
        else:
            children = F.slice(way(MASKS[level + 1]), F.col("way") * 3 + 1, F.lit(3))
            rows = large.select("fp", F.explode(children).alias("k")).select("fp", "k.way", "k.key")
    dealt = small[0]
    for more in small[1:]:
        dealt = dealt.unionByName(more)
    return dealt.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_grouped, "src long, dst long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """fingerprint (16 hex digits) and component_id of every row of docs.

    component_id is the least id among all rows whose fingerprints are linked
    to the row's, directly or over others, at two differing bits or fewer.
    Texts that are null or without words have the fingerprint zero and link
    like any other. A null id gets its class too and is never its least id
    unless the class has no other. Repeated rows stay repeated; other columns
    are not read, and result columns step aside where the id has their name.

    Texts are read once; what moves afterwards is fingerprints. Equal ones
    meet in a partial aggregate, so a group of copies of any size costs one row
    for each task.
    """
    small_batches(docs.sparkSession)
    marked = store(docs.select(F.col(id_col).alias("_id"), fingerprint_column(F.col(text_col), width).alias("fp")), "fingerprints")
    least = cut(marked.groupBy("fp").agg(F.min("_id").alias("_least")))
    linked = connected_components(fingerprint_links(least.select("fp")))
    tied = least.join(linked, least.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("_root"), "_least")
    best = tied.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = tied.join(best, "_root").select("fp", "component_id")
    print_, component = free_names([id_col], "fingerprint", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes, "fp").select(F.col("_id").alias(id_col), digits.alias(print_), F.col("component_id").alias(component))
