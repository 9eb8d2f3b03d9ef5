"""Near-duplicate texts above a stated Jaccard similarity of their word shingles: SimHash fingerprints in BK-trees, one for each shard.

Charikar, "Similarity estimation techniques from rounding algorithms"; Burkhard
and Keller, "Some approaches to best-match file searching"; Broder, "On the
resemblance and containment of documents".

Two bits of a SimHash suffice for texts that differ in a word or two, and then
blocks of the fingerprint itself can be the shards (see ``simhash``). At a
similarity of 0.8 one bit in seven differs, and any sample of bits short
enough to hold such pairs together brings unrelated texts together too, in
numbers that grow with the square of the corpus. So shards are drawn by least
shingle hashes, which texts without a common shingle never share.
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
from .simhash import BKTree
from .text import gram_hashes, lower_words, mix, small_batches, word_hashes

#: A pair of similarity s shares a shard in one table with probability s ** DRAWS: at 0.8 that is 0.9993 in any of 24, at 0.3 0.017, at 0.1 0.00002.
TABLES, DRAWS = 24, 6
_ODD = np.random.default_rng(7).integers(0, 1 << 63, TABLES * DRAWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of a fingerprint.
WIDTH = 128
#: Rounds in which every member of a shard is compared with one of it, before all that is still apart is.
STAR_ROUNDS = 2
#: Classes are ordered by their numbers with these bits flipped.
ORDERS = (0, 0x5A5A5A5A5A5, 0x3C96A5C3965)
#: Rows and shingles of one block of a shard: a task holds two blocks.
BLOCK_ROWS, BLOCK_HASHES = 2048, 1 << 21
#: A side of a join that is measured to be no larger is broadcast, a larger one is merged.
BROADCAST_BYTES = 32 << 20


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, of the whole text if it has fewer words; none for a text without words."""
    words = lower_words(text)
    return np.unique(gram_hashes(word_hashes(words, len(words)), min(width, len(words)))) if words else np.zeros(0, np.uint64)


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """128-bit SimHash of a set as two words; zeros for the empty one."""
    ones = np.zeros(WIDTH, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        wide = np.stack([mix(part + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))) for k in range(WIDTH // 64)], 1).astype("<u8")
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def shard_keys(hashes: np.ndarray) -> np.ndarray:
    """The set's shard in each table: a hash of its least elements under six permutations, and of the table."""
    least = np.full(TABLES * DRAWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _ODD).min(0), out=least)
    keys = np.arange(1, TABLES + 1, dtype=np.uint64)
    for draw in least.reshape(DRAWS, TABLES):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + draw)
    return keys


def radius(similarity: float, bits: int = WIDTH) -> int:
    """Three standard deviations above the bits in which the fingerprints of a pair of just this Jaccard similarity differ.

    One bit differs with probability acos(2s / (1 + s)) / pi. Sets of a few shingles tie more often than that formula
    for large ones says: four and five of similarity 0.8 differ in 0.1875 of the bits, not in 0.1515, the most of all
    sizes. A quarter more covers them.
    """
    p = 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + 3 * np.sqrt(bits * p * (1 - p))))


def signatures(text: Column, width: int = 5) -> Column:
    """struct(digest: tells sets apart, a, b: the fingerprint, n: elements, keys: a shard for each table)."""

    @F.pandas_udf("struct<digest binary, a long, b long, n long, keys array<long>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashes = shingle_set(text, width)
            a, b = set_fingerprint(hashes).view(np.int64).tolist()
            rows.append((xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()), a, b, len(hashes), shard_keys(hashes).view(np.int64)))
        return pd.DataFrame(rows, columns=["digest", "a", "b", "n", "keys"])

    return of(text)


def _small(df: DataFrame, width: int) -> DataFrame:
    """df, of about ``width`` bytes a row, with the hint that its measured size calls for."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df.hint("merge")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose sets (node, a, b, hashes) have this Jaccard similarity or more; a row at a time, as sets may be long."""
    side = lambda end, mark: sets.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}{mark}") for c in ("a", "b", "hashes")))
    held = pairs.join(side("src", 1), "src").join(side("dst", 2), "dst")
    bits = F.bit_count(F.col("a1").bitwiseXOR(F.col("a2"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("b2")))
    one, two, both = F.size("hashes1"), F.size("hashes2"), F.size(F.array_intersect("hashes1", "hashes2"))
    near = (bits <= radius(similarity)) & (F.least(one, two) >= F.greatest(one, two) * F.lit(similarity))
    return held.where(F.when(near, both >= (one + two - both) * F.lit(similarity)).otherwise(False)).select("src", "dst")


def unit_links(rows: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Links of one unit: of each of its queries with what lies in the tree, where they are of different classes still.

    Rows are (role, node, class, fingerprint, hashes); role 0 is in the tree only, 1 only asks, 2 asks and then joins the tree.
    """
    tree, parent, held, out, near = BKTree(), {}, [], [], radius(similarity)

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for role, node, own, fp, hashes in sorted(rows, key=lambda r: r[:2]):
        for at in tree.near(fp, near) if role else ():
            other, its, theirs = held[at]
            if root(own) == root(its) or min(len(hashes), len(theirs)) < similarity * max(len(hashes), len(theirs)):
                continue
            both = len(np.intersect1d(hashes, theirs, assume_unique=True))
            if both >= similarity * (len(hashes) + len(theirs) - both):
                parent[root(own)] = root(its)
                out.append((other, node))
        if role != 1:
            tree.add(fp)
            held.append((node, own, hashes))
    return out


def _units(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, role, node, class, a, b, hashes) sorted by unit to links (src, dst), a unit at a time."""
    unit, rows = None, []

    def done() -> pa.RecordBatch:
        links = np.array(unit_links(rows, similarity), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["src", "dst"])

    for batch in batches:
        numbers = [batch.column(i).to_pylist() for i in range(6)]
        sets = batch.column(6)
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        for i, (u, role, node, own, a, b) in enumerate(zip(*numbers, strict=True)):
            if u != unit:
                if rows:
                    yield done()
                unit, rows = u, []
            rows.append((role, node, own, (a & 0xFFFFFFFFFFFFFFFF) << 64 | b & 0xFFFFFFFFFFFFFFFF, values[offsets[i] : offsets[i + 1]].copy()))
    if rows:
        yield done()


def compare_shards(mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links among the members (key, node, class, n) of shards of several classes, each pair of different classes compared.

    Members of a shard's largest class are not compared with each other; they
    are dealt into blocks, the others too, and each block of the one meets each
    of the others in a unit of its own. A unit is at most two blocks, whatever
    the shard, and in all but unusual shards the others are one block.
    """
    classes = mixed.groupBy("key", "class").agg(F.count("*").alias("rows"))
    largest = classes.groupBy("key").agg(F.max_by("class", "rows").alias("most"))
    marked = mixed.join(largest, "key").withColumn("minor", (F.col("class") != F.col("most")).cast("int")).drop("most")
    blocks = lambda minor: F.greatest(
        F.ceil(F.sum(F.when(F.col("minor") == minor, F.greatest(F.lit(1 / BLOCK_ROWS), F.col("n") / BLOCK_HASHES)))), F.lit(1).cast("bigint")
    ).cast("int")
    sides = marked.groupBy("key").agg(blocks(0).alias("B"), blocks(1).alias("C"))
    dealt = marked.join(sides, "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), F.when(F.col("minor") == 1, F.col("C")).otherwise(F.col("B"))).cast("int"))
    unit = lambda kind, i, j, role: F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("unit"), role.alias("role"))
    zero, one, two = (F.lit(x) for x in range(3))
    asked = F.transform(F.sequence(F.lit(0), F.col("C") - 1), lambda c: unit(0, F.col("part"), c, zero))
    asks = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("B") - 1), lambda i: unit(0, i, F.col("part"), F.when(i == 0, two).otherwise(one))),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("C") - 1), lambda c: c != F.col("part")),
            lambda c: unit(1, F.least(c, F.col("part")), F.greatest(c, F.col("part")), F.when(c > F.col("part"), zero).otherwise(one)),
        ),
    )
    rows = dealt.select("node", "class", F.explode(F.when(F.col("minor") == 1, asks).otherwise(asked)).alias("u")).select("u.unit", "u.role", "node", "class")
    filled = rows.join(sets, "node").select("unit", "role", "node", "class", "a", "b", "hashes")
    return filled.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda batches: _units(similarity, batches), "src long, dst long")


def similar_links(nodes: DataFrame, texts: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """Links among distinct sets (node long, a, b, n, keys) that connect all pairs of this Jaccard similarity or more that share a shard.

    What shares no shard is done with after one count of the keys. In each star
    round a member of another class than its shard's representative is compared
    with it (with one representative of all its shards, so a node is compared
    once in a round), which joins groups of any size at a row for each member.
    What is left apart is compared within shards by a BK-tree (see
    ``compare_shards``). Every decision is by the sets themselves.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                hashes = [shingle_set(t.as_py(), width).view(np.int64) for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(hashes, pa.list_(pa.int64()))], names=["node", "a", "b", "hashes"])

    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = store(keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"), "shared")
    members = store(keyed.join(_small(shared, 16), "key").select("key", "node", "n"), "members")
    ends = store(members.select("node").distinct(), "ends")
    sets = store(texts.join(_small(ends, 16), "node", "left_semi").mapInArrow(hashed, "node long, a long, b long, hashes array<long>"), "sets")

    links, classes = [], None
    for turn in range(STAR_ROUNDS + 1):
        left = members.withColumn("class", F.col("node"))
        if classes is not None:
            left = members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        order = F.col("class").bitwiseXOR(F.lit(ORDERS[turn]))  # another order of the classes in each round
        shards = left.groupBy("key").agg(F.min(order).alias("first"), F.min_by("node", order).alias("lead"), F.min("class").alias("low"), F.max("class").alias("high"))
        mixed = store(left.join(shards.where("low != high").select("key", "first", "lead"), "key").select("key", "node", "n", "class", "first", "lead"), "mixed")
        members = mixed.select("key", "node", "n")  # a shard of one class is done with
        if turn < STAR_ROUNDS:
            pairs = mixed.where(order != F.col("first")).groupBy("node", "class").agg(F.min("first").alias("first"), F.min_by("lead", "first").alias("lead"))
            pairs = store(pairs.select(F.col("node").alias("src"), F.col("lead").alias("dst"), "class", F.col("first").bitwiseXOR(F.lit(ORDERS[turn])).alias("to"), "first"), "pairs")
            found = store(alike(pairs.select("src", "dst"), sets, similarity), "found")
            links.append(found)
            classes = store(joined_classes(classes, pairs.join(found, ["src", "dst"]).select("class", "to", "first")), "classes")
    links.append(cut(compare_shards(mixed.select("key", "node", "class", "n"), sets, similarity)))
    return _union(links)


def joined_classes(classes: DataFrame | None, steps: DataFrame) -> DataFrame:
    """(node, class) after the steps (class, to, first), each from a class to one whose place ``first`` in the order is before its own.

    Every class follows its first step, and the steps of the classes so reached, up to eight in all. Nodes of one
    class are linked, then; that nodes which are linked may still be in different classes only costs comparisons.
    Steps are stored each time, as a plan of all doublings would hold the first eight times over.
    """
    to = store(steps.groupBy("class").agg(F.min_by("to", "first").alias("to")), "steps")
    for _ in range(3):
        onward = to.select(F.col("class").alias("to"), F.col("to").alias("far"))
        to = store(to.join(onward, "to", "left").select("class", F.coalesce("far", "to").alias("to")), "steps")
    if classes is None:
        return to.select(F.col("class").alias("node"), F.col("to").alias("class"))
    old = classes.join(to, "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    new = to.select(F.col("class").alias("node"), F.col("to").alias("class"))  # classes of a single node had no row
    return old.unionByName(new.join(classes.select("node"), "node", "left_anti"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, one of each class of near duplicates: the first in the order of the table.

    Texts are alike if their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more, and classes are closed under that. Least hashes
    shard, fingerprints find the candidates, the sets decide. Null, empty and
    blank texts are one class. No id is needed: null, repeated or missing ids
    and any other columns do not matter.

    Rows are written once with number and signature. Equal sets collapse to
    one node before anything else, and only keys are dealt out for all nodes.
    Texts stay where they lie: what is looked up among them and what is left
    out at last is broadcast while it is measured to be small; beyond that the
    texts are merged with it.
    """
    small_batches(docs.sparkSession)
    number, sign = free_names(docs.columns, "_row", "_sign")
    marked = store(docs.withColumns({number: F.monotonically_increasing_id(), sign: signatures(F.col(text_col), width)}), "marked")
    own = [F.col(sign)[c].alias(c) for c in ("digest", "a", "b", "n", "keys")]
    nodes = store(marked.select(number, *own).groupBy("digest", "a", "b", "n", "keys").agg(F.min(number).alias("node")).drop("digest"), "nodes")
    texts = marked.select(F.col(number).alias("node"), F.col(sign)["a"].alias("a"), F.col(sign)["b"].alias("b"), F.col(text_col).alias("text"))
    linked = connected_components(similar_links(nodes, texts, similarity, width))
    kept = nodes.select("node").join(linked.where("node != root").select("node"), "node", "left_anti")
    dropped = store(marked.select(number).join(kept.select(F.col("node").alias(number)), number, "left_anti"), "dropped")
    return marked.join(_small(dropped, 16), number, "left_anti").select(*docs.columns)
