"""Benchmark decontamination by winnowing: fingerprints of texts and benchmark are joined, and hits extended on the words themselves.

Schleimer, Wilkerson and Aiken, "Winnowing: local algorithms for document
fingerprinting". Of the hashes of the k-word grams in every run of w
consecutive grams the least is kept; any span of w + k - 1 words that two texts
share then has a kept gram in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import free_names, store
from .text import alnum_words, gram_hashes, mix, small_batches, word_hashes

WINDOW = 10
GRAM = 5
CHUNK_WORDS = 200_000
#: Bits for each benchmark fingerprint in the map that goes to the scan, and the most the map has in all (8 MB).
BITS_EACH, MAP_BITS = 64, 1 << 26
#: Benchmark fingerprints up to this size are broadcast to the candidates, more are merged with them.
BROADCAST_BYTES = 32 << 20

_AROUND = pa.list_(pa.binary())
_FOUND = pa.list_(pa.struct([("print", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("left", _AROUND), ("right", _AROUND)]))
_FOUND_SQL = "array<struct<print: long, n: int, at: int, left: array<binary>, right: array<binary>>>"


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions kept: those that hold the least hash of some run of ``width`` grams."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    n = len(grams) - width + 1
    least = grams[:n].copy()
    for i in range(1, width):
        np.minimum(least, grams[i : i + n], out=least)
    kept = np.zeros(len(grams), bool)
    for i in range(width):
        kept[i : i + n] |= grams[i : i + n] == least
    return np.flatnonzero(kept)


def prints_of(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and fingerprints in a sequence of word hashes: winnowed grams for whole windows, all runs of n words for shorter ones."""
    if n == WINDOW:
        grams = gram_hashes(h, GRAM)
        at = winnow(grams, n - GRAM + 1)
        grams = grams[at]
    else:
        grams = gram_hashes(h, n)
        at = np.arange(len(grams))
    return at, mix(grams + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))


def around(words: list[bytes], at: int, n: int) -> tuple[list[bytes], list[bytes]]:
    """The words before a fingerprint's place, nearest first, and those from it on, as far as a window around it can reach."""
    if n < WINDOW:
        return [], words[at : at + n]
    return words[max(0, at - WINDOW + GRAM) : at][::-1], words[at : at + WINDOW]


def benchmark_prints(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(print, n, left, right, item): the fingerprints of every item, with the words around."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = alnum_words(text.as_py())
                n = min(len(words), WINDOW)
                if not n:
                    continue
                at, prints = prints_of(word_hashes(words, len(words)), n)
                sides = [around(words, int(i), n) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints.view(np.int64)), pa.array([n] * len(at), pa.int32()), pa.array([x for x, _ in sides], _AROUND), pa.array([y for _, y in sides], _AROUND), pa.array([item.as_py()] * len(at), pa.string())],
                    names=["print", "n", "left", "right", "item"],
                )

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col))
    return rows.mapInArrow(scan, "print long, n int, left array<binary>, right array<binary>, item string").distinct()


def print_map(prints: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit map of the fingerprints, of bounded size, and the window lengths there are.

    What the map does not hold is in no item. The more fingerprints there are
    beyond its size, the more others it lets through, which costs rows in the
    join and no hit.
    """
    lengths = {r["n"]: r["k"] for r in prints.groupBy("n").agg(F.count("*").alias("k")).collect()}
    bits = min(MAP_BITS, max(1 << 16, 1 << (BITS_EACH * sum(lengths.values())).bit_length()))
    place = F.col("print").bitwiseAND(bits - 1)
    parts = prints.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(print & {min(63, bits - 1)} as int))").alias("bit"))
    rows = parts.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most MAP_BITS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64), sorted(lengths)


class Scanner:
    """Finds the places in texts whose fingerprints the map holds."""

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths = bits, lengths

    def held(self, prints: np.ndarray) -> np.ndarray:
        place = prints & np.uint64(len(self.bits) * 64 - 1)
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[dict]]]:
        """Number of words and candidates of each text."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(alnum_words(text))
            size += len(held[-1])
            if size >= CHUNK_WORDS:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def _chunk(self, docs: list[list[bytes]]) -> Iterator[tuple[int, list[dict]]]:
        lengths = np.array([len(d) for d in docs], np.int64)
        begins, owner = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(docs)), lengths)
        h = word_hashes(chain.from_iterable(docs), len(owner))
        found: dict[int, list[dict]] = {}
        for n in self.lengths:
            at, prints = prints_of(h, n)
            some = self.held(prints)
            at, prints = at[some], prints[some].view(np.int64)
            inside = owner[at] == owner[at + min(n, GRAM) - 1] if len(at) else np.zeros(0, bool)
            for i, p in zip(at[inside].tolist(), prints[inside].tolist(), strict=True):
                doc = int(owner[i])
                own = i - int(begins[doc])
                left, right = around(docs[doc], own, n)
                found.setdefault(doc, []).append({"print": p, "n": n, "at": own, "left": left, "right": right})
        for i, d in enumerate(docs):
            yield len(d), found.get(i, [])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _equal(a: str, b: str, most: int) -> Column:
    """How many elements two arrays share from their beginning on."""
    both = F.least(F.size(a), F.size(b))
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: (k <= both) & (F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k))))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Every row of docs as (columns to keep, _digest, _words), and (_digest, spans, items) of the texts with hits.

    A window is 10 consecutive words of an item; a shorter item is one window
    if it has a word. spans are (start, end) of occurrences in words, distinct
    but not merged; items are sorted. Null and empty texts have no words, so
    nothing in them is hit and, as items, they hit nothing. Null item ids count
    as the empty string. Items with equal ids are one item.

    The scan sends on only places whose fingerprints a bit map of bounded size
    holds, with the few words around them; no text moves. These candidates are
    joined with the benchmark's fingerprints, equal texts once, and extended as
    far as the words agree: hashes find, words decide. The driver gets the map
    and nothing that grows with the benchmark or the documents.
    """
    small_batches(docs.sparkSession)
    prints = store(benchmark_prints(benchmark, item_col, item_text_col), "prints")
    bits, lengths = print_map(prints)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, lengths)
        for batch in batches:
            rows = list(scanner.scan(batch.column(batch.num_columns - 1).to_pylist()))
            counts, found = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(found, _FOUND)], names=[*(f"_k{i}" for i in range(len(keep))), "_digest", "_words", "_found"])

    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    kinds = ", ".join(f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    schema = f"{kinds}{', ' if kinds else ''}_digest binary, _words long, _found {_FOUND_SQL}"
    seen = docs.select(*kept, _digest(F.col(text_col)).alias("_digest"), F.col(text_col))
    seen = store((seen if keep else seen.where(F.col(text_col).isNotNull())).mapInArrow(scan, schema), "scanned")

    places = seen.where("size(_found) > 0").select("_digest", "_found").dropDuplicates(["_digest"]).select("_digest", F.explode("_found").alias("f"))
    places = places.select("_digest", "f.print", "f.n", "f.at", F.col("f.left").alias("left_"), F.col("f.right").alias("right_"))
    size = prints.count() * 32 * (WINDOW + GRAM)
    before, after = _equal("left", "left_", WINDOW - GRAM), _equal("right", "right_", WINDOW)
    hits = places.join(F.broadcast(prints) if size <= BROADCAST_BYTES else prints.hint("merge"), ["print", "n"]).withColumns({"_before": before, "_after": after})
    hits = hits.where((F.col("_before") + F.col("_after") >= F.col("n")) & (F.col("_after") >= F.least("n", F.lit(GRAM))))
    hits = hits.select("_digest", "item", F.struct((F.col("at") - F.col("_before")).alias("start"), (F.col("at") + F.col("_after")).alias("end")).alias("span"))
    found = hits.groupBy("_digest").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    return seen.drop("_found"), found


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs; see find_contamination."""
    seen, found = find_contamination(docs, benchmark, text_col, keep=(id_col,), **options)
    names = free_names([id_col], "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("reached"))
    step = lambda s, x: F.struct((s["covered"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["reached"]))).alias("covered"), F.greatest(s["reached"], x["end"]).alias("reached"))
    totals = store(
        found.select("_digest", F.aggregate("spans", start, step)["covered"].alias("_hit"), F.size("items").cast("long").alias("_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("_sha")), "hits"
    )
    hit = F.coalesce("_hit", F.lit(0).cast("long"))
    return seen.join(_small(totals), "_digest", "left").select(
        F.col("_k0").alias(id_col),
        F.col("_words").alias(names[0]),
        hit.alias(names[1]),
        F.coalesce("_items", F.lit(0).cast("long")).alias(names[2]),
        F.coalesce("_sha", F.sha2(F.lit("").cast("binary"), 256)).alias(names[3]),
        (hit > 0).alias(names[4]),
    )


def _small(texts: DataFrame) -> DataFrame:
    """A table keyed by digest with the hint that its measured size calls for."""
    return F.broadcast(texts) if texts.count() * 256 <= BROADCAST_BYTES else texts.hint("merge")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with the columns of docs.

    Hits hang on a text's digest, so rows need no key, and texts stay where they
    lie while the digests of those to drop are few enough to be broadcast.
    """
    _, found = find_contamination(docs, benchmark, text_col, **options)
    bad, mark = store(found.select("_digest"), "contaminated"), free_names(docs.columns, "_digest")[0]
    return docs.withColumn(mark, _digest(F.col(text_col))).join(_small(bad.select(F.col("_digest").alias(mark))), mark, "left_anti").select(*docs.columns)
