"""Packing tokenised documents into sequences by bin completion.

Korf, "An improved algorithm for optimal bin packing"; Martello and Toth,
"Knapsack Problems", chapter 8. Lengths are whole numbers up to the sequence
length, so a corpus of any size is a histogram of that many counts, and a
solution is a short list of fillings with the number of sequences filled so.
"""

from __future__ import annotations

import functools
import json
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from types import ModuleType
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import free_names, store
from .text import small_batches

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Dual feasible functions that the lower bound tries.
DUAL = 20
Filling = tuple[int, ...]  #: lengths in one sequence, longest first


# --- the packing problem, on histograms -------------------------------------------------


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, a whole group of equally filled sequences at a time."""
    open_: dict[int, list[tuple[Filling, int]]] = {}
    done: list[tuple[Filling, int]] = []

    rooms = 0  # bit r: a sequence with room r is open

    def put(filling: Filling, room: int, times: int) -> None:
        nonlocal rooms
        if times:
            (open_.setdefault(room, []) if room else done).append((filling, times))
            rooms |= 1 << room if room else 0

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            wide = rooms >> s
            room = s + (wide & -wide).bit_length() - 1
            if not wide:
                each = size // s
                put((s,) * each, size - each * s, n // each)
                if n % each:
                    put((s,) * (n % each), size - n % each * s, 1)
                n = 0
                continue
            filling, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms ^= 1 << room
            each = room // s
            full = min(times, n // each)
            put(filling + (s,) * each, room - each * s, full)
            n, times = n - full * each, times - full
            if times and n:
                put(filling + (s,) * n, room - n * s, 1)
                n, times = 0, times - 1
            put(filling, room, times)
    return done + [x for group in open_.values() for x in group]


def lower_bound(counts: dict[int, int], size: int) -> int:
    """No packing has fewer sequences: Martello and Toth's L2 or a dual feasible function of Fekete and Schepers, whichever says more.

    The k-th of these functions counts a length above i / (k + 1) of a sequence as i / k of it, for as many
    such lengths as fit together are i of k too; two documents of just over a third, say, fill a sequence.
    """
    n = np.zeros(size + 1, np.int64)
    for s, times in counts.items():
        n[s] = times
    lengths = np.arange(size + 1)
    many, joint, half = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)]), size // 2
    k = np.arange(half + 1)
    large = many[size + 1] - many[size - k + 1]  # longer than size - k
    middle = many[size - k + 1] - many[half + 1]  # of these no two fit together, but they leave room
    room = size * middle - (joint[size - k + 1] - joint[half + 1])
    small = joint[half + 1] - joint[k]  # k up to half a sequence
    each = large + middle + np.maximum(0, -(-(small - room) // size))
    best = max(each.max(), -(-joint[-1] // size))
    for k in range(1, DUAL + 1):
        share = np.where((k + 1) * lengths % size == 0, lengths * k, (k + 1) * lengths // size * size)  # times k * size
        best = max(best, -(-int((n * share).sum()) // (k * size)))
    return int(best)


def completions(counts: dict[int, int], room: int, most: int | None, steps: int | None) -> list[Filling]:
    """Undominated fillings of the room beside a sequence's largest document, fullest first.

    A filling is dominated if another packs no worse whatever follows: if a
    document still fits beside it, if one of its documents can give way to a
    longer one, or if two of them can give way to one of their joint length.
    With None for ``most`` and ``steps`` all are found. Where the steps end
    before an undominated one is found, the first filling of any kind stands.
    """
    sizes = sorted((s for s in counts if s <= room), reverse=True)
    reach, bits = [0] * (len(sizes) + 1), 1
    reach[len(sizes)] = 1
    mask = (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        step = min(counts[sizes[i]], room // sizes[i])
        done, width = 0, 1
        while done < step:  # sums with up to ``step`` documents of this length, by doubling
            take = min(width, step - done)
            bits |= bits << (take * sizes[i]) & mask
            done, width = done + take, width * 2
        reach[i] = bits
    found: list[Filling] = []
    full: list[Filling] = []
    left = [steps]

    def over() -> bool:
        return (left[0] is not None and left[0] < 0) or (most is not None and len(found) >= most)

    def undominated(filling: Filling, slack: int) -> bool:
        used = Counter(filling)
        free = lambda s: counts.get(s, 0) > used[s]
        if any(free(s) for s in range(1, slack + 1)) or any(free(b) for a in used for b in range(a + 1, a + slack + 1)):
            return False
        own = list(filling)
        return not any(free(own[i] + own[j]) for i in range(len(own)) for j in range(i))

    def extend(i: int, room: int, filling: Filling, target: int) -> None:
        if target == 0:
            full[:] = full or [filling]
            if undominated(filling, slack):
                found.append(filling)
            return
        if left[0] is not None:
            left[0] -= 1
        for j in range(i, len(sizes)):
            s = sizes[j]
            if s > target:
                continue
            if over() and full or not reach[j] >> target & 1:
                return
            for n in range(min(counts[s], target // s), 0, -1):
                if reach[j + 1] >> (target - n * s) & 1:
                    extend(j + 1, room, filling + (s,) * n, target - n * s)
                    if over() and full:
                        return

    for target in range(room, -1, -1):
        if bits >> target & 1:
            slack = room - target
            extend(0, room, (), target)
            if over():
                break
    return found or full


@dataclass
class Search:
    size: int
    bound: int
    best: list[tuple[Filling, int]]
    nodes: int | None
    fillings: int | None
    steps: int | None
    path: list[tuple[Filling, int]] = field(default_factory=list)
    seen: dict[frozenset, int] = field(default_factory=dict)

    @property
    def used(self) -> int:
        return sum(n for _, n in self.best)

    def run(self, counts: dict[int, int], spare: int) -> None:
        """Branch on the fillings around the largest document; ``spare`` is the waste at which the incumbent is matched.

        A filling is taken as often as the counts allow on one branch and once on another: the first soon gives
        good packings, the second makes the search complete.
        """
        stack = [(counts, 0, 0, 0, None)]
        while stack and self.nodes != 0 and self.used > self.bound:
            counts, bins, waste, depth, step = stack.pop()
            if self.nodes is not None:
                self.nodes -= 1
            del self.path[depth - 1 if step else 0 :]
            if step:
                self.path.append(step)
            if not counts:
                if bins < self.used:
                    self.best = list(self.path)
                continue
            if waste >= self.used * self.size - spare or bins + lower_bound(counts, self.size) >= self.used:
                continue
            state = frozenset(counts.items())
            if self.seen.get(state, bins + 1) <= bins:
                continue
            if len(self.seen) < 1_000_000:
                self.seen[state] = bins
            rest = best_fit(counts, self.size)
            total = bins + sum(n for _, n in rest)
            if total < self.used:
                self.best = self.path + rest
            top = max(counts)
            after = dict(counts)
            after[top] -= 1
            if not after[top]:
                del after[top]
            branches = []
            for option in completions(after, self.size - top, self.fillings, self.steps):
                filling = (top, *option)
                need = Counter(filling)
                often = min(counts[s] // n for s, n in need.items())
                for times in (often, 1) if often > 1 else (1,):
                    left = {s: n - times * need[s] for s, n in counts.items() if n > times * need[s]}
                    lost = waste + times * (self.size - sum(filling))
                    branches.append((times < often, len(branches), (left, bins + times, lost, depth + 1, (filling, times))))
            stack += [branch for *_, branch in sorted(branches, key=lambda x: x[:2], reverse=True)]


def pack(
    counts: dict[int, int], size: int, nodes: int | None = 200, fillings: int | None = 6, steps: int | None = 500
) -> tuple[list[tuple[Filling, int]], int]:
    """Fillings with how often each is used, and a lower bound of the number of sequences.

    Best-fit decreasing is the first incumbent; if it meets the lower bound, it
    is optimal. Otherwise bin completion looks for better ones: it branches on
    the undominated fillings around the largest document left, packs the rest by
    best fit for new incumbents, and prunes what has wasted as much as the
    incumbent leaves to waste or what the bound of the rest shows to be no
    better. The search looks at ``nodes`` branches, at ``fillings`` fillings
    beside each largest document and takes ``steps`` steps to find these; the
    packing is whole either way. None for all three lifts the limits: the
    search then ends with a proof, as long as that may take.
    """
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= size for s in counts):
        raise ValueError("lengths must lie between 1 and the sequence length")
    search = Search(size, lower_bound(counts, size), best_fit(counts, size), nodes, fillings, steps)
    if search.used > search.bound:
        # incumbent used * size - total is wasted there; one sequence fewer leaves size less
        search.run(counts, sum(s * n for s, n in counts.items()) + size - 1)
    return search.best, search.bound


# --- tokens ------------------------------------------------------------------------------


def _process_cache() -> ModuleType:
    """State that outlives a task in a Python worker."""
    return sys.modules.setdefault("_stratalog_process_cache", ModuleType("_stratalog_process_cache"))


class Tokens:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    ``data`` is the content of a file of the tokenizers library, whose ids these
    are: with what the file says on added tokens, but none added at the ends of
    a text. Where it holds plain byte-level BPE whose ids rank the merges,
    tiktoken gives the same ids in less than half the time and takes the texts
    in which no added token stands; all others are left to tokenizers.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, data: bytes):
        held = json.loads(data)
        self.data, self.fast = data, None
        self.added = tuple(t["content"] for t in held.get("added_tokens") or ())
        ranks = self._ranks(held)
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("packing", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self) -> Tokenizer:
        """Loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_buffer(self.data)

    @staticmethod
    def _ranks(held: dict) -> dict[bytes, int] | None:
        """Token bytes -> id, if ids order the merges and nothing else changes the text."""
        model, split = held["model"], held.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or odd or held.get("normalizer"):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        vocab = model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(merged) + 256 != len(vocab) or (merged and merged[0] != 256):
            return None
        return {bytes(byte_of[c] for c in token): rank for token, rank in vocab.items()}

    def of(self, text: str | None) -> np.ndarray:
        """Ids of the text and the id 0 that ends every document."""
        text = text or ""
        if self.fast and not any(map(text.__contains__, self.added)):
            return np.array([*self.fast.encode_ordinary(text), 0], "<u4")
        return np.array([*self.slow.encode(text, add_special_tokens=False).ids, 0], "<u4")


def tokens_of(data: bytes) -> Tokens:
    """The tokenizer of this content, made once in a Python worker."""
    cache, mark = _process_cache(), zlib.crc32(data)
    if getattr(cache, "tokens_mark", None) != (len(data), mark):
        cache.tokens, cache.tokens_mark = Tokens(data), (len(data), mark)
    return cache.tokens


def pieces_of(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    head = length % size if length > size else length
    cuts = [0, *range(head, length, size)] if head and head < length else list(range(0, length, size))
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], length], strict=True)]


# --- on a corpus -------------------------------------------------------------------------


def pack_documents(
    docs: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    nodes: int | None = 200, fillings: int | None = 6, steps: int | None = 500,
) -> DataFrame:
    """One row for each piece of a document: where it comes from and where it lies in which sequence.

    Columns: ``id_col``, piece (from 0), start, length, ids_crc32, sequence_id,
    offset, and with ``with_ids`` the token ids themselves. A document is its
    token ids and the id 0; only one that is longer than ``size`` is cut, into
    pieces of ``size``, of which the first may be shorter. A null text is an
    empty one: the id 0 alone. Rows with equal or null ids are documents of
    their own. An empty table gives no rows. Where the id column has the name
    of another column of the result, that one gets an underscore more.

    Texts are read once, where they lie. The driver gets a histogram of at
    most ``size`` counts, packs it (see ``pack``, also for ``nodes``,
    ``fillings`` and ``steps``) and sends back the fillings. Pieces of one
    length are alike to the packing, so each piece needs only its rank among
    them: its number within its task plus where the task starts, which are sums
    over a table with a row for each task and length. Rows of pieces, without
    their texts, meet that table in a join that adaptive execution can split; no
    length, however common, gathers in one task. The tokenizer is broadcast: its
    file need not lie on the executors.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = spark.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    piece_, start_, length_, crc_, ids_, sequence_, offset_ = free_names([id_col], "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
    slim = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    ids = ", ids array<long>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, lane = tokens_of(tokenizer.value), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            kept: list[list[int]] = []
            for at, text in enumerate(batch.column(1)):
                data = tokens.of(text.as_py())
                for piece, (start, length) in enumerate(pieces_of(len(data), size)):
                    own = data[start : start + length]
                    rows.append((at, piece, start, length, zlib.crc32(own), seen[length], lane))
                    seen[length] += 1
                    if with_ids:
                        kept.append(own.astype(np.int64))
            at, piece, start, length, crc, local, own = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 7
            columns = [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc, local)), pa.array(own.astype(np.int32))]
            names = ["_id", "piece", "start", "length", "ids_crc32", "_local", "_lane"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.int64()))] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, _local long, _lane int{ids}"
    pieces = store(slim.mapInArrow(cut, schema), "pieces")

    ends = pieces.groupBy("length", "_lane").agg((F.max("_local") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("length", "_lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    counts = {r["length"]: r["n"] for r in ends.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    packing, _ = pack(counts, size, nodes, fillings, steps)
    plan = spark.sparkContext.broadcast(_places(packing))

    ranked = pieces.join(starts, ["length", "_lane"]).withColumn("_rank", F.col("_start") + F.col("_local"))
    columns = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, batch.num_columns - 1))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                first, base, each, inner = plan.value[int(n)]
                r = rank[own]
                k = np.searchsorted(first, r, side="right") - 1
                within = r - first[k]
                sequence[own] = base[k] + within // each[k]
                offset[own] = inner[k] + within % each[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    out = f"_id {kind}, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long"
    names = [id_col, piece_, start_, length_, crc_, *([ids_] if with_ids else []), sequence_, offset_]
    return ranked.select(*columns, "_rank").mapInArrow(place, out).toDF(*names)


def _places(fillings: list[tuple[Filling, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, documents a sequence and first offset of every filling that holds it."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for filling, times in fillings:
        inner = 0
        for s, n in sorted(Counter(filling).items(), reverse=True):
            out.setdefault(s, []).append((used[s], base, n, inner))
            used[s] += n * times
            inner += n * s
        base += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in out.items()}
