"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Rendle, "Factorization machines". A document's score sums a weight for each
feature and a product of low-rank vectors for each pair, which the
sum-of-squares identity gives in time linear in the features.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, small_batches, word_hashes

#: Hashed word features; structure and metadata features have places of their own behind them.
BUCKETS = 1 << 15
#: Features of documents that are scored at once.
BATCH_FEATURES = 1 << 15
#: Upper limits of the bins of each structure statistic.
BINS = np.array([0.005, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
LOG_BINS = np.array([1.5, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14])
_BINS, _LOG_BINS = BINS.tolist(), LOG_BINS.tolist()
STATISTICS = ("symbols", "marked", "lettered", "upper", "digits", "distinct", "top_word", "bigrams", "dup_lines", "ended", "word_length", "words")
SYMBOLS = b"#*$%&|<>!=+~^_@{}[]\\"
_SPACE = b" \t\n\v\f\r"
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_NO_LETTER = bytes(set(range(256)) - {*_LETTERS, *_SPACE})
_NO_MARK = bytes(set(range(256)) - {*SYMBOLS, *_SPACE})
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"


def statistics(text: str, data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Shares between 0 and 1, then mean word length and log of the number of words; ``data`` is the text, words and their counts are in lower case."""
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    without = lambda drop: len(data) - len(data.translate(None, drop))
    chars = max(1, len(data) - without(_SPACE))
    letters = max(1, without(_LETTERS))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    return [
        without(SYMBOLS) / chars, len(data.translate(None, _NO_MARK).split()) / n, len(data.translate(None, _NO_LETTER).split()) / n,
        without(_UPPER) / letters, without(_DIGITS) / chars, len(counts) / n if n < 400 else min(1.0, len(counts) / 400), max(counts.values()) / n,
        1 - len(pairs) / (n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?:;" for x in lines) / len(lines),
        chars / n, float(np.log1p(n)),
    ]


def features(text: str | None, metadata: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words by the root of their count, together of length one; statistics and metadata as one of their bins."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.translate(LOWER).split()
    counts = Counter(words)
    known = (word_hashes(counts, len(counts), 29) % np.uint64(BUCKETS)).astype(np.int64)
    at, back = np.unique(known, return_inverse=True)
    times = np.bincount(back, np.fromiter(counts.values(), np.float64, len(counts)), len(at))
    value = np.sqrt(times)
    value /= max(1e-9, np.sqrt(len(words)))
    stats, width = statistics(text, data, words, counts), len(BINS) + 1
    own = [BUCKETS + i * width + bisect_left(_LOG_BINS if i >= len(stats) - 2 else _BINS, x) for i, x in enumerate(stats)]
    for i, x in enumerate(metadata, len(stats)):
        missing = x is None or x != x
        own.append(BUCKETS + i * width + (len(LOG_BINS) + 1 if missing else bisect_left(_LOG_BINS, float(np.log1p(max(0.0, x))))))
    return np.concatenate([at, own]), np.concatenate([value, np.ones(len(own))])


@dataclass
class Machine:
    """score = bias + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows laid end to end, and their sums of x_i v_i."""
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.bias + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(at, x, starts)[0], -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, rank: int = 6, rounds: int = 12, rate: float = 0.08, decay: float = 1e-4, batch: int = 64) -> Machine:
    """Logistic loss by AdaGrad over batches in a fixed order; classes weigh the same. No rows, or one class: that class's constant."""
    order = np.random.default_rng(11)
    m = Machine(0.0, np.zeros(size), order.normal(0, 0.01, (size, rank)))
    share = labels.mean() if len(labels) else 1.0
    if not len(rows) or share in (0.0, 1.0):
        m.bias = 4.0 if share else -4.0
        m.v[:] = 0
        return m
    weigh = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(rounds):
        for chosen in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            at = np.concatenate([rows[i][0] for i in chosen])
            x = np.concatenate([rows[i][1] for i in chosen])
            lengths = np.array([len(rows[i][0]) for i in chosen])
            raw, sums = m.raw(at, x, np.cumsum(lengths) - lengths)
            slope = (1 / (1 + np.exp(-np.clip(raw, -60, 60))) - labels[chosen]) * weigh[chosen] / len(chosen)
            each = np.repeat(slope, lengths)
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, each * x, len(used)) + decay * m.w[used]
            terms = (each * x)[:, None] * (np.repeat(sums, lengths, 0) - m.v[at] * x[:, None])
            dv = np.stack([np.bincount(back, terms[:, k], len(used)) for k in range(m.v.shape[1])], 1) + decay * m.v[used]
            db = slope.sum()
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += db * db
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.bias -= rate * db / np.sqrt(gb)
    return m


def _metadata(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in columns]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: Sequence[str] = (), sample: int = 6_000, rank: int = 6
) -> Machine:
    """A machine trained on at most ``sample`` labelled rows: those whose ids hash lowest.

    Rows without an id, a label or a document are left out. An id with several
    labels or several documents counts once for each pair, up to the bound.
    Only features of the sample reach the driver.
    """
    small_batches(docs.sparkSession)
    size = BUCKETS + (len(STATISTICS) + len(metadata)) * (len(BINS) + 1)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(m.alias(f"_m{i}") for i, m in enumerate(_metadata(metadata))))
    joined = texts.join(F.broadcast(chosen), "_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = b.to_pydict()
            names = [n for n in table if n.startswith("_m")]
            made = [features(t, [table[n][i] for n in names]) for i, t in enumerate(table["_text"])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(table["_label"], pa.int32()), pa.array([a.astype("<i4").tobytes() for a, _ in made], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary())],
                names=["_id", "_label", "_at", "_x"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    encoded = joined.mapInArrow(encode, f"_id {kind}, _label int, _at binary, _x binary")
    rows = encoded.orderBy(F.xxhash64("_id"), "_id", "_label", "_at").limit(sample).select("_label", "_at", "_x").collect()
    made = [(np.frombuffer(r["_at"], "<i4").astype(np.int64), np.frombuffer(r["_x"], "<f4").astype(float)) for r in rows]
    return train(made, np.array([r["_label"] for r in rows], float), size, rank)


def score_column(docs: DataFrame, machine: Machine, text_col: str = "text", metadata: Sequence[str] = ()) -> Column:
    """The score of each row, between 0 and 1; null texts score as empty ones. The machine's size is fixed, so it is broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Machine(machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = shared.value
        for texts, *more in batches:
            out = np.empty(len(texts))
            columns = [c.tolist() for c in more[: len(metadata)]]  # a missing number is NaN, which is missing to features too
            rows: list[tuple[np.ndarray, np.ndarray]] = []
            begin = held = 0
            for i, text in enumerate(texts):
                rows.append(features(text, [c[i] for c in columns]))
                held += len(rows[-1][0])
                if held > BATCH_FEATURES or i + 1 == len(texts):
                    lengths = np.array([len(at) for at, _ in rows])
                    out[begin : i + 1] = m.score(np.concatenate([at for at, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(lengths) - lengths)
                    begin, held, rows = i + 1, 0, []
            yield pd.Series(out)

    # a single column would come without its tuple
    return score(F.col(text_col), *(_metadata(metadata) or [F.lit(None).cast("double")]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: Sequence[str] = (), threshold: float = 0.3, sample: int = 6_000
) -> DataFrame:
    """id, held_out, score and predicted of every row.

    held_out marks the rows whose id, as text, has a crc32 divisible by five;
    no label of theirs is learnt from. A null id counts as the empty text. The
    score depends on the text and the named metadata alone.
    """
    held = lambda column: F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0
    machine = fit(docs, labels.where(~held(F.col(id_col))), id_col, text_col, label_col, metadata, sample)
    scored = docs.select(F.col(id_col), held(F.col(id_col)).alias("held_out"), score_column(docs, machine, text_col, metadata).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: Sequence[str] = (), threshold: float = 0.3, sample: int = 6_000
) -> DataFrame:
    """The rows of docs that score ``threshold`` or more, with the columns of docs; labels of the held-out fifth stay unused here too."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    machine = fit(docs, labels.where(~held), id_col, text_col, label_col, metadata, sample)
    return docs.where(score_column(docs, machine, text_col, metadata) >= threshold)
