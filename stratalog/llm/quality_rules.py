"""Weak supervision over quality rules: they vote or abstain, expectation-maximisation estimates how far each is to be believed.

Dawid and Skene, "Maximum likelihood estimation of observer error-rates using
the EM algorithm"; Ratner et al., "Data programming".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import free_names, store
from .text import gram_hashes, small_batches, word_hashes

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
ENDS = ".!?:;\"'…。！？"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: What to delete for only the words with a letter (a byte of a non-ASCII character is taken for one), or with a mark, to be left.
NO_LETTER = bytes(set(range(128)) - {*UPPER, *LOWER, *SPACE.encode()})
NO_MARK = bytes(set(range(256)) - {*SYMBOLS.encode(), *b"!", *SPACE.encode()})


@dataclass
class Counts:
    """What the rules see of a text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int  #: lines with a word
    n_ended: int  #: of these, with closing punctuation
    n_distinct: int
    n_lettered: int  #: words with a letter
    n_upper: int
    n_lower: int
    n_marked: int  #: words that hold a symbol or a mark of exclamation


def count(text: str | None) -> Counts:
    if not text:
        return Counts(*[0] * 12)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    repeated = 0
    if n >= 3:
        grams = gram_hashes(word_hashes(words, n), 3)
        _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[back] > 1)
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[at + i] = True
        repeated = int(covered.sum())
    seen: set[str] = set()
    dup = lines = ended = 0
    for line in text.split("\n"):
        bare = line.strip(SPACE)
        if bare:
            lines += 1
            ended += bare[-1] in ENDS
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    upper, lower = (len(data) - len(data.translate(None, cased)) for cased in (UPPER, LOWER))
    return Counts(
        n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeated, lines, ended, len(set(words)),
        len(data.translate(None, NO_LETTER).split()), upper, lower, len(data.translate(None, NO_MARK).split()),
    )


def _vote(value: float, good: float, bad: float) -> int:
    """1 up to ``good``, -1 from ``bad``, else no vote; the other way round where good lies above bad."""
    if good > bad:
        value, good, bad = -value, -good, -bad
    return 1 if value <= good else -1 if value >= bad else 0


#: Each rule votes 1 (sound), -1 (poor) or 0 (abstains). Limits follow published heuristic filters, with room left to abstain.
RULES: dict[str, Callable[[Counts], int]] = {
    "symbols": lambda c: _vote(c.n_symbols / max(1, c.n_words), 0.03, 0.1),
    "marked_words": lambda c: _vote(c.n_marked / max(1, c.n_words), 0.1, 0.3),
    "duplicate_lines": lambda c: _vote(c.n_dup_lines / max(1, c.n_lines), 0.1, 0.3),
    "repetition": lambda c: _vote(c.n_repeat_words / max(1, c.n_words), 0.15, 0.3),
    "word_length": lambda c: 0 if not c.n_words else -1 if not 3 <= c.word_chars / c.n_words <= 12 else 1 if 3.5 <= c.word_chars / c.n_words <= 10 else 0,
    "letters": lambda c: _vote(c.n_lettered / max(1, c.n_words), 0.9, 0.8),
    "upper_case": lambda c: _vote(c.n_upper / max(1, c.n_upper + c.n_lower), 0.2, 0.5),
    "closed_lines": lambda c: _vote(c.n_ended / max(1, c.n_lines), 0.5, 0.1),
    "variety": lambda c: _vote(c.n_distinct / max(1, min(c.n_words, 400)), 0.3, 0.15),
}


@dataclass
class Model:
    prior: float  #: share of sound documents
    tables: np.ndarray  #: [rule, class (poor, sound), vote (-1, 0, 1)] probabilities

    @property
    def accuracies(self) -> np.ndarray:
        """[rule, class]: how often a vote, where one is given, is right."""
        given = self.tables[:, :, [0, 2]]
        share = given / given.sum(-1, keepdims=True)
        return np.stack([share[:, 0, 0], share[:, 1, 1]], -1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of sound for rows of votes; abstaining says nothing."""
        logs = np.log(self.accuracies)
        wrong = np.log1p(-self.accuracies)
        sound = np.log(self.prior) + np.where(votes == 1, logs[:, 1], np.where(votes == -1, wrong[:, 1], 0)).sum(-1)
        poor = np.log(1 - self.prior) + np.where(votes == -1, logs[:, 0], np.where(votes == 1, wrong[:, 0], 0)).sum(-1)
        return 1 / (1 + np.exp(np.clip(poor - sound, -500, 500)))


def fit(votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> Model:
    """EM over vote patterns (rows) with their counts.

    It starts from rules that rarely call a sound document poor and notice four poor ones in ten: each
    looks for one kind of defect. Pseudo-counts pull each accuracy there, in proportion to the rows, and a
    rule stays at least twice as likely to vote poor on a poor document as on a sound one: which class is
    which stays what the rules mean by it. No rows give the starting model.
    """
    rules = votes.shape[1]
    start = np.empty((rules, 2, 3))
    start[:, 0], start[:, 1] = (0.32, 0.2, 0.48), (0.04, 0.2, 0.76)
    model = Model(0.8, start)
    if not len(votes) or not weight.sum():
        return model
    strength = max(5.0, 0.01 * float(weight.sum()))
    for _ in range(rounds):
        p = model.posterior(votes)
        tables = np.empty_like(start)
        for k, share in enumerate((1 - p, p)):
            for v in (-1, 0, 1):
                tables[:, k, v + 1] = ((votes == v) * (weight * share)[:, None]).sum(0)
        tables += strength * start
        for k, low, high in ((1, 0.001, 0.3), (0, None, 0.99)):
            given = tables[:, k, 0] + tables[:, k, 2]
            floor = low or 2 * tables[:, 1, 0] / (tables[:, 1, 0] + tables[:, 1, 2])
            tables[:, k, 0] = np.clip(tables[:, k, 0], floor * given, high * given)
            tables[:, k, 2] = given - tables[:, k, 0]
        tables /= tables.sum(-1, keepdims=True)
        prior = float(np.clip((weight * p).sum() / weight.sum(), 0.05, 0.95))
        done = abs(prior - model.prior) < 1e-9 and np.abs(tables - model.tables).max() < 1e-9
        model = Model(prior, tables)
        if done:
            break
    return model


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts, base test, votes, posterior quality and verdict of every row.

    Columns: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, posterior and a vote column for each
    rule (``vote_symbols`` and so on). kept is false where base_failed,
    otherwise posterior >= threshold. A null text has no words, so it fails the
    base test, as an empty one does. Repeated rows count as often as they
    stand; null ids and other columns change nothing, and result columns step
    aside where the id has their name.

    One pass counts and votes. EM needs no documents, only how often each
    pattern of votes occurs among those that pass the base test: at most three
    to the power of the number of rules rows, whatever the corpus, counted over
    all of it. Posteriors go back as a table of these patterns, whose size is
    bounded in the same way.
    """
    spark, names = docs.sparkSession, list(RULES)
    small_batches(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                c = count(text.as_py())
                pattern = 0
                for rule in RULES.values():
                    pattern = 3 * pattern + rule(c) + 1
                failed = c.n_words < min_words or 100 * c.n_repeat_words > max_repeat_percent * c.n_words
                rows.append((c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, failed, pattern))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))],
                names=["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_pattern"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, _pattern int"
    seen = store(docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(scan, schema), "votes")

    tally = seen.where(~F.col("base_failed")).groupBy("_pattern").count().collect()
    patterns = np.array([r["_pattern"] for r in tally], np.int64)
    votes = _votes(patterns, len(names))
    model = fit(votes, np.array([r["count"] for r in tally], float))
    scores = [(int(p), float(q)) for p, q in zip(patterns, model.posterior(votes), strict=True)]
    known = F.broadcast(spark.createDataFrame(scores, "_pattern int, posterior double"))

    digit = lambda i: (F.floor(F.col("_pattern") / F.lit(3 ** (len(names) - 1 - i))) % 3 - 1).cast("int")
    columns = {
        **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")},
        "kept": ~F.col("base_failed") & (F.col("posterior") >= threshold),
        "posterior": F.when(~F.col("base_failed"), F.col("posterior")),
        **{f"vote_{n}": digit(i) for i, n in enumerate(names)},
    }
    aliases = free_names([id_col], *columns)
    return seen.join(known, "_pattern", "left").select(F.col("_id").alias(id_col), *(c.alias(a) for c, a in zip(columns.values(), aliases, strict=True)))


def _votes(patterns: np.ndarray, rules: int) -> np.ndarray:
    powers = 3 ** np.arange(rules - 1, -1, -1)
    return patterns[:, None] // powers % 3 - 1
