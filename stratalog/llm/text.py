"""Byte-level text helpers shared by the operators; contracts are stated on bytes and code points, so none depends on a locale."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import SparkSession

#: A-Z to a-z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and blanks every ASCII byte that is neither a digit nor a letter.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def lower_words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and \\t-\\r, A-Z lower-cased; bytes.split() parts on exactly these."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


#: Rows of an Arrow batch where the session leaves that at its default of 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Set Arrow batches of ``BATCH_ROWS`` rows in a session that has not chosen a size itself.

    Texts are kilobytes each, so a batch of the default size is tens of megabytes, several times over in the
    JVM and in each Python worker, which keep what they have once allocated.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def word_hashes(words: Iterable[bytes], n: int, seed: int = 17) -> np.ndarray:
    """64-bit hashes of n words. Hashing a word anew takes no longer than finding it in a dictionary of words, and keeps nothing."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out
