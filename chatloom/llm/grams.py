"""Words and rolling hashes of texts as numpy arrays, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Hashed words a worker remembers before it starts anew.
REMEMBERED = 200_000


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; keeps what it has met."""

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of characters other than the space and U+0009 to U+000D: what splitting bytes at white space
    means. Lower-casing bytes touches A-Z only."""
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive words; needs at least ``width`` of them."""
    n = len(hashes) - width + 1
    h = mixed(hashes + np.uint64(salt)) if salt else hashes
    out = np.zeros(n, np.uint64)
    if width <= 8:
        for k in range(width):
            out = out * BASE + h[k:k + n]
    else:
        powers = _powers(len(h) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:len(h)], dtype=np.uint64)])
        # the sum of the window, taken back to its own start by the inverse power
        out = (sums[width:] - sums[:n]) * _powers(len(h) + 1, inverse=True)[:n]
    return mixed(out)


_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    known = _POWERS.get(inverse)
    if known is None or len(known) < n:
        base = pow(int(BASE), -1, 1 << 64) if inverse else int(BASE)
        size = max(n, 4096) * 2
        with np.errstate(over="ignore"):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            known = _POWERS[inverse] = np.cumprod(factors, dtype=np.uint64)
    return known


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """The texts of about ``rows`` rows, those with the least hash of id and text. Only hashes are sorted, no text is shuffled."""
    hashed = docs.filter("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h"))
    edge = hashed.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return hashed.filter(F.col("h") <= F.lit(edge).cast("long")).select("text")


def frequent_grams(docs: DataFrame, width: int, lower: bool, sample: int = 4000, least: int = 4, most: int = 200_000) -> np.ndarray:
    """Sorted hashes of the word n-grams that at least ``least`` of ``sample`` documents hold, the ``most`` commonest.

    The sample (the rows with the least hash of id and text) serves only to order keys by cost: results never depend on it."""
    picked = sampled(docs, sample)

    def grams(frames):
        import pandas as pd

        ids = WordHashes()
        for f in frames:
            parts = [np.unique(rolling(ids.of(w), width)) for w in (byte_words(t, lower) for t in f["text"]) if len(w) >= width]
            yield pd.DataFrame({"g": np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)})

    counted = picked.mapInPandas(grams, "g long").groupBy("g").count().filter(F.col("count") >= least)
    rows = counted.orderBy(F.desc("count"), "g").limit(most).collect()
    return np.sort(np.array([r["g"] for r in rows], np.int64).astype(np.uint64))


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table holds."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values
