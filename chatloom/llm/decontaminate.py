"""Benchmark decontamination by latent semantic retrieval.

Passages and benchmark items become TF-IDF vectors, a distributed randomised SVD gives a latent space, passages close to an
item in that space are candidates, and a longest common subsequence with a check of the answer decides."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.common import settle
from chatloom.llm.grams import byte_words, sampled

#: Words of a passage and from one passage to the next.
PASSAGE, STRIDE = 32, 16
#: Dimensions of the latent space, extra directions and power steps of the randomised SVD.
RANK, EXTRA, STEPS = 192, 16, 2
#: Items of one search; larger benchmarks are searched in blocks of so many.
BLOCK = 2000
#: Least cosine in the latent space; share of an item's TF-IDF mass that a passage must hold to be looked up.
COSINE, MASS = 0.45, 0.25
#: Share of an item's words that the common subsequence holds in a copy, and in a paraphrase whose answer is there too.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.75
#: Items with fewer words are not searched: any text holds them.
LEAST_WORDS = 5
#: Passages of a block from which a word's part of the sums is a dense product; changes no sum but for rounding.
OFTEN = 32

HITS = T.ArrayType(T.StructType().add("item_id", "long").add("start", "long").add("cosine", "double").add("common", "double"))
STRIP = b".,;:!?()[]{}<>\"'`*#$%&|_-~/\\"


@dataclass
class Space:
    """One block of items: their words by number, weights, directions and places in the latent space."""

    items: list[int]
    words: list[np.ndarray]
    known: dict[bytes, int]
    idf: np.ndarray
    directions: np.ndarray
    places: np.ndarray
    mass: np.ndarray


def passages(lengths: np.ndarray) -> np.ndarray:
    """How many passages texts of so many words have, one each STRIDE words; the last one ends with its text."""
    return np.where(lengths > PASSAGE, -(-(lengths - PASSAGE) // STRIDE) + 1, (lengths > 0).astype(np.int64))


def item_words(items: list[tuple[int, str]]) -> tuple[list[int], list[list[bytes]]]:
    cut = [(i, [b for w in byte_words(t, lower=True) if (b := w.strip(STRIP))]) for i, t in items]
    cut = [(i, w) for i, w in cut if len(w) >= LEAST_WORDS]
    return [i for i, _ in cut], [w for _, w in cut]


def _known(words: list[list[bytes]]) -> dict[bytes, int]:
    """The words of the items by number."""
    return {w: n for n, w in enumerate(sorted({x for w in words for x in w}))}


def _number_type(known: dict[bytes, int]) -> str:
    return "<i2" if len(known) < 1 << 15 else "<i4"


def _numbered(docs: DataFrame, known: dict[bytes, int], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``_numbers``: the words of each text by number end to end, -1 for words that no item has; marks around a word
    don't count. Texts are cut here once and for all."""
    kind = np.dtype(_number_type(known)).char

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = known.get
        for texts in batches:
            yield pd.Series([array(kind, [get(w.strip(STRIP), -1) for w in byte_words(t, lower=True)]).tobytes() for t in texts], dtype=object)

    return settle(docs.select(*[F.col(f"`{c}`") for c in keep], F.pandas_udf(run, "binary").asNondeterministic()("text").alias("_numbers")), "numbers")


def _texts(cells, kind: str, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts worked on at once: their words by number end to end, the length of each, and how many texts. About ``most`` words, whole texts."""
    some, size = [], 0
    for x in cells:
        some.append(x)
        size += len(x)
        if size >= most * np.dtype(kind).itemsize:
            yield _joined(some, kind)
            some, size = [], 0
    if some:
        yield _joined(some, kind)


def _joined(cells: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, int]:
    words = np.frombuffer(b"".join(cells), kind).astype(np.int64)
    return words, np.array([len(x) for x in cells], np.int64) // np.dtype(kind).itemsize, len(cells)


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, word number) of the words of each row, once each, in order; negative numbers are none."""
    ordered = np.sort(numbers, axis=1)
    use = ordered >= 0
    use[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
    return np.nonzero(use)[0], ordered[use]


def _cut(numbered: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(_numbers, n): numbered texts and how many passages each has, cut end to end."""
    bits = F.octet_length("_numbers") / F.lit(float(np.dtype(_number_type(known)).itemsize * PASSAGE))
    return numbered.select("_numbers", F.ceil(bits).alias("n"))


def _read(frames, kind: str, most: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The passages of ``_cut``, up to ``most`` at once: flat arrays (passage, word number) and the number of passages."""
    for f in frames:
        for words, lengths, _ in _texts(f["_numbers"], kind):
            held = -(-lengths // PASSAGE)
            filled = np.full(int(held.sum()) * PASSAGE, -1)
            # the last passage of a text is filled up
            filled[np.arange(len(words)) + np.repeat(np.cumsum(held * PASSAGE - lengths) - (held * PASSAGE - lengths), lengths)] = words
            filled = filled.reshape(-1, PASSAGE)
            for a in range(0, len(filled), most):
                rows, cols = _distinct(filled[a:a + most])
                yield rows, cols, len(filled[a:a + most])


def _document_frequencies(cut: DataFrame, size: int, kind: str) -> tuple[np.ndarray, int]:
    def run(frames):
        df, total = np.zeros(size, np.int64), 0
        for _, cols, n in _read(frames, kind):
            df += np.bincount(cols, minlength=size)
            total += n
        w = np.flatnonzero(df)
        yield pd.DataFrame({"w": np.append(w, -1), "n": np.append(df[w], total)})

    rows = cut.mapInPandas(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(size), 0
    for r in rows:
        if r["w"] < 0:
            total = r["n"]
        else:
            df[r["w"]] = r["n"]
    return df, total


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin and how long they are."""
    start = np.flatnonzero(np.diff(x, prepend=-1))
    return start, np.diff(np.append(start, len(x)))


def _added(start: np.ndarray, count: np.ndarray, which: np.ndarray, table: np.ndarray, most: int = 256) -> np.ndarray:
    """For each run the sum of the rows of ``table`` that it names, added in its order.

    The first of each run are added at once, then the second and so on; few enough runs that what is added stays in the processor's cache."""
    out = np.empty((len(start), table.shape[1]), table.dtype)
    fetched = np.empty((min(most, len(start)), table.shape[1]), table.dtype)
    for a in range(0, len(start), most):
        order = np.argsort(-count[a:a + most], kind="stable")
        first, n = start[a:a + most][order], count[a:a + most][order]
        sums = table[which[first]]
        for k, m in enumerate(np.searchsorted(-n, -np.arange(1, n[0])).tolist(), 1):
            np.take(table, which[first[:m] + k], axis=0, out=fetched[:m], mode="clip")
            sums[:m] += fetched[:m]
        out[a + order] = sums
    return out


def _gram_product(cut: DataFrame, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """AᵀA·omega for the passages' TF-IDF matrix A: each task multiplies its rows, Spark adds up the sums by word.

    A is a matrix of zeros and ones between two diagonal ones, so its rows are only looked up and added. Words that many passages of a block hold
    are multiplied as a dense matrix."""
    kind = "<i2" if len(idf) < 1 << 15 else "<i4"

    def run(frames):
        weighted, squares, total = idf[:, None] * omega, idf ** 2, np.zeros_like(omega)
        for rows, cols, n in _read(frames, kind):
            often = np.flatnonzero(np.bincount(cols, minlength=len(idf)) >= OFTEN)
            place = np.full(len(idf), -1)
            place[often] = np.arange(len(often))
            at = place[cols]
            dense = np.zeros((n, len(often)))
            dense[rows[at >= 0], at[at >= 0]] = 1
            y = dense @ weighted[often]
            row, col = rows[at < 0], cols[at < 0]
            if len(row):
                start, count = _runs(row)
                y[row[start]] += _added(start, count, col, weighted)
            y /= ((np.sqrt(np.bincount(rows, squares[cols], n)) + 1e-12) ** 2)[:, None]
            total[often] += dense.T @ y
            if len(row):
                order = np.argsort(col, kind="stable")
                start, count = _runs(col[order])
                total[col[order][start]] += _added(start, count, row[order], y)
        total *= idf[:, None]
        some = np.flatnonzero(np.abs(total).sum(1) > 0)
        yield pd.DataFrame({"w": some, "v": [x.tobytes() for x in total[some]]})

    def add(f):
        w = f["w"].to_numpy()
        order = np.argsort(w, kind="stable")
        edge = np.flatnonzero(np.diff(w[order], prepend=-1))
        sums = np.add.reduceat(np.frombuffer(b"".join(f["v"])).reshape(-1, width)[order], edge, axis=0)
        return pd.DataFrame({"w": w[order][edge], "v": [x.tobytes() for x in sums]})

    width, out = omega.shape[1], np.zeros_like(omega)
    # a task yields a row of sums for every word, a group adds up those of a few words
    summed = cut.mapInPandas(run, "w long, v binary").groupBy(F.pmod("w", F.lit(256))).applyInPandas(add, "w long, v binary")
    for r in summed.collect():
        out[r["w"]] = np.frombuffer(r["v"])
    return out


def fit_space(docs: DataFrame, items: list[tuple[int, str]], sample: int | None = None, rank: int = RANK, seed: int = 5,
              texts: DataFrame | None = None) -> Space:
    """Latent space of the items of one block, fitted on the passages of all texts and the items. The texts are cut once (``texts``, if they
    are already); document frequencies and each power step read what was cut. ``sample`` bounds the fit to so many texts (least hash); by default none is left out.

    The vocabulary is that of the items: other words add nothing to a dot product. So everything that reaches the driver has
    at most BLOCK items' words times rank + EXTRA numbers."""
    ids, words = item_words(items)
    known = _known(words)
    numbered = [np.array([known[x] for x in w]) for w in words]
    kind = _number_type(known)
    cut = _cut(_numbered(docs, known, []) if texts is None else texts, known)
    df, total = _document_frequencies(cut, len(known), kind)
    fitted, n_fitted = cut, total
    if sample is not None:
        fitted = _cut(_numbered(sampled(docs, sample), known, []), known)
        n_fitted = _document_frequencies(fitted, len(known), kind)[1]
    idf = np.log((1.0 + total) / (1.0 + df)) + 0.05
    own = np.zeros((len(ids), len(known)))
    for i, v in enumerate(numbered):
        own[i, np.unique(v)] = idf[np.unique(v)]
    mass = (own ** 2).sum(1)
    own /= np.sqrt(mass)[:, None] + 1e-12
    width = min(len(known), rank + EXTRA)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(known), width)))[0]
    for _ in range(STEPS):
        q = np.linalg.qr(own.T @ (own @ q) + _gram_product(fitted, idf, q) / max(n_fitted, 1))[0]
    # within the found range, the directions that carry the items best
    _, _, vt = np.linalg.svd(own @ q, full_matrices=False)
    directions = (q @ vt.T[:, :rank]).astype(np.float32)
    places = (own @ directions).astype(np.float32)
    places /= np.linalg.norm(places, axis=1, keepdims=True) + 1e-9
    return Space(ids, numbered, known, idf, directions * idf[:, None].astype(np.float32), places, mass)


def masks(item: np.ndarray) -> dict[int, int]:
    """Where an item has each of its words, a bit for each place."""
    at: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    return at


def common_subsequence(length: int, at: dict[int, int], text: list[int]) -> int:
    """Length of the longest common subsequence of an item's ``masks`` and a text, a bit for each word of the item."""
    full = (1 << length) - 1
    row = full
    for w in text:
        m = at.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


class Search:
    """What a task looks up in a space."""

    def __init__(self, space: Space):
        self.space, n = space, len(space.known)
        self.kind = _number_type(space.known)
        self.squares = np.append(space.idf ** 2, 0.0)
        self.lengths = np.array([len(w) for w in space.words])
        # how often an item has a word, 255 for more; the last column is that of words that no item has
        self.held = np.zeros((len(space.items), n + 1), np.uint8)
        for i, w in enumerate(space.words):
            own, times = np.unique(w, return_counts=True)
            self.held[i, own] = np.minimum(times, 255)
        self.whole = [masks(w) for w in space.words]
        self.answers = [w[-max(3, len(w) // 4):] for w in space.words]

    def verdict(self, i: int, text: list[int]) -> float:
        """Share of item ``i`` found in order; 0 unless it is a copy, or a paraphrase that keeps the answer (the last quarter)."""
        n = int(self.lengths[i])
        share = common_subsequence(n, self.whole[i], text) / n
        if share >= COPY:
            return share
        answer = self.answers[i]
        return share if share >= PARAPHRASE and common_subsequence(len(answer), masks(answer), text) >= ANSWER * len(answer) else 0.0

    def near(self, words: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
        """(passage, item, cosine, first word, end of the words to compare), in order, where the passage is close to the item and the words
        around it are enough for a verdict. Passages start at ``start`` in texts from ``begin`` to ``end``."""
        spot = start[:, None] + np.arange(PASSAGE)
        number = np.where(spot < end[:, None], words[np.minimum(spot, len(words) - 1)], -1)
        heavy = np.flatnonzero(self.squares[number].sum(1) >= MASS * self.space.mass.min())
        row, col = _distinct(number[heavy])
        place = np.zeros((len(heavy), self.space.directions.shape[1]), np.float32)
        if len(row):
            first, count = _runs(row)
            place[row[first]] = _added(first, count, col, self.space.directions)
        place /= np.linalg.norm(place, axis=1, keepdims=True) + 1e-9
        # a product of matrices may round by where a row stands in it: the cosine that counts is made for each pair alone
        r, item = np.nonzero(place @ self.space.places.T >= COSINE - 1e-4)
        cosine = np.concatenate([(place[r[a:a + 4096]].astype(np.float64) * self.space.places[item[a:a + 4096]]).sum(1) for a in range(0, len(r) or 1, 4096)])
        r, item, cosine = r[cosine >= COSINE], item[cosine >= COSINE], cosine[cosine >= COSINE]
        at = start[heavy[r]]
        # the item may begin before the passage or end behind it
        lo, hi = np.maximum(begin[heavy[r]], at - self.lengths[item]), np.minimum(end[heavy[r]], at + PASSAGE + self.lengths[item])
        most = max(1, (1 << 19) // (PASSAGE + 2 * int(self.lengths.max())))
        for a in range(0, len(r), most):
            b = slice(a, a + most)
            ok = a + np.flatnonzero(self.enough(words, item[b], lo[b], hi[b]))
            yield from zip(heavy[r[ok]].tolist(), item[ok].tolist(), cosine[ok].tolist(), lo[ok].tolist(), hi[ok].tolist())

    def enough(self, words: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the words from ``lo`` to ``hi`` hold the share of the item's that a paraphrase needs, in whatever order: a common
        subsequence has no more of a word than either side."""
        spot = lo[:, None] + np.arange((hi - lo).max())
        number = np.where(spot < hi[:, None], words[np.minimum(spot, len(words) - 1)], -1)
        number[self.held[item[:, None], number] == 0] = -1
        could = (number >= 0).sum(1) / self.lengths[item] >= PARAPHRASE
        number, item = np.sort(number[could], axis=1), item[could]
        place, fresh = np.arange(number.shape[1]), np.ones(number.shape, bool)
        fresh[:, 1:] = number[:, 1:] != number[:, :-1]
        earlier = place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
        held = self.held[item[:, None], number]
        could[could] = ((earlier < held) | (held == 255)).sum(1) / self.lengths[item] >= PARAPHRASE
        return could


def find_hits(cells, search: Search, most: int = 2048) -> list[list[tuple]]:
    """Per numbered text: (item_id, first word, cosine, share) of the best passage for each item found."""
    out = []
    for words, lengths, texts in _texts(cells, search.kind):
        end = np.cumsum(lengths)
        begin = end - lengths
        many = passages(lengths)
        text = np.repeat(np.arange(texts), many)
        no = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        start = begin[text] + np.minimum(no * STRIDE, np.maximum(lengths - PASSAGE, 0)[text])
        best: list[dict[int, tuple]] = [{} for _ in range(texts)]
        for a in range(0, len(start), most):
            of = text[a:a + most]
            for r, i, c, lo, hi in search.near(words, start[a:a + most], begin[of], end[of]):
                known = best[of[r]]
                if known.get(i, (0, 0.0, 0.0))[1] >= 1.0:
                    continue
                share = search.verdict(i, words[lo:hi].tolist())
                if share and (share, c) > known.get(i, (0, 0.0, 0.0))[1:]:
                    known[i] = (int(start[a + r] - begin[of[r]]), share, c)
        out += [[(search.space.items[i], s, c, share) for i, (s, share, c) in sorted(b.items())] for b in best]
    return out


def _hits_udf(space: Space):
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = Search(space)
        for cells in batches:
            yield pd.Series([[dict(zip(("item_id", "start", "cosine", "common"), h)) for h in x] for x in find_hits(cells, search)])

    # else the filter that Spark derives from exploding the hits would search every text a second time
    return F.pandas_udf(hits, HITS).asNondeterministic()


def with_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``_leaks``: array of (item_id, start, cosine, common), empty for clean texts.

    Every passage of every text is searched for every item of ``benchmark`` (item_id, text), items in blocks of ``block``. Null
    and empty texts leak nothing. Items under LEAST_WORDS words or without an id are not searched. Equal rows get equal
    hits, equal items are each reported. An empty benchmark or corpus gives no hits. ``text=False`` leaves the texts out of the result."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    n = -(-items.count() // block)
    d = docs.withColumn("_leaks", F.array().cast(HITS))
    for b in range(n):
        rows = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "text").collect()]
        words = item_words(rows)[1]
        if words:
            keep = [c for c in d.columns if c != "text" or text or b < n - 1]
            numbered = _numbered(d, _known(words), keep)
            found = _hits_udf(fit_space(docs, rows, texts=numbered))("_numbers")
            d = numbered.select(*[F.col(f"`{c}`") for c in keep if c != "_leaks"], F.concat("_leaks", found).alias("_leaks"))
    return d if text else d.drop("text")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, cosine, common): a row for each document and item that it holds; the best one if rows repeat."""
    hit = with_leaks(docs.select("doc_id", "text"), benchmark, text=False).select("doc_id", F.explode("_leaks").alias("h")).select("doc_id", "h.*")
    return (hit.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "cosine", "common"), F.struct("common", "cosine", -F.col("start"))).alias("b"))
            .select("doc_id", "item_id", "b.*"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return with_leaks(packed, benchmark, text=False).filter(F.size("_leaks") == 0).select("row.*")
