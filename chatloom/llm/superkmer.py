"""Substring dedup: windows of words travel in super-k-mers to the bucket of their minimiser."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.common import settle
from chatloom.llm.grams import WordHashes, among, byte_words, frequent_grams, rolling

#: Words of a window and of the pieces that minimisers are chosen from.
WINDOW, PIECE = 50, 5
#: Words that a task works on at once; intervals up to which removals are broadcast to the texts (16 bytes each).
BLOCK, SMALL = 400_000, 2_000_000
SENT = "mini long, doc_id long, k long, start int, n int, words binary"
GONE = "doc_id long, k long, start int, n int"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:len(x) - (width - reach)], x[width - reach:])


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that ``change`` (true where a new run begins) parts."""
    starts = np.flatnonzero(change)
    return starts, np.diff(np.append(starts, len(change)))


def _send(block: list, width: int, frequent: np.ndarray) -> dict:
    """Super-k-mers of some documents [(doc_id, k, words, hashes)], and the runs that a smaller id here already has."""
    block.sort(key=lambda d: d[0])
    owner = np.repeat(np.arange(len(block)), [len(d[3]) - width + 1 for d in block])
    ids = np.array([d[0] for d in block], np.int64)
    one = np.concatenate([rolling(d[3], width) for d in block])
    two = np.concatenate([rolling(d[3], width, salt=1) for d in block])
    _, first, back = np.unique(one, return_index=True, return_inverse=True)
    first = first[back]
    # windows that a smaller id of this block has too are settled here and needn't travel: a passage that very
    # many documents share leaves each task once
    here = (ids[owner[first]] < ids[owner]) & (two[first] == two)
    pieces = []
    for _, _, _, h in block:
        p = rolling(h, PIECE) >> np.uint64(2)
        # frequent pieces come last in the order, so that a shared passage is the minimiser only of windows inside it
        pieces.append(_sliding_min(p | (among(p, frequent).astype(np.uint64) << np.uint64(62)), width - PIECE + 1))
    mini = np.concatenate(pieces)
    new = np.ones(len(mini), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (here[1:] != here[:-1]) | (~here[1:] & (mini[1:] != mini[:-1]))
    at, n = _runs(new)
    offset = np.concatenate([[0], np.cumsum([len(d[3]) - width + 1 for d in block])])
    who = owner[at]
    start = at - offset[who]
    told = here[at]
    packed = [None if t else b" ".join(block[o][2][s:s + c + width - 1]) for o, s, c, t in zip(who.tolist(), start.tolist(), n.tolist(), told.tolist())]
    return {"mini": np.where(told, at, mini[at].astype(np.int64)), "doc_id": ids[who], "k": np.array([d[1] for d in block], np.int64)[who],
            "start": start.astype(np.int32), "n": n.astype(np.int32), "words": packed}


def super_kmers(docs: DataFrame, width: int, frequent: np.ndarray) -> DataFrame:
    """(mini, doc_id, k, start, n, words): ``n`` consecutive windows from word ``start`` that share the minimiser ``mini``,
    their words packed into one string; without words: windows already known to be repeats."""
    def cut(frames):
        hashes = WordHashes()
        for f in frames:
            block, size = [], 0
            for doc, k, text in zip(f["doc_id"].tolist(), f["k"].tolist(), f["text"].tolist()):
                w = byte_words(text)
                if len(w) >= width:
                    block.append((int(doc), k, w, hashes.of(w)))
                    size += len(w)
                if size >= BLOCK:
                    yield pd.DataFrame(_send(block, width, frequent))
                    block, size = [], 0
            if block:
                yield pd.DataFrame(_send(block, width, frequent))

    return (docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("k"), "text")
            .mapInPandas(cut, SENT))


def _settle_group(rows: list[tuple], width: int, out: list) -> None:
    """One minimiser: rows (doc_id, k, start, n, words). Windows are compared by their words, each distinct
    packed string once; whatever a smaller id also has goes to ``out``."""
    least: dict[bytes, int] = {}
    for doc, _, _, _, words in rows:
        least[words] = min(doc, least.get(words, doc))
    if len(least) == 1:
        out.extend((d, k, s, n) for (d, k, s, n, w) in rows if least[w] < d)
        return
    windows: dict[bytes, list[bytes]] = {}
    best: dict[bytes, int] = {}
    for words, doc in least.items():
        w = words.split(b" ")
        windows[words] = [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)]
        for x in windows[words]:
            if best.get(x, doc) >= doc:
                best[x] = doc
    for doc, k, start, _, words in rows:
        run = None
        for i, x in enumerate(windows[words]):
            if best[x] < doc:
                if run is None:
                    run = i
            elif run is not None:
                out.append((doc, k, start + run, i - run))
                run = None
        if run is not None:
            out.append((doc, k, start + run, len(windows[words]) - run))


def _settle_buckets(width: int):
    def settle(frames):
        held, mini = [], None
        for f in frames:
            out = []
            m = f["mini"].to_numpy()
            cols = [f[c].to_numpy() for c in ("doc_id", "k", "start", "n")] + [f["words"].to_numpy(dtype=object)]
            known = np.array([w is None for w in cols[4]], bool)
            told = [c[known] for c in cols[:4]]
            m, cols = m[~known], [c[~known] for c in cols]
            if len(m):
                at, n = _runs(np.concatenate([[True], m[1:] != m[:-1]]))
                for no, (a, c) in enumerate(zip(at.tolist(), n.tolist())):
                    if m[a] != mini:
                        if len(held) > 1:
                            _settle_group(held, width, out)
                        held, mini = [], m[a]
                    elif no:
                        raise AssertionError("rows of a minimiser lie together")
                    if c > 1 or no == len(at) - 1 or held:
                        held += list(zip(*[x[a:a + c].tolist() for x in cols]))
            yield pd.DataFrame({c: np.concatenate([t, np.array([o[i] for o in out], t.dtype)])
                                for i, (c, t) in enumerate(zip(("doc_id", "k", "start", "n"), told))})
        if len(held) > 1:
            out = []
            _settle_group(held, width, out)
            yield pd.DataFrame(out, columns=["doc_id", "k", "start", "n"])
    return settle


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, k, start, n): runs of windows whose words also start in a document with a smaller id. ``k`` is the
    text's hash, as ids may come twice.

    Each bucket is sorted by minimiser; a window meets only windows of its minimiser and is compared word by word."""
    frequent = frequent_grams(docs, PIECE, lower=False) >> np.uint64(2)
    sent = super_kmers(docs, width, np.unique(frequent))
    return sent.repartition("mini").sortWithinPartitions("mini").mapInPandas(_settle_buckets(width), GONE)


@F.pandas_udf(T.StructType().add("n_words", "long").add("n_removed", "long").add("kept", "string"))
def _kept(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, runs):
        w = byte_words(text)
        total = len(w)
        if found is not None and len(found):
            keep = np.ones(total + 1, np.int64)
            mark = np.zeros(total + 1, np.int64)
            for r in found:
                mark[r["start"]] += 1
                mark[r["stop"]] -= 1
            keep = np.cumsum(mark)[:total] == 0
            w = [x for x, y in zip(w, keep.tolist()) if y]
        rows.append((total, total - len(w), b" ".join(w).decode()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, ...) with doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Words inside a window of ``width`` words that also starts in a document with a smaller id go; windows are judged
    on the input. Null text has no words. Rows without an id lose nothing and cost others nothing; rows with one id
    don't cost each other. No rows give no rows. Extra columns are left out. Removals reach the texts by a broadcast if they are at most SMALL
    intervals, else by a shuffle on the id."""
    slim = docs.select("doc_id", "text")

    found = settle(repeated_windows(slim, width), "repeats")
    runs = found.groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + width - 1).alias("stop"))).alias("runs"))
    if found.count() <= SMALL:
        runs = F.broadcast(runs)
    joined = slim.withColumn("k", F.xxhash64("text")).join(runs, ["doc_id", "k"], "left")
    return joined.select("doc_id", _kept("text", "runs").alias("r")).select("doc_id", "r.*")
