"""Names of one block against names of another, all at once: which of them can be variants, by what they have in common.

Where most names of a list are made of the same few characters no blocking key tells them apart. Comparing blocks by a product of
matrices costs less there than meeting under each shared key, and no pair ever leaves the task."""

from __future__ import annotations

import numpy as np

from . import constants as K
from .similarity import _bare, _dropped, digit_grams, same_reading

#: Columns of a block's matrix. Further tokens share them, which only loosens the bound.
COLUMNS = 512
#: Pairs looked at in one go.
CELLS = 1 << 20


class Tokens:
    """The column of a character and its repeat. The first to come have one each."""

    def __init__(self):
        self.of = {}

    def columns(self, plain: str) -> list[int]:
        seen, out = {}, []
        for c in plain:
            k = seen[c] = seen.get(c, 0) + 1
            at = self.of.get((c, k))
            if at is None:
                at = len(self.of)
                if at < COLUMNS:
                    self.of[c, k] = at
                else:
                    at = (ord(c) * 31 + k) % COLUMNS
            out.append(at)
        return out


class Block:
    """Names, their lengths, what they hold by column, and the six-digit grams some of them have."""

    def __init__(self, names: list[str], tokens: Tokens):
        self.names, self.tokens = names, tokens
        each = [tokens.columns(_bare(n)) for n in names]
        self.sizes = np.array([len(c) for c in each], dtype=np.int64)
        at = np.repeat(np.arange(len(names)), self.sizes) * COLUMNS + np.array([c for e in each for c in e], dtype=np.int64)
        self.held = np.bincount(at, minlength=len(names) * COLUMNS).astype(np.float32).reshape(len(names), COLUMNS)
        self.grams = {}
        for i, n in enumerate(names):
            for g in digit_grams(n):
                self.grams.setdefault(g, []).append(i)

    def __len__(self):
        return len(self.names)


def least_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many characters names of these lengths must have in common to be variants but for their numbers; a little
    less, so that rounding loses none. The bounds of ``operators.entities``."""
    short, long = np.minimum(x, y), np.maximum(x, y)
    fuzzy = np.where((short >= 2) & (long - short <= np.maximum(2, long // 3)), K.FUZZY_RATIO / 2 * (x + y), np.inf)
    inside = np.where((short >= 4) & (long > short), K.WINDOW_RATIO * short, np.inf)
    return (np.minimum(fuzzy, inside) - 1e-3).astype(np.float32)


def possible(one: Block, other: Block, later: bool = False):
    """Pairs (i, j) that can be variants, as two arrays sorted by i, then j, for a stretch of ``one`` at a time. ``later`` keeps only
    i < j (a block against itself)."""
    if not len(one) or not len(other):
        return
    used = min(COLUMNS, len(one.tokens.of))
    ys, at_y = np.unique(other.sizes, return_inverse=True)
    shared = [(one.grams[g], other.grams[g]) for g in one.grams.keys() & other.grams.keys()]
    right = np.ascontiguousarray(other.held[:, :used].T)
    step = max(1, CELLS // len(other))
    for start in range(0, len(one), step):
        end = min(start + step, len(one))
        xs, at_x = np.unique(one.sizes[start:end], return_inverse=True)
        need = least_common(xs[:, None], ys[None, :])[:, at_y]
        near = one.held[start:end, :used] @ right >= need[at_x]
        for a, b in shared:
            a = [i - start for i in a if start <= i < end]
            if a:
                near[np.ix_(a, b)] = True
        if later:
            near &= np.arange(start, end)[:, None] < np.arange(len(other))[None, :]
        i, j = np.nonzero(near)
        if len(i):
            yield i + start, j


class Shelf:
    """Names that are added one by one and may be replaced, to be searched for those that can be variants of a name."""

    def __init__(self):
        self.tokens, self.count, self.grams = Tokens(), 0, {}
        self.sizes, self.held = np.zeros(64, dtype=np.int64), np.zeros((COLUMNS, 64), dtype=np.int16)

    def put(self, at: int, name: str) -> None:
        """A name at a place, the next one or one that is taken. What the former name had of numbers stays: it only loosens the bound."""
        if at == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.held = np.concatenate([self.held, np.zeros_like(self.held)], axis=1)
        self.count = max(self.count, at + 1)
        columns = np.array(self.tokens.columns(_bare(name)), dtype=np.int64)
        self.sizes[at], self.held[:, at] = len(columns), np.bincount(columns, minlength=COLUMNS)
        for g in digit_grams(name):
            self.grams.setdefault(g, set()).add(at)

    def near(self, name: str) -> list[int]:
        """Places of the names that can be variants of this one, in order."""
        columns = np.array(self.tokens.columns(_bare(name)), dtype=np.int64)
        common = self.held[columns, :self.count].sum(axis=0, dtype=np.int64)
        found = np.flatnonzero(common >= least_common(np.int64(len(columns)), self.sizes[:self.count])).tolist()
        numbered = set().union(*(self.grams.get(g, ()) for g in digit_grams(name)))
        return sorted(numbered.union(found)) if numbered else found


def linked(one: Block, other: Block | None, labels: np.ndarray, alike) -> list[tuple[int, int]]:
    """Pairs of labels that became one, where names of different labels that are ``alike`` take one label. Names of ``other`` come
    behind those of ``one`` in ``labels``, which is changed; a pair that hangs together already is not compared."""
    joined, behind = [], 0 if other is None else len(one)
    second = one if other is None else other
    for i, j in possible(one, second, later=other is None):
        for s in range(0, len(i), 8192):
            a, b = i[s:s + 8192], j[s:s + 8192] + behind
            apart = np.flatnonzero(labels[a] != labels[b])
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                u, v = labels[x], labels[y]
                if u != v and alike(one.names[x], second.names[y - behind]):
                    joined.append((int(u), int(v)))
                    labels[labels == max(u, v)] = min(u, v)
    return joined


# What is scored together: names up to this length, of this many different characters, so many pairs at once.
LONGEST, DIFFERENT, TOGETHER = 100, 200, 1 << 14


def _matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest common stretch of each column of ``a`` and ``b`` (a column is a text, filled up with what equals nothing): length and both
    starts. Of several the one that ends first in ``a``, then in ``b``, as ``SequenceMatcher`` has it."""
    rows, cols, n = len(a), len(b), a.shape[1]
    best, at_a, at_b = (np.zeros(n, dtype=np.int8) for _ in range(3))
    last, now = (np.zeros((cols + 1, n), dtype=np.int8) for _ in range(2))
    equal, more = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    for i in range(rows):
        for j in range(cols):
            run = now[j + 1]
            np.equal(a[i], b[j], out=equal)
            np.add(last[j], 1, out=run)
            np.multiply(run, equal, out=run)
            np.greater(run, best, out=more)
            if more.any():
                np.copyto(best, run, where=more)
                np.copyto(at_a, i + 1, where=more)
                np.copyto(at_b, j + 1, where=more)
        last, now = now, last
    return best.astype(np.int64), at_a.astype(np.int64) - best, at_b.astype(np.int64) - best


def _ratio_reached(a: np.ndarray, b: np.ndarray, start: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Whether ``SequenceMatcher(None, x, y).ratio()`` reaches the threshold, for texts ``a[row]`` and the stretches of ``b[row]`` from ``start``; both by
    rows, of ``sizes``. A pair is left as soon as what is matched suffices or what may still be matched does not."""
    n = len(a)
    total, open_ = np.zeros(n, dtype=np.int64), np.minimum(*sizes).astype(np.int64)
    size = sizes[0] + sizes[1]
    reached = lambda m: 2.0 * m / size >= threshold
    # stretches still to be matched: pair, where it begins in both, how long it is in both
    part = (np.arange(n), np.zeros(n, dtype=np.int64), start.astype(np.int64), sizes[0].astype(np.int64), sizes[1].astype(np.int64))
    while True:
        undecided = (~reached(total) & reached(total + open_))[part[0]] & (part[3] > 0) & (part[4] > 0)
        part = tuple(x[undecided] for x in part)
        if not len(part[0]):
            return reached(total)
        following = []
        order = np.argsort(part[3] * LONGEST + part[4], kind="stable")      # what is of like size goes together
        for s in range(0, len(order), TOGETHER):
            p, x, y, m, k = (v[order[s:s + TOGETHER]] for v in part)
            row, col = np.arange(m.max())[:, None], np.arange(k.max())[:, None]
            left = np.where(row < m, a[p, np.minimum(x + row, a.shape[1] - 1)], -1)
            right = np.where(col < k, b[p, np.minimum(y + col, b.shape[1] - 1)], -2)
            best, i, j = _matched(left, right)
            np.subtract.at(open_, p, np.minimum(m, k))
            np.add.at(total, p, best)
            hit = best > 0
            p, x, y, m, k, best, i, j = (v[hit] for v in (p, x, y, m, k, best, i, j))
            following += [(p, x, y, i, j), (p, x + i + best, y + j + best, m - i - best, k - j - best)]
        part = tuple(np.concatenate(v) for v in zip(*following))
        np.add.at(open_, part[0], np.minimum(part[3], part[4]))


class Texts:
    """The plain names of two blocks as rows of numbers, to be scored many pairs at a time."""

    def __init__(self, one: Block, other: Block):
        self.blocks, plain = (one, other), [[_bare(n) for n in b.names] for b in (one, other)]
        of = {c: i for i, c in enumerate(sorted({c for ps in plain for p in ps for c in p}))}
        self.usable = 0 < len(of) <= DIFFERENT
        if not self.usable:
            return
        self.count, wide = len(of), max(1, min(LONGEST, max(len(p) for ps in plain for p in ps)))
        self.codes, self.fits, self.grams = [], [], []
        for block, ps in zip(self.blocks, plain):
            codes = np.full((len(ps), wide), -1, dtype=np.int16)
            for i, p in enumerate(ps):
                if len(p) <= wide:
                    codes[i, :len(p)] = [of[c] for c in p]
            self.codes.append(codes)
            self.fits.append(block.sizes <= wide)
        number = {g: i for i, g in enumerate(one.grams.keys() & other.grams.keys())}
        # names that share a six-digit gram are rare: they are looked at one by one
        self.grams = [[frozenset()] * len(b) for b in self.blocks]
        for b, sets in zip(self.blocks, self.grams):
            for g, no in number.items():
                for i in b.grams[g]:
                    sets[i] = sets[i] | {no}
        self.numbered = [np.array([bool(s) for s in sets]) for sets in self.grams]

    def same(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``same_reading`` of each pair, and of each pair the other way round."""
        out = np.zeros(len(i), dtype=bool), np.zeros(len(i), dtype=bool)
        one, other = self.blocks
        alone = np.ones(len(i), dtype=bool)
        if self.usable:
            alone = ~(self.fits[0][i] & self.fits[1][j])
            for k in np.flatnonzero(~alone & self.numbered[0][i] & self.numbered[1][j]).tolist():
                alone[k] = not self.grams[0][i[k]].isdisjoint(self.grams[1][j[k]])
            rest = np.flatnonzero(~alone)
            for s in range(0, len(rest), 1 << 18):
                r = rest[s:s + (1 << 18)]
                out[0][r], out[1][r] = self._scored(i[r], j[r])
        for k in np.flatnonzero(alone).tolist():
            x, y = one.names[i[k]], other.names[j[k]]
            out[0][k], out[1][k] = same_reading(x, y), same_reading(y, x)
        return out

    def _scored(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = self.blocks[0].sizes[i], self.blocks[1].sizes[j]
        sides = (self.codes[0], i, m), (self.codes[1], j, n)
        out = []
        for (a, p, x), (b, q, y) in (sides, sides[::-1]):
            hit = (x > 1) & (y > 1) & (np.abs(x - y) <= np.maximum(2, x // 3))
            k = np.flatnonzero(hit)
            hit[k] = _ratio_reached(a[p[k]], b[q[k]], np.zeros(len(k), dtype=np.int64), (x[k], y[k]), K.FUZZY_RATIO)
            out.append(hit)
        # a part or a shortened form: the same both ways
        for swap in (False, True):
            (a, p, x), (b, q, y) = sides[::-1] if swap else sides
            k = np.flatnonzero(~(out[0] & out[1]) & (x >= 4) & (x < y))
            if not len(k):
                continue
            small, large = (self.blocks[1], self.blocks[0]) if swap else self.blocks
            part = self._inside(a[p[k]], b[q[k]], x[k], y[k])
            for o in np.flatnonzero(~part & (y[k] - x[k] <= 6)).tolist():
                part[o] = _dropped(_bare(small.names[p[k[o]]]), _bare(large.names[q[k[o]]]))
            for o in out:
                o[k] |= part
        return out[0], out[1]

    def _inside(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether some window of ``b``, as wide as ``a``, resembles it. Windows that hold too few of its characters are not matched."""
        n, every = len(a), np.arange(len(a))
        lacking = np.zeros((n, self.count + 1), dtype=np.int16)
        inner = np.arange(a.shape[1])[None, :] < x[:, None]
        np.add.at(lacking, (np.broadcast_to(every[:, None], a.shape)[inner], a[inner]), 1)
        first = np.arange(b.shape[1])[None, :] < x[:, None]
        np.subtract.at(lacking, (np.broadcast_to(every[:, None], b.shape)[first], b[first]), 1)
        common = x - np.where(lacking > 0, lacking, 0).sum(axis=1)
        found = np.zeros(n, dtype=bool)
        for at in range(int((y - x).max()) + 1):
            k = np.flatnonzero(~found & (at + x <= y) & (common / x >= K.WINDOW_RATIO))
            if len(k):
                found[k] = _ratio_reached(a[k], b[k], np.full(len(k), at, dtype=np.int64), (x[k], x[k]), K.WINDOW_RATIO)
            k = np.flatnonzero(~found & (at + x < y))
            if not len(k):
                break
            gone, come = b[k, at], b[k, at + x[k]]
            lacking[k, gone] += 1
            common[k] -= lacking[k, gone] > 0
            common[k] += lacking[k, come] > 0
            lacking[k, come] -= 1
        return found
