"""Plain models of the contracts: one document at a time, no Spark."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 16), ("hex", re.compile(r"[0-9a-f]+"), 32)]


def words(text):
    return WORD.findall(text or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def base_secrets(text):
    out = []
    for no, (kind, pattern, least) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                out.append((m.start(), no, kind, m.end()))
    out.sort()
    n = Counter(x[2] for x in out)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in out))


def quality_base(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i:i + 5])].append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def shingles(text):
    w = words((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def similar_components(docs):
    """{doc_id: (n_shingles, component_id)} by trying every pair."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            n = len(x & y)
            if n and 100 * n >= 75 * (len(x) + len(y) - n):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def repeats_removed(docs, width=50):
    """{doc_id: (n_words, n_removed, sha of the kept words)}."""
    least = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, t in docs:
        w = words(t)
        gone = {j for k in range(len(w) - width + 1) if least[tuple(w[k:k + width])] < i for j in range(k, k + width)}
        out[i] = len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))
    return out
