"""Brute-force versions of the contracts, in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def byte_dedup(rows, width=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - width + 1):
            if (key := raw[p : p + width]) in seen:
                gone[p : p + width] = [True] * width
            seen.add(key)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def word_dedup(rows, width=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = SPACE_WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - width + 1):
            if (key := tuple(words[p : p + width])) in seen:
                gone[p : p + width] = [True] * width
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def jaccard_groups(rows, k=3, percent=90):
    sets = {}
    for i, text in rows:
        w = SPACE_WORD.findall(lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sorted(sets, key=lambda i: len(sets[i])) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if len(x) * 100 < percent * len(y):
                break
            shared = len(x & y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def base_counts(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def benchmark_digest(rows, items, width=10):
    windows = {}
    for item, text in items:
        w = BENCH_WORD.findall(lower(text))
        for p in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[p : p + width]), set()).add(str(item))
    out = {}
    for i, text in rows:
        w = BENCH_WORD.findall(lower(text))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (key := tuple(w[p : p + size])) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[key]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), digest, bool(hit))
    return out
