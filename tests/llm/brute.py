"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

from kelpmill.llm.speech import clean, speaker_key

WORD = re.compile(r"[^\W_]+")


def grams(text: str | None, n: int) -> set[tuple]:
    w = WORD.findall((text or "").lower())
    return set(zip(*(w[i:] for i in range(n))))


def similar_texts(texts: dict[str, str], n: int, threshold: float) -> set[tuple]:
    sets = {k: g for k, t in texts.items() if (g := grams(t, n))}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def neighbours(vectors: dict[str, list[float]], k: int, least: float) -> set[tuple]:
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i, row in enumerate(s):
        for j in np.argsort(-row, kind="stable")[:k]:
            if row[j] >= least:
                out.add(tuple(sorted((ids[i], ids[j]))))
    return out


def greedy_cuts(succ: list[int]) -> list[int]:
    out, at = [], 0
    while at < len(succ) - 1:
        at = succ[at]
        out.append(at)
    return out


def leaks(docs: dict[int, str], items: dict[int, str], n: int) -> set[tuple]:
    return {(d, i) for d, t in docs.items() for i, u in items.items() if grams(t, n) & grams(u, n)}


def turns(segments: list[tuple], diar: list[tuple]) -> set[tuple]:
    """segments: (recording, index, start, end, text); diar: (recording, start, end, label)."""
    rows, by = defaultdict(list), defaultdict(list)
    for r, s, e, label in set(diar):
        if speaker_key(label):
            by[r].append((s, e, speaker_key(label)))
    for r, i, s, e, text in set(segments):
        said, label = clean(text)
        if said:
            rows[r].append((s, i, e, label))
    out = set()
    for r, items in rows.items():
        items.sort(key=lambda x: x[:3])
        numbers, turn, last = {}, 0, None
        for s, i, e, label in items:
            if by[r]:
                length, first = defaultdict(float), {}
                for ds, de, k in sorted(by[r]):
                    if ds < e and de > s:
                        length[k] += min(e, de) - max(s, ds)
                        first.setdefault(k, ds)
                if length:
                    speaker = min(length, key=lambda k: (-round(length[k], 6), first[k], k))
                else:
                    before = max(((de, k) for ds, de, k in by[r] if de <= s), default=None)
                    after = min(((ds, k) for ds, de, k in by[r] if ds >= e), default=None)
                    speaker = before[1] if not after or before and s - before[0] <= after[0] - e else after[1]
            else:
                speaker = label
            if speaker is None:
                speaker = "guess"
            if speaker != last:
                turn, last = turn + 1, speaker
            numbers.setdefault(speaker, len(numbers) + 1)
            out.add((r, i, turn, numbers[speaker]))
    return out


def common_runs(x: list, y: list, least: int) -> list[tuple]:
    """Maximal common runs (start in x, start in y, length)."""
    out = []
    for i in range(len(x)):
        for j in range(len(y)):
            if i and j and x[i - 1] == y[j - 1]:
                continue
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            if n >= least:
                out.append((i, j, n))
    return out


def tiles(x: list, y: list, least: int) -> list[tuple]:
    """Greedy string tiling by its definition: again and again the longest run of unmarked words, the first of equals."""
    out, fx, fy = [], [True] * len(x), [True] * len(y)
    while True:
        best = (0, 0, 0)
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and fx[i + n] and fy[j + n] and x[i + n] == y[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return out
        i, j, n = best
        fx[i : i + n], fy[j : j + n] = [False] * n, [False] * n
        out.append(best)
