"""Plain restatements of the contracts, row by row, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def secrets(text: str | None) -> tuple:
    text, out = text or "", []
    pats = [
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    n = []
    for k, (kind, p, ok) in enumerate(pats):
        got = [(m.start(), k, m.end(), kind) for m in re.finditer(p, text, re.ASCII) if ok(m)]
        n.append(len(got))
        out += got
    return *n, ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def licenses(text: str | None) -> tuple:
    w = PLAIN.findall((text or "").translate(AZ))
    at, labels = [], set()
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def leaks(docs: list[tuple], items: list[tuple]) -> dict:
    windows = defaultdict(set)
    for item, t in items:
        w = PLAIN.findall((t or "").translate(AZ))
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - 9)):
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = sorted({len(x) for x in windows})
    out = []
    for d, t in docs:
        w = PLAIN.findall((t or "").translate(AZ))
        hit, who = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    who |= x
        out.append((d, len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit)))
    return out


def repeats(docs: list[tuple], n: int = 50) -> list[tuple]:
    ws = [(d, SPACED.findall(t or "")) for d, t in docs]
    first: dict = {}
    for d, w in ws:
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, w in ws:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingles(text: str | None, n: int = 5) -> set:
    w = SPACED.findall((text or "").translate(AZ))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near(docs: list[tuple]) -> list[tuple]:
    sets = [(d, shingles(t)) for d, t in docs]
    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (_, s) in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    both[j] += 1
        for j, c in both.items():
            if 100 * c >= 75 * (len(s) + len(sets[j][1]) - c):
                up[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(s), least[root(i)], d == least[root(i)]) for i, (d, s) in enumerate(sets)]


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Room left in the bins of best-fit decreasing, one piece at a time."""
    left: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(left)) if left[b] >= n]
        if fits:
            left[min(fits, key=left.__getitem__)] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def ranked(docs: list[tuple], items: list[tuple], top: int = 50) -> list[tuple]:
    import math

    words = [(d, PLAIN.findall((t or "").translate(AZ))) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(x for _, w in words for x in set(w))
    out = []
    for item, text in {(i, (t or "").translate(AZ)) for i, t in items}:
        scores = []
        for d, w in words:
            tf, s = Counter(w), 0
            for x in set(PLAIN.findall(text)):
                if tf[x]:
                    m = 100 - 50 + 50 * len(w) * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 20 * m))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def one_edit(x: str, y: str) -> bool:
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def spelling(docs: list[tuple], points: int = 6, count: int = 5, times: int = 5) -> dict:
    seen: Counter = Counter()
    for d, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(AZ)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 199 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            seen[r] += 1
    words = {w: n for w, n in seen.items() if len(w) >= points and n >= count}
    out, form = {}, {}
    for w, n in words.items():
        close = [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(x, w)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
        out[w] = [form[w], w, n, len(close), words[form[w]] if form[w] else None]
    for w, row in out.items():
        while form[row[1]]:
            row[1] = form[row[1]]
    return {w: tuple(r) for w, r in out.items()}
