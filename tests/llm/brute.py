"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    runs = defaultdict(list)
    for i in range(len(w) - 4):
        runs[tuple(w[i : i + 5])].append(i)
    covered = {i + j for at in runs.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def repeated_bytes(texts: list[str | None], length: int = 200) -> list[np.ndarray]:
    """For each text which of its bytes go."""
    data, seen = [(t or "").encode() for t in texts], Counter()
    for b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        out.append(np.cumsum(edge)[:-1] > 0)
    return out


def repeated_words(rows: list[tuple[int | None, str | None]], length: int = 20) -> list[tuple[int | None, int, int, str]]:
    """doc_id, n_words, n_removed, kept_sha256, with earlier = smaller doc_id (None first), then text, then place."""
    seen: set[tuple] = set()
    out = []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        w = WORD.findall(text or "")
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[i : i + length] = True
            seen.add(key)
        out.append((doc, len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def shingles(text: str | None) -> Counter:
    w = WORD.findall(text or "")
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def near_classes(texts: list[str | None], similar: float = 0.8) -> list[int]:
    """The number of each text's group: parts connected by weighted Jaccard similarities."""
    sets = [shingles(t) for t in texts]
    df = Counter(k for s in sets for k in s)
    n = sum(1 for s in sets if s)
    idf = {k: 2 - round(8 * math.log2(v)) / 8 / max(1.0, math.log2(max(2, n))) for k, v in df.items()}
    total = [sum(v * idf[k] for k, v in s.items()) for s in sets]
    inverse = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            if df[k] > 1:
                inverse[k].append(i)
    both: dict[tuple[int, int], float] = defaultdict(float)
    for k, at in inverse.items():
        for x in range(len(at)):
            for y in range(x + 1, len(at)):
                both[at[x], at[y]] += min(sets[at[x]][k], sets[at[y]][k]) * idf[k]
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), v in both.items():
        if v / (total[a] + total[b] - v) >= similar - 1e-12:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(texts))]


def boilerplate(rows: list[tuple[int, str | None, str | None]], sites: int = 10) -> list[tuple[int, int, str]]:
    """rows: doc_id, text, source. (n_lines, n_removed, what stays) of each."""
    where, first = defaultdict(set), {}
    for doc, text, source in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            if key := line.strip(BLANK):
                where[key].add(source or "")
                first.setdefault(key, (doc, i))
    out = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        gone = [bool(k := x.strip(BLANK)) and len(where[k]) >= sites and first[k] != (doc, i) for i, x in enumerate(lines)]
        out.append((sum(bool(x.strip(BLANK)) for x in lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out
