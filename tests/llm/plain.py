"""Plain versions of the text operators, for the tests: slow, direct, on Python lists."""

from __future__ import annotations

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def shingles(text: str | None, width: int = 5) -> set[tuple]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def components(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def repeats_removed(rows: list[tuple[int, str]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for d, text in sorted(rows):
        w = words(text, lower=False)
        gone: set[int] = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out
