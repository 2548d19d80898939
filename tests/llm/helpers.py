"""Small odd tables, and plain Python versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_lines int, kept string, ids string, __key string"


def prose(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}é"[: rng.randrange(2, 6)] for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    base = prose(rng, 120)
    shared = "A line that many documents share, it is."
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n \x0b\r\n", "en", None),
        (4, f"{base}\n{shared}\nown line number four of this test", "en", "a"),
        (5, f"  {shared.upper()}\t\nother", None, "b"),
        (6, f"{shared}\r\n{shared}\n\n", "de", "b"),
        (7, f"{base}\n{shared}\nown line number four of this test", "de", "c"),
        (8, base + " changed", "de", None),
        (9, "zz " * 40_000 + "日本語 \u0000 ▁ ﬁ", "en", "c"),
        (9, "zz " * 40_000 + "日本語 \u0000 ▁ ﬁ", "en", "c"),
        (10, "x" * 150_000, "fr", "d"),
        (None, base, "en", "a"),
        (None, base, "en", "a"),
        (11, "one two", "en", "a"),
        (12, "ONE two", None, "a"),
        (13, "😀 " * 30 + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", ""),
    ]
    return [(*r, 7, "x", "y", "z") for r in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def fresh(rng: random.Random, words: int = 80) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(1, 9))) for _ in range(words))


def word_set(text: str | None, n: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def linked(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest doc_id of its component), by counting all overlaps."""
    sets = {i: word_set(t, n) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, common in Counter(k for g in s for k in holders[g] if k < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}
