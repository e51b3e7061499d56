"""Weighted fuzzy ratio of two texts, 0 to 100, from longest common subsequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; one big integer holds a whole row of the table."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_window(a: str, b: str) -> float:
    """The shorter text against all windows of its length of the longer one, cut at the ends too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    return max(ratio(a, b[max(0, k) : k + len(a)]) for k in range(1 - len(a), len(b)))


def words(a: str) -> list[str]:
    return sorted(a.split())


def by_sets(a: str, b: str, score=ratio) -> float:
    """Common words against common words and those of either text."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(score(one, two), score(both, one) if both else 0.0, score(both, two) if both else 0.0)


def weighted(a: str, b: str) -> float:
    """Plain ratio for texts of like length, windows for others; word order and repeats count for less (0.95)."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if lengths < 1.5:
        return max(plain, 0.95 * ratio(" ".join(words(a)), " ".join(words(b))), 0.95 * by_sets(a, b))
    scale = 0.9 if lengths <= 8 else 0.6
    partial_sets = 100.0 if set(a.split()) & set(b.split()) else best_window(" ".join(sorted(set(a.split()))), " ".join(sorted(set(b.split()))))
    return max(plain, scale * best_window(a, b), 0.95 * scale * max(best_window(" ".join(words(a)), " ".join(words(b))), partial_sets))


def weighted_ratio(query: str, *columns: Column) -> Column:
    """The best ratio of the query to any of some columns; null and empty ones and the text None don't count."""

    @F.pandas_udf("double")
    def best(texts: pd.Series) -> pd.Series:
        seen: dict[str, float] = {}
        out = []
        for row in texts:
            top = 0.0
            for t in row:
                if t and t != "None":
                    if t not in seen:
                        seen[t] = weighted(query, t)
                    top = max(top, seen[t])
            out.append(top)
        return pd.Series(out)

    return best(F.array(*[c.cast("string") for c in columns]))
