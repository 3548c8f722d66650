"""Plain counterparts of the operators, one text at a time."""

from __future__ import annotations

import re
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def simhash(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: list[tuple[int | None, int]], max_bits: int = 4) -> list[int | None]:
    """Per row the smallest id it can reach."""
    parent = list(range(len(prints)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= max_bits:
            parent[find(i)] = find(j)
    lowest: dict[int, int] = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            lowest[find(i)] = min(doc, lowest.get(find(i), doc))
    return [lowest.get(find(i)) for i in range(len(prints))]
