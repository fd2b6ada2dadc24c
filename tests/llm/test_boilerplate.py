"""Texts that share long boilerplate and differ in a few words: no links, or all, and no pairs of all of them."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from temporis.llm import jaccard


def shingles(text: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def got(spark, rows):
    return {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def pages(n: int, differ: int, place: int) -> list[tuple[int, str]]:
    base = [f"b{k}" for k in range(24)]
    return [(i, " ".join([*base[:place], *(f"p{i}x{k}" for k in range(differ)), *base[place + differ :]])) for i in range(n)]


@pytest.mark.parametrize(("differ", "place"), [(3, 21), (2, 22), (1, 12), (3, 0), (2, 11)])
def test_pages_of_one_boilerplate(spark, differ, place):
    rows = pages(60, differ, place)
    assert got(spark, rows) == plain(rows)


def test_mixed_sizes_and_places(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(220):
        words = [f"c{k}" for k in range(int(rng.integers(18, 32)))]
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = f"r{rng.integers(40)}"
        rows.append((i, " ".join(words)))
    want = plain(rows)
    assert got(spark, rows) == want and 1 < len(set(want.values())) < 220


def test_boilerplate_makes_no_pairs_of_all(spark, monkeypatch):
    """Rows that may be paired grow with the texts, not with their square."""
    seen = defaultdict(int)
    before = jaccard._all_pairs

    def counted(rows):
        heads, met = before(rows)
        seen["pairs"] += met.count()
        return heads, met

    monkeypatch.setattr(jaccard, "_all_pairs", counted)
    result = got(spark, pages(3000, 3, 21))
    assert all(i == c for i, c in result.items()) and seen["pairs"] <= 3000
