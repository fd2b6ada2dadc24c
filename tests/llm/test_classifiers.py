"""The toxicity machine through fit, and the scores of both classifiers against their formula written plainly."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from temporis.llm import quality, toxicity


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def texts(n: int, seed: int) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """Toxic means that exactly one of two words is there; either alone says nothing, as do a hundred other words."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for k in range(n):
        a, b = rng.integers(0, 2, 2)
        words = [f"w{x}" for x in rng.integers(0, 100, 25)] + ["apple"] * a + ["river"] * b
        rows.append((k, " ".join(rng.permutation(words))))
        labels.append((k, int(a != b)))
    return rows, labels


def test_pairs_survive_fit(spark):
    rows, labels = texts(3000, 1)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = [(scores[k] >= 0.5) == bool(y) for k, y in labels if held(k)]
    assert len(right) > 400 and np.mean(right) >= 0.9


def test_pairs_are_screened_outside_of_the_driver(spark):
    """The driver holds no square of candidates while it fits, and stripes choose what the whole square would."""
    rng = np.random.default_rng(5)
    sets = [rng.choice(3000, 220, replace=False) for _ in range(900)]
    letters = lambda x: "".join(chr(97 + int(c)) for c in f"{x:04d}")
    rows, label = [(k, " ".join(map(letters, s))) for k, s in enumerate(sets)], [int(rng.random() < 0.4) for _ in sets]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(label)), "doc_id long, toxic int")
    tracemalloc.start()
    try:
        toxicity.fit(docs, marks)
        assert tracemalloc.get_traced_memory()[1] < 25e6  # both squares of 2048 candidates take 34 MB
    finally:
        tracemalloc.stop()

    n, often = 300, np.arange(0, 600, 2)
    sets = [np.unique(np.r_[s[s > 2] % 597 + 3, [0] * (k % 2), [2] * (k // 2 % 2)].astype(int)) for k, s in enumerate(sets)]
    label = [k % 2 ^ k // 2 % 2 for k in range(len(sets))]
    held = np.array([np.isin(often, s) for s in sets], float)
    y = np.array(label)
    both = np.stack([held[y == c].T @ held[y == c] for c in (0, 1)])
    counts, seen = np.stack([held[y == c].sum(0) for c in (0, 1)]), np.array([(y == 0).sum(), (y == 1).sum()], float)
    expected = counts[:, :, None] * counts[:, None, :] / seen[:, None, None]
    m, usual = both.sum(0), expected.sum(0)
    share = expected[1] / usual
    i, j = np.nonzero(np.triu((m >= 20) | (expected.min(0) >= 20), 1) & (share > 0) & (share < 1))
    z = ((both[1] - m * share) / np.sqrt(np.maximum(m, usual) * share * (1 - share)))[i, j].astype(np.float32)
    middle = np.median(z)
    z = np.abs(z - middle) / max(1.0, 1.4826 * np.median(np.abs(z - middle)))
    best = np.lexsort((j, i, -z))[:256]
    best = best[z[best] >= 8]
    table = spark.createDataFrame([(bytearray(np.sort(s).astype("<i4").tobytes()), c) for s, c in zip(sets, label, strict=True)], "terms binary, label int").repartition(5)
    got = sorted(r.place for r in toxicity.pair_screen(table, often, counts, seen).collect())
    assert len(got) and got == sorted({*i[best].tolist(), *j[best].tolist()})


def test_pairs_without_interaction_bring_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(5, 80)))) for k in range(2000)]
    marks = spark.createDataFrame([(k, int(rng.random() < 0.3)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), marks)
    assert len(model["kept"]) <= 12  # what single words show by chance


def test_toxicity_scores_are_the_formula(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    place = {int(b): k for k, b in enumerate(model["kept"])}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        words = set(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        terms = words | {w[:n] + "~" for w in words for n in (4, 5) if len(w) >= n}
        own = sorted({place[b] for b in (zlib.crc32(t.encode()) % (1 << toxicity.BITS) for t in terms) if b in place})
        odds = model["b"] + sum(model["w"][k] for k in own) + sum(float(model["v"][a] @ model["v"][b]) for x, a in enumerate(own) for b in own[x + 1 :])
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, odds)))), rel=1e-6)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    right, toxic = scored.agg(F.avg(((F.col("score") >= 0.5) == (F.col("toxic") == 1)).cast("double")), F.avg(F.when(F.col("toxic") == 1, (F.col("score") >= 0.5).cast("double")))).first()
    assert right >= 0.97 and toxic >= 0.85


def test_quality_module_has_one_score_a_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from temporis.llm.queries import QUERIES

    got = QUERIES["op10_quality"](spark, sf).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in got)
    assert hasattr(quality, "op10_quality")
