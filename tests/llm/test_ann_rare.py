"""Queries outside of tight clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from temporis.llm import ann


def test_rare_queries_get_k_rows(spark):
    """Their lists hold a few vectors each, and so few of the sample's pairs are theirs that two lists would do."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    close = np.repeat(centres, 49, axis=0) + rng.normal(size=(1960, 16)) * 1e-3
    rare = rng.normal(size=(40, 16))
    rare *= 1.5 / np.linalg.norm(rare, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.vstack([rare, close]))], "vec_id long, embedding array<double>")
    got = ann.search(rows, F.col("vec_id") < 40, 20).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == dict.fromkeys(range(40), 20)


def test_lists_are_probed_until_they_hold_enough():
    model = ann.Model(np.eye(4), 16, 1)
    model.probes = 1
    model.hold(np.array([1, 0, 2, 9]), 3)
    near = model.probed(np.eye(4)[:1] + 0.5)
    assert (near @ model.counts >= 3).all()
    model.hold(np.array([1, 0, 2, 9]), 100)
    assert model.probed(np.eye(4)).all()
