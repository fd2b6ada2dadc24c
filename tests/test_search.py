"""Block search: tiles by group, odd vectors, brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from temporis.operators import retrieval, tiles


def plain(items, queries, k, unit=True):
    """(video, query) -> item ids, best first, ties to the smaller."""
    out = {}
    for video, q, v in queries:
        found = []
        for other, i, e in items:
            if other == video and e is not None and v is not None and len(e) == len(v) and np.isfinite(e).all() and np.isfinite(v).all():
                a, b = np.array(e, float), np.array(v, float)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                if not unit or size > 0:
                    found.append((-round(float(a @ b / size if unit else a @ b), 9), i))
        if found:
            out[video, q] = [i for _, i in sorted(found)[:k]]
    return out


def frames(spark, items, queries):
    return spark.createDataFrame(queries, "video_id long, query_id long, query array<double>"), spark.createDataFrame(items, "video_id long, clip_no long, embedding array<double>")


def got(hits):
    out = {}
    for r in hits.orderBy("rank").collect():
        out.setdefault((r.video_id, r.query_id), []).append(r.clip_no)
    return out


@pytest.mark.parametrize("block", [4, 16, 8192])
def test_groups_of_all_sizes(spark, block):
    rng = np.random.default_rng(block)
    sizes = [1, 3, 50, 7, 200, 2, 2, 2]
    items = [(v, 1000 * v + k, rng.integers(-3, 4, 6).astype(float).tolist()) for v, n in enumerate(sizes) for k in range(n)]
    queries = [(v, 100 * v + k, rng.integers(-3, 4, 6).astype(float).tolist()) for v, n in enumerate([2, 1, 9, 0, 30, 1, 0, 3]) for k in range(n)] + [(99, 1, [1.0] * 6), (None, 2, [1.0] * 6)]
    q, i = frames(spark, items, queries)
    for unit in (True, False):
        assert got(retrieval.search_blocks(q, i, 5, on=["video_id"], normalised=unit, digits=9, block=block)) == plain(items, queries, 5, unit)


def test_rows_dealt_follow_matches(spark):
    """250 videos of 400 clips, 50 queries: a query meets the blocks of its own video only; ten times the videos, ten times the rows."""
    made = lambda videos: spark.range(videos * 400).select((F.col("id") % videos).alias("video_id"), F.col("id").alias("clip_no"))
    asked = spark.range(50).select((F.col("id") * 5).alias("video_id"), F.col("id").alias("query_id"))
    for videos in (250, 2500):
        left, right = tiles.dealt(made(videos), asked, "clip_no", "query_id", ["video_id"], 8192)
        assert right.count() == 50 and left.count() == 50 * 400
    left, right = tiles.dealt(made(250), asked, "clip_no", "query_id", ["video_id"], 100)
    assert right.count() == 50 * 4 and left.count() == 50 * 400
    assert left.groupBy(*tiles.TILE).count().agg(F.max("count")).first()[0] < 2 * 100


def test_packs_hold_about_a_block(spark):
    items = spark.range(30_000).select((F.col("id") % 3000).alias("video_id"), F.col("id").alias("clip_no"))
    asked = spark.range(3000).select(F.col("id").alias("video_id"), F.col("id").alias("query_id"))
    left, _ = tiles.dealt(items, asked, "clip_no", "query_id", ["video_id"], 1000)
    sizes = [r["count"] for r in left.groupBy(*tiles.TILE).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 2000


@pytest.mark.parametrize("odd", [0, 9])
def test_mixed_lengths(spark, odd):
    items = [(1, k, [1.0, float(k), 0.0] if k == odd else [1.0, float(k), 0.0, 1.0]) for k in (*range(1, 6), odd)]
    queries = [(1, 1, [1.0, 2.0, 0.0, 1.0]), (1, 2, [1.0, 1.0, 0.0]), (1, 3, [1.0])]
    q, i = frames(spark, items, queries)
    want = plain(items, queries, 5)
    assert set(want) == {(1, 1), (1, 2)} and got(retrieval.search_blocks(q, i, 5, on=["video_id"], digits=9)) == want
    plain_hits = retrieval.search_blocks(q.drop("video_id"), i.drop("video_id"), 5, digits=9).withColumn("video_id", F.lit(1))
    assert got(plain_hits) == want


def test_vectors_that_are_not_finite_or_empty_take_no_part(spark):
    items = [(1, 1, [float("inf"), 1.0]), (1, 2, [float("nan"), 1.0]), (1, 3, None), (1, 4, [0.0, 0.0]), (1, 5, [1.0, 1.0]), (1, 6, []), (1, 7, [1e200, 1e200])]
    queries = [(1, 1, [1.0, 0.0]), (1, 2, [float("inf"), 0.0]), (1, 3, None), (1, 4, [])]
    q, i = frames(spark, items, queries)
    assert got(retrieval.search_blocks(q, i, 9, on=["video_id"])) == {(1, 1): [5]}
    assert got(retrieval.search_blocks(q, i, 9, on=["video_id"], normalised=False)) == {(1, 1): [7, 5, 4]}


def test_log_sum_exp_of_large_scales(spark):
    texts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0])], "text_id long, text_embedding array<double>")
    images = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(40)] + [(40, None), (41, [1.0])], "image_id long, image_embedding array<double>")
    found = {r.text_id: r for r in retrieval.logit_rows(retrieval.logits(texts, images, 8.0, block=16)).collect()}
    for text, sign in ((1, 1), (2, -1)):
        x = np.array([sign * np.exp(8.0) / np.hypot(1, k / 10) for k in range(40)])
        assert found[text].log_sum_exp == pytest.approx(x.max() + np.log(np.exp(x - x.max()).sum()))
        assert found[text].n_images == 40 and found[text].best_image == (0 if sign > 0 else 39)
    assert set(found) == {1, 2, 4} and found[4].n_images == 1


def test_places_over_cells(spark):
    """Places of a long video, with ties and missing times, are those of one sort."""
    from temporis.operators import sample

    rng = np.random.default_rng(8)
    rows = [(int(v), None if rng.random() < 0.05 else float(t), k) for k, (v, t) in enumerate(zip(rng.choice([1, 1, 1, 2], 900), rng.integers(-50, 4000, 900) / 2, strict=True))] + [(None, 1.0, 900), (None, 0.5, 901)]
    got = sample.placed(spark.createDataFrame(rows, "video_id long, t_s double, frame_no long"), ["video_id"], ["t_s", "frame_no"], "place", "n", cell=60.0).collect()
    assert len(got) == 902
    for video in (1, 2, None):
        own = sorted((r for r in rows if r[0] == video), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        mine = sorted((r for r in got if r.video_id == video), key=lambda r: r.place)
        assert [r.frame_no for r in mine] == [r[2] for r in own] and [r.place for r in mine] == list(range(len(own))) and {r.n for r in mine} == {len(own)}


def test_mean_pooling_sums_in_partitions(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", None), ("b", [1.0]), ("b", [3.0, 5.0]), ("c", []), (None, [1.0])]
    got = {r.k: r.embedding for r in retrieval.pool_mean(spark.createDataFrame(rows, "k string, embedding array<double>").repartition(4), "k").collect()}
    assert got == {"a": [2.0, 3.0], "b": [2.0, 5.0]}
