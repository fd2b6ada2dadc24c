"""What a review of the queries at size and on odd inputs found."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from temporis import catalog
from temporis.operators import interval, retrieval, sample

#: Texts with words of ASCII, of other scripts only, and without any.
ODD = ["plain words", "", "  ", None, "日本語", "привет", "é", "ß", "...", "_", "٣", "²", "á", "ü b", "İ", "K", "ſ", "5", "\na", "x\x00y", "plain words"]


def differing(spark, folder: str, name: str) -> tuple[int, int, int]:
    """Rows of a query and of its SQL, and those that only one of them has."""
    got = catalog.QUERIES[name](spark, folder)
    got.write.parquet(f"{folder}/got-{name}")
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    con.execute(f"CREATE VIEW got AS SELECT * FROM '{folder}/got-{name}/*.parquet'")
    con.execute(f"CREATE TABLE want AS {catalog.ORACLES[name]}")
    count = lambda sql: con.execute(f"SELECT count(*) FROM ({sql})").fetchall()[0][0]
    both = ", ".join(got.columns)
    return count("FROM got"), count("FROM want"), count(f"(SELECT {both} FROM got EXCEPT ALL SELECT {both} FROM want) UNION ALL (SELECT {both} FROM want EXCEPT ALL SELECT {both} FROM got)")


@pytest.fixture
def odd_texts(spark, tmp_path) -> str:
    rows = [(3 * k + j, t, "en" if j else "de", "s") for k, t in enumerate(ODD) for j in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_f2_texts_of_other_scripts_are_as_in_the_sql(spark, odd_texts):
    assert differing(spark, odd_texts, "enc1_modalities") == (3 * len(ODD), 3 * len(ODD), 0)


def test_f3_the_cache_tells_texts_of_other_scripts_as_its_sql(spark, odd_texts):
    assert differing(spark, odd_texts, "vec12_embedding_cache") == (3, 3, 0)


def test_f1_many_points_of_a_cell_are_looked_up_in_one_pass(spark):
    items = [(1, float(3 * k % 50), k) for k in range(40)]
    points = [(1, k * 50 / 30_000) for k in range(30_000)]
    found = interval.nearest_join(spark.createDataFrame(points, "video_id long, t double"), spark.createDataFrame(items, "video_id long, t_s double, frame_no long"), "video_id")
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString()  # a frame that is read again for each row
    for r in found.collect()[::997]:
        assert (r.nearest.t_s, r.nearest.frame_no) == min(((t, n) for _, t, n in items), key=lambda x: (abs(x[0] - r.t), x))


@pytest.mark.parametrize(("how", "fps"), [("uniform", 2.0), ("stride", 2.0), ("uniform", 3.0), ("stride", 0.7)])
def test_f4_runs_of_points_are_as_the_points_one_by_one(spark, how, fps):
    draw = random.Random(7)
    shape = {1: 0, 2: 1, 3: 5, 4: 40, 5: 300, 6: 90, 7: 3}
    frames = [(v, draw.choice([draw.randrange(-40, 2000) / 4, draw.uniform(0, 700.0), 300.0]), n, draw.random() < 0.8) for v, many in shape.items() for n in range(many)] + [(5, None, 999, True)]
    frames = spark.createDataFrame(frames, "video_id long, t_s double, frame_no long, is_valid boolean")
    grids = spark.createDataFrame([(1, 0.0, 9), (2, 0.0, 7), (3, 0.0, 1400), (4, 0.5, 1300), (5, 0.0, 1500), (6, 0.0, 20), (7, 0.0, 0), (8, 0.0, 5)], "video_id long, start_s double, n int")
    runs = sample.grid_runs(grids, frames, fps)
    assert runs.count() < 340  # rows are frames; points are 4,000
    points = grids.where("n > 0").select("video_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("start_s") + i * F.lit(1.0 / fps))).alias("t"))
    near = sample.readable_frames(points, frames).select("video_id", "t", F.col("nearest.t_s").alias("t_s"))
    want = sample.thinned(near, ["video_id"], ["t", "t_s"], how, least=10)
    got = sample.thinned_runs(runs.where("nearest.is_valid"), fps, "video_id", how, least=10)
    show = lambda df: sorted(map(tuple, df.select("video_id", "n", "frames").collect()))
    assert show(got) == show(want) and len(show(got)) >= 4


def test_f6_to_f9_media_files_are_written_without_a_sort(spark, sf, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from temporis.plans import source_queries

    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **b: (seen.append(int(spark.conf.get(name, "0"))), write(self, *a, **b))[1])
    before = spark.conf.get(name, None)
    source_queries._media(spark, sf)
    assert min(seen) >= 5 and spark.conf.get(name, None) == before


def test_logits_are_summed_in_their_cells(spark, sf, capsys):
    """vec11: a cell yields numbers of a text, not rows of logits; they equal the logits' own sums, on odd vectors, small slices and images that tie too."""
    rng = np.random.default_rng(6)
    vectors = [rng.normal(size=3).tolist() for _ in range(300)]
    vectors = [*vectors, *vectors[:40], [0.0, 0.0, 0.0], None, [], [1.0], [float("nan"), 1.0, 1.0]]
    images = spark.createDataFrame(list(enumerate(vectors)), "image_id long, image_embedding array<double>")
    texts = images.select(F.col("image_id").alias("text_id"), F.col("image_embedding").alias("text_embedding"))
    plain = {r.text_id: r for r in retrieval.logit_rows(retrieval.logits(texts, images, 8.0, block=64)).collect()}
    for block in (32, 2048):
        found = {r.text_id: r for r in retrieval.logit_sums(texts, images, 8.0, block=block).collect()}
        assert set(found) == set(plain) == set(range(340)) | {343}
        for k, r in found.items():
            assert r.n_images == plain[k].n_images and r.best_image == k % 300 if k < 340 else r.best_image == 343
            assert r.best_logit == pytest.approx(plain[k].best_logit) and r.log_sum_exp == pytest.approx(plain[k].log_sum_exp)
    catalog.QUERIES["vec11_contrastive_logits"](spark, sf).explain()
    assert "logits" not in capsys.readouterr().out
