"""The media source and the committing sink, the cache of vectors by content, the vector store by ranges."""

from __future__ import annotations

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from temporis.plans.plugins import HashingEncoder
from temporis.sources import files, media
from temporis.sources.vector_cache import VectorCache


@pytest.fixture
def folder(spark, tmp_path):
    media.register(spark)
    for name, text in {"a/v1.mp4": "12345", "a/v2.mp4": "1", "b/bad.mp4": "123", "b/v3.mp4": "", "b/v4.txt": "12"}.items():
        at = tmp_path / "media" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(tmp_path / "media")


def read(spark, folder, **options):
    return spark.read.format("temporis_media").options(path=folder, pattern="*.mp4", probe="tests.plugins:probe", **options).load()


def probed(folder):
    return {f[: -len(".probed")] for _, _, names in os.walk(folder) for f in names if f.endswith(".probed")}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_media_rows(spark, folder, scheme):
    rows = read(spark, scheme + folder, files_per_partition="2")
    got = {r.video_id: (r.path, r.bytes, r.duration, r.status) for r in rows.collect()}
    assert got == {
        "v1": (f"{scheme}{folder}/a/v1.mp4", 5, 5.0, "ok"), "v2": (f"{scheme}{folder}/a/v2.mp4", 1, 1.0, "ok"),
        "bad": (f"{scheme}{folder}/b/bad.mp4", 3, None, "failed"), "v3": (f"{scheme}{folder}/b/v3.mp4", 0, None, "failed"),
    }
    assert rows.rdd.getNumPartitions() == 2
    plain = spark.read.format("temporis_media").options(path=scheme + folder).load()
    assert {r.status for r in plain.collect()} == {"unprobed"} and plain.where("video_id = 'v4'").count() == 1


def test_filters_reach_the_listing(spark, folder):
    rows = read(spark, folder).where((F.col("bytes") >= 1) & F.col("path").startswith(folder + "/a") & (F.col("duration") > 0) & F.col("video_id").isin("v1", "v3"))
    assert [r.video_id for r in rows.collect()] == ["v1"]
    assert probed(folder) == {"v1.mp4"}  # no other file was opened
    reader = media.MediaReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    kept = list(reader.pushFilters([EqualTo(("video_id",), "v2"), GreaterThan(("duration",), 1.0)]))
    assert kept == [GreaterThan(("duration",), 1.0)] and [f.video_id for p in reader.partitions() for f in p.files] == ["v2"]


def test_media_stream_reads_each_file_once(spark, folder, tmp_path):
    stream = spark.readStream.format("temporis_media").options(path=folder, pattern="*.mp4", probe="tests.plugins:probe").load()

    def run():
        done = stream.select("video_id", "status").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        assert done.awaitTermination(90)

    run()
    time.sleep(0.02)
    (tmp_path / "media/c").mkdir()
    (tmp_path / "media/c/v9.mp4").write_text("123")
    run()
    assert sorted(r.video_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["bad", "v1", "v2", "v3", "v9"]


def test_results_are_written_once(spark, tmp_path):
    media.register(spark)
    path = str(tmp_path / "results")
    rows = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("é\n"), F.col("id").cast("string"))).alias("text")).repartition(3)
    for batch in ("one", "one", "two"):
        rows.write.format("temporis_results").mode("append").options(path=path, batch=batch).save()
    got = spark.read.schema("id long, text string").json(path)
    assert got.count() == 200 and got.where("text is null").count() == 100 and got.where(F.col("text") == "é\n42").count() == 2
    assert not os.listdir(f"{path}/_tasks") or all(not n.endswith(".json") for n in os.listdir(f"{path}/_tasks"))
    failing = rows.select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="no"):
        failing.write.format("temporis_results").mode("append").options(path=path, batch="three").save()
    assert spark.read.schema("id long, text string").json(path).count() == 200


def test_stream_of_results_commits_batches_once(tmp_path):
    writer = media.ResultsStreamWriter({"path": str(tmp_path / "s")})

    class Row:
        def asDict(self, recursive):  # noqa: N802 - Spark's name
            return {"id": 1}

    for _ in range(2):
        writer.commit([writer.write(iter([Row()])), writer.write(iter([])), None], 7)
    writer.abort([writer.write(iter([Row()]))], 8)
    assert sorted(n for n in os.listdir(tmp_path / "s") if n != "_tasks") == ["_batch-stream-00000007", "stream-00000007-00000.json"]
    assert os.listdir(tmp_path / "s/_tasks") == []


def test_cache_encodes_what_is_new(spark, tmp_path):
    cache, name = VectorCache(spark, str(tmp_path / "cache")), "h8"
    encode = HashingEncoder(8, None)
    items = [(1, "red car"), (2, "red car"), (3, "dog"), (4, None), (5, "!!")]
    rows = spark.createDataFrame(items, "item long, text string")
    assert {r.value for r in cache.missing(rows, "text", name).collect()} == {"red car", "dog", "!!"}
    first = {r.item: (r.embedding, r.status) for r in cache.encoded(rows, "text", name, encode, datetime.date(2024, 1, 1)).collect()}
    assert [first[k][1] for k in range(1, 6)] == ["ok", "ok", "ok", "failed", "failed"] and first[1][0] == first[2][0] == pytest.approx(encode(["red car"])[0])
    assert {r.value for r in cache.missing(rows, "text", name).collect()} == {"!!"}  # what can't be read is tried again
    changed = spark.createDataFrame([(1, "blue car"), *items[1:3]], "item long, text string")
    assert [r.value for r in cache.missing(changed, "text", name).collect()] == ["blue car"]

    def refuses(values):
        assert list(values) == ["blue car"], values
        return encode(values)

    again = cache.encoded(changed, "text", name, refuses, datetime.date(2024, 1, 2)).collect()
    assert all(r.status == "ok" for r in again) and cache.vectors(name).count() == 3
    assert cache.vectors("other").count() == 0 and cache.missing(rows, "text", "other").count() == 3
    cache.fill(rows.limit(1), "text", name, encode, datetime.date(2024, 1, 3))
    assert cache.evict(datetime.date(2024, 1, 2)) == 1 and {r.value for r in cache.missing(changed, "text", name).collect()} == {"red car", "dog"}
    assert VectorCache(spark, str(tmp_path / "cache")).vectors(name).count() == 1  # another run finds what is left


def test_vector_ranges(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(5000).select(
        F.concat(F.lit("v"), F.lpad((F.col("id") % 50).cast("string"), 2, "0")).alias("video_id"), F.col("id").alias("clip_no"), F.array(F.lit(1.0)).alias("embedding"),
        F.lit(10).alias("clip_duration"), F.when(F.col("id") % 5 == 0, "small").otherwise("large").alias("encoder"),
    )
    files.save_vectors(rows, path, per_file=400)
    names = spark.read.parquet(path).select("encoder", F.input_file_name().alias("f"), "video_id").groupBy("encoder", "f").agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("videos")).collect()
    assert max(r.n for r in names) < 1000 and sum(r.encoder == "large" for r in names) >= 5  # an encoder is many tasks and files
    assert max(r.videos for r in names if r.encoder == "large") < 25
    some = files.load_vectors(spark, path, 10, "large", ["v07"])
    assert some.count() == 0 or some.count() == rows.where("video_id = 'v07' and encoder = 'large'").count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "video_id" in plan.partition("PushedFilters")[2].partition("]")[0]
    assert some.select(F.input_file_name()).distinct().count() <= 2
    assert files.load_vectors(spark, path, 10).count() == 5000 and files.load_vectors(spark, path, 5).count() == 0


def test_bucketed_vectors_join_without_a_shuffle(spark):
    rows = spark.range(200).select((F.col("id") % 20).cast("string").alias("video_id"), F.col("id").alias("clip_no"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left_vectors", "right_vectors"):
            files.save_bucketed(rows, name, 4)
        joined = spark.table("left_vectors").join(spark.table("right_vectors").withColumnRenamed("clip_no", "other"), "video_id")
        assert joined.count() == 2000
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSparkPlan", "")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("left_vectors", "right_vectors"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
