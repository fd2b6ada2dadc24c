"""Question lists, directories, media metadata, stored vectors, configuration and examples; the sinks that match them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis import schemas


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list, or one JSON object a line."""
    whole = spark.read.schema(schemas.QUESTIONS).option("multiLine", True).json(path)
    # a file's lines, not its whole: a list begins with a bracket, an object a line with a brace
    is_list = spark.read.text(path).where(F.ltrim("value").startswith("[")).limit(1).count() == 1
    return whole if is_list else spark.read.schema(schemas.QUESTIONS).json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, bytes, modified of files; their content is never read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def probe_media(spark: SparkSession, path: str, probe, pattern: str = "*.mp4") -> DataFrame:
    """video_id, path, duration, fps, width, height of media files by a plug-in: bytes -> dict of these, or None.

    What the plug-in cannot open gets NULLs, and status "failed".
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for p in batches:
            got = [probe(c) for c in p.content]
            keys = ("duration", "fps", "width", "height")
            yield pd.DataFrame({"path": p.path, **{k: [(g or {}).get(k) for g in got] for k in keys}, "status": ["ok" if g else "failed" for g in got]})

    rows = found.mapInPandas(run, "path string, duration double, fps double, width int, height int, status string")
    return rows.withColumn("video_id", F.substring_index(F.regexp_extract("path", r"([^/]+)$", 1), ".", 1))


#: Rows that a decoder's task holds at once.
DECODED = 50_000


def decode_media(files: DataFrame, decode, schema: str) -> DataFrame:
    """Rows of pixel or sample arrays of files (path, content), by a plug-in: (path, bytes) -> rows of the schema."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for p in batches:
            rows = (r for path, content in zip(p.path, p.content, strict=True) for r in decode(path, content))
            while part := list(islice(rows, DECODED)):  # a long file's rows are never held at once
                yield pd.DataFrame(part, columns=names)

    return files.mapInPandas(run, schema)


#: Vectors of a file: some 64 MB of 512 components.
VECTORS_PER_FILE = 32_000


def save_vectors(vectors: DataFrame, path: str, per_file: int = VECTORS_PER_FILE) -> None:
    """Vectors with clip_duration and encoder as partitions: an encoder's rows never mix with another's.

    They are written by ranges of (encoder, video, clip), so each file holds few videos, which a search for some videos then reads alone, and an encoder
    or a long video is as many files, and tasks, as its rows take.
    """
    parts = max(1, -(-vectors.count() // per_file))
    order = ["clip_duration", "encoder", "video_id", *(c for c in ("clip_no", "seq") if c in vectors.columns)]
    vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("append").partitionBy("clip_duration", "encoder").parquet(path)


def load_vectors(spark: SparkSession, path: str, clip_duration: int, encoder: str | None = None, videos: list[str] | None = None) -> DataFrame:
    """Of one encoder, or all; of some videos, or all: other folders, files and row groups aren't read."""
    found = spark.read.parquet(path).where(F.col("clip_duration") == clip_duration)
    found = found if encoder is None else found.where(F.col("encoder") == encoder)
    return found if videos is None else found.where(F.col("video_id").isin(videos))


def save_bucketed(vectors: DataFrame, name: str, buckets: int) -> None:
    """Vectors as a table in buckets of videos: a join or search by video with another such table moves no row."""
    vectors.write.mode("overwrite").bucketBy(buckets, "video_id").sortBy("video_id").saveAsTable(name)


def append_results(results: DataFrame, path: str) -> None:
    """New results as new files; finished ones are never rewritten."""
    results.write.mode("append").parquet(path)


def results_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


@dataclass(frozen=True)
class Settings:
    """What a run is asked with by default. Stored in the session as temporis.<name>."""

    clip_duration: int = 10
    clip_fps: float = 2.0
    max_frames: int = 32
    min_frames: int = 10
    max_rounds: int = 20
    dataset_folder: str = "./"
    retriever: str = "precomputed"
    subtitle_k: int = 15

    def store(self, spark: SparkSession) -> None:
        for name, value in asdict(self).items():
            spark.conf.set(f"temporis.{name}", str(value))

    @classmethod
    def load(cls, spark: SparkSession) -> Settings:
        own = {}
        for f in fields(cls):
            value = spark.conf.get(f"temporis.{f.name}", None)
            if value is not None:
                own[f.name] = type(f.default)(value)
        return cls(**own)


EXAMPLES = "name string, question string, duration_s double"


def examples(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Ready questions, as the demo offers them: name, question, duration_s; those of a file of JSON lines, or a few of our own."""
    if path:
        return spark.read.schema(EXAMPLES).json(path)
    rows = [("short", "What does the person pick up first?", 360.0), ("hour", "In which order do the speakers appear?", 3300.0), ("film", "Why does the captain turn back?", 7200.0)]
    return spark.createDataFrame(rows, EXAMPLES)
