"""Run a streaming plan over what a table holds now, and return the outcome as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from temporis.plans.saving import folder


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}.parquet*")


#: Where state is kept that may outgrow memory, and that timers and list or map state ask for.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_turn(spark: SparkSession, parts: list[DataFrame], name: str) -> DataFrame:
    """A stream of some tables, one micro-batch each, in that order."""
    path = folder(spark, name)
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/part={k:03d}")
    return spark.readStream.schema(parts[0].schema.add("part", "integer")).option("maxFilesPerTrigger", 1).parquet(path).drop("part")


def outcome(stream: DataFrame, name: str, mode: str = "complete", rocks: bool = False) -> DataFrame:
    """Take all that is there; each micro-batch replaces (complete) or adds to (append, update) the table. rocks: state is kept by RocksDB."""
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    try:
        if rocks:
            spark.conf.set(provider, ROCKS)
        return _run(stream, name, mode)
    finally:
        if rocks:
            spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def _run(stream: DataFrame, name: str, mode: str) -> DataFrame:
    spark = stream.sparkSession
    out, marks = folder(spark, name), folder(spark, name + "-marks")

    def put(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:  # a batch that is run again replaces its own folder
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "complete" else stream.schema.add("batch", "long")).parquet(out)
