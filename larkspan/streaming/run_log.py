"""Live metrics over a run log: a file stream, deduplicated, windowed, with last-wins state by merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.session import scratch_path


def read_log(spark: SparkSession, folder: str, schema: str, name: str = "*.parquet", ts_col: str = "ts", files: int | None = None) -> DataFrame:
    """A stream of the folder's Parquet files; ts_col becomes a timestamp in the session's zone, as a watermark needs."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder).withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, ts_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first record of each key within the watermark."""
    return stream.withWatermark(ts_col, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, keys: list[str], value_col: str, ts_col: str = "ts", width: str = "1 day") -> DataFrame:
    """(window_start, keys, n, total): counts and sums by window."""
    grouped = stream.groupBy(F.window(ts_col, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def replay(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result: each batch's output is written to the shared folder, the last one is read.

    Nothing goes through the driver; a batch that runs again overwrites its own folder.
    """
    spark = result.sparkSession
    path = scratch_path(spark, name)
    last = [-1]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/v{number}")
        last[0] = number

    result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{path}/out/v{last[0]}")


def upsert_last(stream: DataFrame, path: str, key: str, order_col: str, checkpoint: str) -> None:
    """Keeps the last record of each key in Parquet versions under path; each batch merges and writes the next version.

    The version is the batch's number, so a batch that runs again writes the
    same folder again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        whole = F.struct(*(F.col(c) for c in batch.columns))
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{path}/v{number - 1}"))
        rows.groupBy(key).agg(F.max_by(whole, order_col).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/v{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
