"""Taking in new classifications as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import CLASSIFICATIONS


def arrivals(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """New parquet files of classifications as they appear in a folder."""
    return spark.readStream.schema(CLASSIFICATIONS).option("maxFilesPerTrigger", files).parquet(folder)


def without_repeats(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """Each id once, as far as repeats arrive within ``late`` of each other.

    The watermark follows the time of arrival (``arrived_at``, the batch's time where the stream has no such column),
    so rows are never dropped for an old or missing ``created_at``.
    """
    at = stream if "arrived_at" in stream.columns else stream.withColumn("arrived_at", F.current_timestamp())
    return at.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["id"])


def counts_per_day(stream: DataFrame) -> DataFrame:
    """``workflow_id, day, n`` kept up to date; the state is one counter for each day and workflow."""
    day = F.date_trunc("day", "created_at").alias("day")
    return stream.where("created_at IS NOT NULL").groupBy("workflow_id", day).agg(F.count(F.lit(1)).alias("n"))


def sittings(stream: DataFrame, key: str, gap: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a stream: ``key, start, end, n`` once they can't grow any more."""
    windowed = stream.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def update_touched(stream: DataFrame, history: str, results: str, keys: list[str], aggregate, checkpoint: str):
    """Runs what is there and stops: appends each batch to ``history`` and aggregates its keys again from there.

    ``aggregate`` turns rows into results with ``keys``. Results are kept by batch number, so a batch that is run
    again after a failure replaces its own output; the latest batch holds for each key (see ``current``).
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")
        rows = spark.read.parquet(history).where(F.col("batch") <= number).drop("batch")
        changed = rows.join(batch.select(*keys).distinct(), keys, "left_semi")
        aggregate(changed).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, results: str, keys: list[str]) -> DataFrame:
    """The latest results of every key written by ``update_touched``."""
    rows = spark.read.parquet(results)
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).drop("batch")
