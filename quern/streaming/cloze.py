"""The cloze pipeline over files that arrive one after another."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.plans.cloze import pairs


def source(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def unique_pairs(texts: DataFrame, event_time: str | None = None, watermark: str = "1 day") -> DataFrame:
    """Accepted pairs, each key once. Without event_time the keys of all time are kept as state;
    with it, only those within the watermark."""
    kept = pairs(texts, F.col("text")).kept
    if event_time:
        return kept.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["dedup_hash"])
    return kept.dropDuplicates(["dedup_hash"])


def reason_counts(texts: DataFrame) -> DataFrame:
    """Running counts by reason, for complete mode."""
    return pairs(texts, F.col("text")).rows.groupBy("reason").count()


def run(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is available and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _accepted(spark: SparkSession, path: str) -> dict[int, int]:
    """Rows written by batch number; none where nothing is written yet."""
    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except AnalysisException:
        return {}
    return {r["batch"]: r["n"] for r in rows.groupBy("batch").agg(F.count("*").alias("n")).collect()}


def run_until(stream: DataFrame, path: str, checkpoint: str, cap: int, position: str | None = None) -> int:
    """Writes batches until cap rows are accepted in all; returns how many are written.

    What earlier runs wrote counts, so a restart from the checkpoint goes on to the same
    cap; a batch that is delivered again replaces itself. Of the batch in which the cap is
    reached only as many rows are written as are missing, by position (any column that
    orders the rows; the content key where there is none).
    """
    spark = stream.sparkSession
    have = _accepted(spark, path)

    def write(batch: DataFrame, n: int) -> None:
        left = cap - sum(v for k, v in have.items() if k < n)
        if left <= 0:
            batch.write.format("noop").mode("overwrite").save()
            return
        batch.orderBy(position or "dedup_hash").limit(left).write.mode("overwrite").parquet(f"{path}/batch={n}")
        have[n] = batch.sparkSession.read.parquet(f"{path}/batch={n}").count()

    if sum(have.values()) >= cap:
        return sum(have.values())
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(1):
        if sum(have.values()) >= cap:
            query.stop()
    return sum(have.values())
