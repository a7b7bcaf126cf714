"""Incremental ingestion as Structured Streaming: each run takes what is new, judges it, loads it and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.operators.contracts import Contract, judge


def json_stream(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """JSON lines of a folder as they come: the columns as text, the payload as it came, and the file."""
    lines = spark.readStream.schema("value string").text(folder)
    fields = [F.get_json_object("value", f"$.{c}").alias(c) for c in columns]
    return lines.select(*fields, F.col("value").alias("payload"), F.col("_metadata.file_name").alias("source_file"))


def run_available(stream: DataFrame, contract: Contract, key: str, fact: str, quarantine: str, checkpoint: str) -> None:
    """Takes all new files: accepted rows whose key the fact lacks are appended, the others quarantined with reasons.

    A batch that is replayed after a failure appends nothing twice: rows are anti-joined with the fact, and quarantine
    is written per batch number.
    """

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        judged = judge(batch, contract)
        good = judged.filter("reason is null").drop("reason").dropDuplicates([key])
        try:
            good = good.join(spark.read.parquet(fact).select(key), key, "left_anti")
        except Exception as e:  # the fact does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        good.write.mode("append").parquet(fact)
        judged.filter("reason is not null").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    q = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def distinct_events(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Drops repeats of a key within the watermark, so the state is bounded by the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str, delay: str) -> DataFrame:
    """Events by kind and tumbling window; late ones count until the watermark passes."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
