"""Usage events and job statuses as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import mask


def masked_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """A stream of event files, masked by consent (even user numbers consent). Back-pressure comes from the number of
    files a trigger; nothing is dropped (``operators.collections.bounded_burst`` drops as a bounded queue does)."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    shaped = raw.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("tool_name"), F.col("props").alias("metadata"),
        F.lit(None).cast("string").alias("prompt_text"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
    )
    return mask(shaped, F.col("user_id") % 2 == 0)


def write_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what is there and stop; exactly once, by the file sink's log."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(out)


def each_batch(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> list[str]:
    """Write what is there batch by batch, each to a folder of its own named by its number, and stop; gives the folders. A batch
    that is done again after a failure replaces its folder, so its rows are there once."""
    written: list[str] = []

    def sink(rows: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        written.append(path)

    stream.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).start().awaitTermination()
    return written


def last_statuses(statuses: DataFrame, job: str, status: str, order: str) -> DataFrame:
    """The last status of each job, of a stream of status rows; the state is one row a job."""
    return statuses.groupBy(job).agg(F.max_by(status, order).alias("last_status"), F.max(order).alias("last_order"))


def tool_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Extension: events by tool and day; events later than the watermark are left out."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "tool_name").count()
