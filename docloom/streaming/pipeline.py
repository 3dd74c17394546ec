"""The stateless path on a stream: payloads to coded texts, late and repeated
deliveries dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import envelope, nested


def read_stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files (or one file) as a stream with the schema of ``like``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        path = f"{path[:-1]}[{path[-1]}]"  # a pattern that only this file matches
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(payloads: DataFrame, key: list[str], at: str = "received_at", lateness: str = "7 days") -> DataFrame:
    """Deliveries once per key within the watermark."""
    return payloads.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)


def codes(payloads: DataFrame) -> DataFrame:
    """``(raw_id, page, error, message, n_elements, code)`` of every response; no
    window and no state, so it runs unchanged on batches and streams."""
    return envelope.coded(nested.responses(payloads))


def box_texts(payloads: DataFrame) -> DataFrame:
    """``(raw_id, box_path, text)``: canonical box texts, one row per box."""
    return nested.boxes(payloads).where("text is not null").select("raw_id", "box_path", tx.canonical(F.col("text")).alias("text"))


def hourly(events: DataFrame, at: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Events per hour and type behind a watermark."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, "1 hour").alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there, exactly once, to a Parquet folder."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_whole(stream: DataFrame, path: str, checkpoint: str) -> None:
    """As :func:`run` for results that change: each trigger writes the whole result anew."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
