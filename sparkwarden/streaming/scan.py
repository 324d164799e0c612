"""Continuous scan: new rows of text are scanned as they arrive, each fingerprint keeps its state.

``scan_stream`` runs the text detectors on every micro-batch of a folder and
merges their findings into a state table by fingerprint (new, unchanged); the
merge reads the last committed version and writes the next, so a batch that is
replayed gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as FI


def _last(spark: SparkSession, state: str, before: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [int(f.getPath().getName()[1:]) for f in fs.listStatus(path) if f.getPath().getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    done = [v for v in done if v < before]
    return spark.read.parquet(f"{state}/v{max(done)}") if done else None


def merge(known: DataFrame | None, found: DataFrame, batch: int) -> DataFrame:
    """``fingerprint, code, name, file, first_batch, last_batch`` after one batch."""
    new = found.select("fingerprint", "code", "name", "file").dropDuplicates(["fingerprint"]).withColumn("first_batch", F.lit(batch)).withColumn("last_batch", F.lit(batch))
    if known is None:
        return new
    both = known.unionByName(new)
    return both.groupBy("fingerprint").agg(F.first("code").alias("code"), F.first("name").alias("name"), F.first("file").alias("file"), F.min("first_batch").alias("first_batch"), F.max("last_batch").alias("last_batch"))


def scan_stream(stream: DataFrame, state: str, checkpoint: str, pack: list | None = None, available_now: bool = True):
    """Starts the scan of a stream of ``doc_id, text, source`` rows; returns the query."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = FI.text_findings(batch, pack)
        found = found.withColumn("fingerprint", FI.fingerprint(found))
        merge(_last(spark, state, number), found, number).write.mode("overwrite").parquet(f"{state}/v{number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type and window behind a watermark; closed windows are final."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
