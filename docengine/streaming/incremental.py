"""Extensions: incremental discovery and windows over event times, the same code for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.policy import Policy
from ..plans.run import analyse
from ..sources.local import detect_type, supported


def new_files(spark: SparkSession, folder: str, max_age: str = "36500d") -> DataFrame:
    """A stream of the supported files of a folder, each path once, however old it is and whatever came before it.

    Files of equal content are files each; copies that were applied are told by the idempotency key of a batch. ``max_age`` is how much
    older than the newest file one may be and still be found; paths are remembered for as long."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFileAge", max_age).load(folder)
    return files.where(supported(detect_type(F.col("path"), F.col("content")))).withColumn("content_hash", F.sha2("content", 256))


def analyse_stream(docs: DataFrame, policy: Policy, out: str, checkpoint: str) -> StreamingQuery:
    """Analyse a stream of (…, text) rows into Parquet, once with what there is."""
    return analyse(docs, policy).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, width: str, key: str, value: str, late: str | None = None) -> DataFrame:
    """(start, key, n, total) by windows of equal width."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n) of runs of events that are less than ``gap`` apart."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
