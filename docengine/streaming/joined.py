"""Two streams joined by time: files, and the results that come for them within a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_results(files: DataFrame, results: DataFrame, key: str, arrived: str, finished: str, within: str, lateness: str | None = None) -> DataFrame:
    """Each row of ``files`` with each of ``results`` of the same key that finished from its arrival to ``within`` later (an interval, ends
    included), or with nulls if there is none. Column names other than the key have to differ. Null keys and times match nothing.

    On tables this is an ordinary join. On streams, rows wait as long as a partner can still come: once the watermark, ``lateness`` behind the
    slower stream, has passed a file's last moment, the file leaves the state, alone if it met no result. Rows later than that are
    dropped, as Spark counts in the query's progress."""
    other = results.withColumnRenamed(key, "_key")
    if lateness:
        files, other = files.withWatermark(arrived, lateness), other.withWatermark(finished, lateness)
    near = F.expr(f"`{key}` = _key AND `{finished}` >= `{arrived}` AND `{finished}` <= `{arrived}` + INTERVAL {within}")
    return files.join(other, near, "leftOuter").drop("_key")


def start(joined: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write a joined stream as Parquet, taking what there is."""
    return joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
