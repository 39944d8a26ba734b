"""Shared helpers: table access, Arrow passes over texts, and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch handled at once; a batch's texts are the only ones a Python worker holds.
SLICE_ROWS = 256
#: Bytes of data in a table that is broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers, which otherwise hold 10,000 texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE_ROWS))


def map_batches(df: DataFrame, columns: list[str], schema: T.StructType | str, fn: Callable[[pa.RecordBatch], Any]) -> DataFrame:
    """Run ``fn`` on Arrow batches of ``columns`` only; a narrow pass with no shuffle. ``fn`` returns a record batch or yields several."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(at, SLICE_ROWS))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.select(*columns).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. It is set here only where a local session has none (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = "/tmp/docengine-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Shelf:
    """Parquet tables in the shared folder that cut a plan's lineage; they outlive any executor.

    ``put`` writes and rereads; ``drop`` deletes what a later table replaces.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docengine-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_shelf_path", None)
        if path:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """A stored table, marked for broadcast if it has at most BROADCAST_BYTES; beyond that Spark shuffles both sides of its join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES else df


def text_key(text: str = "text") -> list:
    """128 bits that stand for a text, as two longs; equal texts share them, others practically never."""
    return [F.xxhash64(F.lit(1), F.col(text)), F.xxhash64(F.lit(2), F.col(text))]
