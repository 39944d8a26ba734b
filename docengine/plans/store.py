"""Tables in the session's shared checkpoint folder that cut a plan's lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local session without one (tests) gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/docengine-checkpoints"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again. Proposals are expressions of hundreds of patterns: a join with them is planned on
    the stored columns, and a lost executor costs no second analysis."""
    path = shared(df.sparkSession, "plans")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
