"""Golden manifests and plan files as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a plan that is one JSON document.
PLAN_ROWS = 10_000
MANIFEST = "path string, expected map<string,string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines manifest; blank lines are left out."""
    return spark.read.schema(MANIFEST).json(path).where("path is not null")


def missing_paths(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose file isn't there; they're reported as skipped."""
    return manifest.join(listing.select("path"), "path", "left_anti")


def write_plan(runs: DataFrame, batch_id: str, path: str) -> None:
    """One JSON object a line for each run of a batch."""
    runs.where(F.col("batch_id") == batch_id).write.mode("overwrite").json(path)


def plan_array(runs: DataFrame, batch_id: str) -> DataFrame:
    """One row with the batch's runs as a JSON array, for plans of at most PLAN_ROWS runs, which is checked; write_plan has no bound."""
    rows = runs.where(F.col("batch_id") == batch_id)
    if rows.limit(PLAN_ROWS + 1).count() > PLAN_ROWS:
        raise ValueError(f"batch {batch_id} has more than {PLAN_ROWS} runs: use write_plan")
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(rows.columns))))).alias("plan"))


def read_plan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
