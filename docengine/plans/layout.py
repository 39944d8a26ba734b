"""The audit history laid out by key, so that reading it moves none of its rows.

``runs`` and ``run_events`` are bucketed and sorted by run_id, with the same number of buckets, so versions of a run and its events lie in
files of one number and are grouped and joined where they are. ``current``, the newest version of each run, is bucketed by the idempotency key, so
only the items that ask for earlier runs are shuffled. Choose the number of buckets so that one fits into a task: 100 TB in 100,000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit

KEY = ["item_id", "content_hash", "policy_version"]
#: (bucketed by, sorted by) of each table.
LAYOUT = {"runs": (["run_id"], ["run_id", "updated_at", "seq"]), "run_events": (["run_id"], ["run_id", "seq"]), "current": (KEY, KEY)}


class Laid:
    """Tables ``<name>_runs``, ``<name>_run_events`` and ``<name>_current`` of the session's catalog, with their files below ``root``."""

    def __init__(self, spark: SparkSession, name: str, root: str, buckets: int) -> None:
        self.spark, self.name, self.root, self.buckets = spark, name, root.rstrip("/"), buckets

    def add(self, table: str, rows: DataFrame) -> DataFrame:
        """Append rows, one file a bucket: they're dealt by the function that buckets are numbered by."""
        by, order = LAYOUT[table]
        dealt = rows.repartition(self.buckets, *by).write.mode("append").option("path", f"{self.root}/{table}")
        dealt.bucketBy(self.buckets, by).sortBy(order).saveAsTable(f"{self.name}_{table}")
        return self.read(table)

    def read(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def compacted(self, name: str, root: str) -> Laid:
        """A new history with one file a bucket again and ``current`` made anew. The old one stays as it is until the caller drops it, so
        a failure on the way loses nothing."""
        new = Laid(self.spark, name, root, self.buckets)
        for table in ("runs", "run_events"):
            # Read as plain files: from the table, the shuffle that makes one file a bucket would be left out as one that is there already.
            new.add(table, self.spark.read.schema(self.read(table).schema).parquet(f"{self.root}/{table}"))
        new.add("current", audit.latest(new.read("runs")))
        return new

    def latest(self) -> DataFrame:
        """A02."""
        return audit.latest(self.read("runs"))

    def load(self) -> DataFrame:
        """A04."""
        return audit.load_runs(self.read("runs"), self.read("run_events"))

    def existing(self, items: DataFrame) -> DataFrame:
        """A05, of the runs as they were when ``current`` was made."""
        return audit.find_existing(items, self.read("current"))

    def drop(self) -> None:
        """Take the tables out of the catalog; their files stay, as they do for every table with a path."""
        for table in LAYOUT:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")


def exchanged(df: DataFrame) -> list[str]:
    """What the physical plan of ``df`` shuffles: for each Exchange its line of the plan. Empty if all rows stay where they are."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def versions(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, run_events) of rows that are both: each version with the event that led to it."""
    return runs, runs.select("run_id", "seq", F.col("status").alias("event_type"), F.col("updated_at").alias("occurred_at"))
