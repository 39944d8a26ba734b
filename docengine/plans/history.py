"""The audit history as stored tables that batches are added to exactly once, and the batch driver that does so.

A batch, named by its query and number, owns one folder in each table. Its marker is written last: rows without a marker aren't read, a batch
with a marker isn't done again, and one that was stopped before is written anew, over what it left. So after any failure a repeat
leaves the same tables as a run without one, whichever step it was stopped at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import audit, run
from .policy import Policy

#: The tables, with the columns of the audit store: versions of runs, their events, and what was planned.
RUNS = (
    "run_id string, seq long, batch_id string, item_id string, path string, content_hash string, policy_version string, schema_version string, status string, doc_type string, overall double, "
    "proposed_path string, applied_path string, category string, reason string, created_at timestamp, updated_at timestamp"
)
EVENTS = "run_id string, seq long, event_type string, occurred_at timestamp, data map<string,string>"
PLANS = (
    "run_id string, batch_id string, item_id string, path string, content_hash string, policy_version string, schema_version string, status string, doc_type string, overall double, validation_status string, "
    "reason_codes array<string>, reason string, proposed_path string, category string, op string, dry_run boolean, arrived_at timestamp"
)
SCHEMAS = {"runs": RUNS, "events": EVENTS, "plans": PLANS}
MARKERS = "query string, batch long, n_runs long"


class History:
    """Tables below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, table: str) -> DataFrame:
        """The rows of all batches that are complete; an empty table before the first. Their folders are named one by one, so that a batch which
        is being written over isn't even listed."""
        schema = f"{SCHEMAS[table]}, query string, batch long"
        paths = [self._of(table, r.query, r.batch) for r in self.markers().select("query", "batch").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def markers(self) -> DataFrame:
        """(query, batch, n_runs) of all complete batches."""
        if not self._exists(f"{self.root}/markers"):
            return self.spark.createDataFrame([], MARKERS)
        return self.spark.read.schema(MARKERS).option("basePath", f"{self.root}/markers").parquet(f"{self.root}/markers")

    def has(self, query: str, batch: int) -> bool:
        return self._exists(f"{self._of('markers', query, batch)}/_SUCCESS")

    def write(self, table: str, query: str, batch: int, rows: DataFrame) -> DataFrame:
        """The rows of a batch in one table, over what an attempt before has left there; read again as stored."""
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        path = self._of(table, query, batch)
        rows.select(*names).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(SCHEMAS[table]).parquet(path)

    def commit(self, query: str, batch: int, n_runs: int) -> None:
        self.spark.range(1).select(F.lit(n_runs).cast("long").alias("n_runs")).coalesce(1).write.mode("overwrite").parquet(self._of("markers", query, batch))

    def _of(self, table: str, query: str, batch: int) -> str:
        return f"{self.root}/{table}/query={query}/batch={batch}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def steps(status: Column, refused: Column) -> Column:
    """The transitions that a run of this batch has made, as from>to."""
    to = {"skipped": ["pending>skipped"], "failed": ["pending>processing", "processing>failed"], "quarantined": ["pending>processing", "processing>quarantined"], "planned": ["pending>processing", "processing>planned"]}
    path = F.when(refused, F.array(*map(F.lit, [*to["planned"], "planned>quarantined"])))
    for s, way in to.items():
        path = path.when(status == s, F.array(*map(F.lit, way)))
    return path


def newest(items: DataFrame) -> DataFrame:
    """One row an item: an item that comes several times in a batch is treated as its newest version."""
    order = Window.partitionBy("item_id").orderBy(F.desc("arrived_at"), "content_hash", "path")
    return items.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def add_batch(history: History, items: DataFrame, policy: Policy, query: str, batch: int, apply: bool = False) -> bool:
    """Plan ``items`` (item_id, path, content_hash, mime, text, error, arrived_at) and add plan, runs and events; False if that was done
    before. Documents are analysed once: the plan is stored first, and runs and events come from it. All times are those of arrival, so that
    a repeat gives the same rows."""
    if history.has(query, batch):
        return False
    before = audit.latest(history.read("runs").drop("query", "batch"))
    one = newest(items)
    times = one.select("item_id", "arrived_at")
    plans = run.plan(one.drop("arrived_at"), policy, f"{query}-{batch}", before, apply).join(times, "item_id")
    plans = history.write("plans", query, batch, plans)
    refused = F.lit(apply) & (F.col("status") == "quarantined") & ~F.array_contains("reason_codes", "unsupported_mime")
    made = plans.withColumn("steps", steps(F.col("status"), refused))
    runs = made.select("*", F.size("steps").cast("long").alias("seq"), F.lit(None).cast("string").alias("applied_path"), F.col("arrived_at").alias("created_at"), F.col("arrived_at").alias("updated_at"))
    history.write("runs", query, batch, runs)
    moves = made.select("run_id", "arrived_at", F.posexplode("steps").alias("at", "step")).withColumn("step", F.split("step", ">"))
    data = F.create_map(F.lit("from"), F.col("step")[0], F.lit("to"), F.col("step")[1])
    history.write("events", query, batch, moves.select("run_id", (F.col("at") + 1).cast("long").alias("seq"), F.lit("state_transition").alias("event_type"), F.col("arrived_at").alias("occurred_at"), data.alias("data")))
    history.commit(query, batch, plans.count())
    return True


def run_batches(docs: DataFrame, policy: Policy, history: History, query: str, checkpoint: str, apply: bool = False) -> StreamingQuery:
    """Treat a stream of items in batches, each added once, and take what there is. A batch that fails is repeated by the next start."""

    def one(items: DataFrame, batch: int) -> None:
        add_batch(history, items, policy, query, batch, apply)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries(history: History) -> DataFrame:
    """Each batch's counts, times and coverage, over the newest versions of its runs."""
    return audit.batch_summary(audit.latest(history.read("runs").drop("query", "batch")))
