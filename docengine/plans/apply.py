"""Apply approved plans of the history: gate, decision, journaled renames, and the runs and events that record them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import journal, local
from . import audit, run
from .history import PLANS, History

#: The query that applied batches are recorded under.
APPLY = "apply"


def apply_plans(history: History, plans: DataFrame, listing: DataFrame, batch: int, root: str = "", compat: bool = False) -> DataFrame:
    """Rename the files of ``plans`` (rows of the plans table) whose run is still planned, and record what became of them.

    ``listing`` is (path, etag) of the files as they are. The journal is a folder of the history; a batch that is stopped at any
    step goes on from there when it is started again, and one that is complete is left alone. A renamed file's run is applied; others stay planned
    and get an event apply_refused with the outcome. Returns (run_id, path, proposed_path, outcome)."""
    at = f"{history.root}/journals/batch={batch}"
    spark = history.spark
    runs = audit.latest(history.read("runs").drop("query", "batch"))
    if not history.has(APPLY, batch):
        gated = run.apply_gate(plans, runs, compat).select("run_id", "path", "proposed_path", F.lit("rename").alias("op"), F.col("content_hash").alias("etag"), F.lit(False).alias("dry_run"))
        decided = local.decide(gated, listing)
        if not journal._written(spark, f"{at}/decided"):
            decided.select("run_id", "path", "proposed_path", "etag", "decision").write.mode("overwrite").parquet(f"{at}/decided")
    decided = spark.read.schema("run_id string, path string, proposed_path string, etag string, decision string").parquet(f"{at}/decided")
    if not history.has(APPLY, batch):
        journal.intend(decided, at, root)
        journal.carry_out(spark, at)
    done = spark.read.schema(journal.OUTCOMES).parquet(f"{at}/outcomes").dropDuplicates(["path", "proposed_path"])
    outcomes = decided.join(done, ["path", "proposed_path"], "left").select("run_id", "path", "proposed_path", F.coalesce("outcome", "decision").alias("outcome"))
    if not history.has(APPLY, batch):
        moved = F.col("outcome") == "renamed"
        now = runs.join(outcomes.select("run_id", "outcome", F.col("proposed_path").alias("to")), "run_id")
        new = now.where(moved).withColumns({"seq": F.col("seq") + 1, "status": F.lit("applied"), "applied_path": F.col("to")})
        history.write("runs", APPLY, batch, new)
        data = F.when(moved, F.create_map(F.lit("from"), F.lit("planned"), F.lit("to"), F.lit("applied"))).otherwise(F.create_map(F.lit("outcome"), F.col("outcome")))
        kind = F.when(moved, "state_transition").otherwise("apply_refused")
        history.write("events", APPLY, batch, now.select("run_id", (F.col("seq") + 1).alias("seq"), kind.alias("event_type"), F.col("updated_at").alias("occurred_at"), data.alias("data")))
        history.write("plans", APPLY, batch, history.spark.createDataFrame([], PLANS))
        history.commit(APPLY, batch, new.count())
    return outcomes
