"""The audit history as append-only tables, and what is read from it.

``runs`` holds one row for each version of a run (run_id, seq, updated_at, ...), ``run_events`` one for each transition. State is
always the latest version, found with one grouping by run; history is never rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The legal transitions, the statuses that count as done, and the words for reason codes.
TRANSITIONS = [
    ("pending", "processing"), ("pending", "skipped"), ("pending", "failed"), ("processing", "planned"), ("processing", "quarantined"),
    ("processing", "failed"), ("planned", "applied"), ("planned", "quarantined"), ("planned", "failed"),
]
STATUSES = ["pending", "processing", "planned", "applied", "quarantined", "failed", "skipped"]
FOUND_STATUSES = ["planned", "applied", "skipped"]
IMMUTABLE = ["item_id", "content_hash", "policy_version", "batch_id", "created_at"]


def latest(runs: DataFrame) -> DataFrame:
    """One row per run_id: the version of the last (updated_at, seq), with the immutable columns of the first."""
    keep = [c for c in IMMUTABLE if c in runs.columns]
    rest = [c for c in runs.columns if c not in keep and c != "run_id"]
    order = F.struct("updated_at", "seq")
    out = runs.groupBy("run_id").agg(F.max_by(F.struct(*rest), order).alias("_now"), *([F.min_by(F.struct(*keep), order).alias("_first")] if keep else []))
    return out.select("run_id", *[F.col(f"_first.{c}").alias(c) for c in keep], *[F.col(f"_now.{c}").alias(c) for c in rest])


def append_events(history: DataFrame, new: DataFrame) -> DataFrame:
    """``history`` and the events of ``new`` that it lacks, by (run_id, seq)."""
    return history.unionByName(new.join(history.select("run_id", "seq"), ["run_id", "seq"], "left_anti").dropDuplicates(["run_id", "seq"]))


def load_runs(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Latest runs with their events in order."""
    listed = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event_type", "occurred_at"))).alias("events"))
    return latest(runs).join(listed, "run_id", "left")


def find_existing(items: DataFrame, runs: DataFrame) -> DataFrame:
    """``items`` (item_id, content_hash, policy_version) with the status and run of the latest planned, applied or skipped run of
    the same key. The top one is found by grouping the runs, so each side is shuffled once."""
    key = ["item_id", "content_hash", "policy_version"]
    top = runs.where(F.col("status").isin(FOUND_STATUSES)).groupBy(*key).agg(F.max_by(F.struct("run_id", "status"), F.struct("updated_at", "run_id")).alias("_top"))
    out = items.join(top, key, "left")
    return out.select(*items.columns, F.col("_top.run_id").alias("existing_run_id"), F.col("_top.status").alias("existing_status"))


def skips(status: Column) -> Column:
    """Only applied runs are skipped; planned and skipped ones are done again."""
    return F.coalesce(status == "applied", F.lit(False))


def batch_summary(runs: DataFrame) -> DataFrame:
    """One row per batch: runs by status, total, first start and last change, and the share that was applied."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    out = runs.groupBy("batch_id").agg(F.count("*").alias("total"), *counts, F.min("created_at").alias("started_at"), F.max("updated_at").alias("finished_at"))
    return out.withColumn("auto_apply_coverage", coverage(F.col("n_applied"), F.col("total")))


def coverage(accepted: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.try_divide(accepted, total))


def quarantined(runs: DataFrame, events: DataFrame, batch_id: str | None = None) -> DataFrame:
    out = load_runs(runs, events).where(F.col("status") == "quarantined")
    return out.where(F.col("batch_id") == batch_id) if batch_id else out


def transition_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string")


def illegal(transitions: DataFrame) -> DataFrame:
    """The rows of ``transitions`` (from_status, to_status, ...) that the state machine forbids. Its table has nine rows."""
    return transitions.join(F.broadcast(transition_table(transitions)), ["from_status", "to_status"], "left_anti")


def state_changes(events: DataFrame) -> DataFrame:
    """``events`` (run_id, seq, to_status) with from_status, the status before each, pending at first."""
    w = Window.partitionBy("run_id").orderBy("seq")
    return events.withColumn("from_status", F.lag("to_status", 1, "pending").over(w))


def transitions(wanted: DataFrame) -> DataFrame:
    """Requests (run_id, seq, from_status, to_status, occurred_at, ...) with the status they lead to, whether the run moved, and
    the event to append: state_transition with from and to. Illegal ones are ignored: the status stays and there is no event."""
    key = F.concat_ws(">", "from_status", "to_status")
    moved = F.coalesce(key.isin([f"{a}>{b}" for a, b in TRANSITIONS]), F.lit(False))
    event = F.struct(F.lit("state_transition").alias("event_type"), F.col("occurred_at"), F.create_map(F.lit("from"), "from_status", F.lit("to"), "to_status").alias("data"))
    return wanted.withColumns({"moved": moved, "status": F.when(moved, F.col("to_status")).otherwise(F.col("from_status")), "event": F.when(moved, event)})


def timestamp(text: Column, otherwise: Column | None = None) -> Column:
    """The time that an ISO text states, else ``otherwise`` (null; a caller may give the current time)."""
    found = F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}([T ].*)?$"), F.try_to_timestamp(text))
    return found if otherwise is None else F.coalesce(found, otherwise)


def with_data(events: DataFrame, json: str = "data") -> DataFrame:
    """``events`` with the JSON text of a column as a variant, so that events of different types keep data of different shapes; null if it
    isn't JSON."""
    return events.withColumn(json, F.try_parse_json(json))


def datum(path: str, kind: str, column: str = "data") -> Column:
    """The value at a path of an event's data as ``kind``; null if the path isn't there or holds something else."""
    return F.try_variant_get(column, path, kind)


def data_shapes(events: DataFrame, by: str = "event_type", column: str = "data") -> DataFrame:
    """(by, shape, n): the common schema of the data of each type, found with partial aggregation."""
    return events.groupBy(by).agg(F.schema_of_variant_agg(column).alias("shape"), F.count(column).alias("n"))


def quarantine_reason(codes: Column, words: dict[str, str]) -> Column:
    """'quarantined: ' and the words of the codes, or a sentence that there is none."""
    names = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.when(F.size(codes) > 0, F.concat(F.lit("quarantined: "), F.array_join(F.transform(codes, lambda c: F.coalesce(names[c], c)), "; "))).otherwise("quarantined: no specific reason recorded")


# What each reason code is called in a quarantine reason.
REASON_WORDS = {
    "missing_required_field": "one or more required fields could not be extracted",
    "low_confidence": "extraction confidence is below the review threshold",
    "invalid_date": "extracted date value is invalid",
    "invalid_amount": "extracted amount value is invalid",
    "invalid_currency": "extracted currency code is not a known ISO 4217 code",
    "ambiguous_currency": "currency is ambiguous and cannot be inferred safely",
    "cross_field_inconsistency": "extracted fields are internally inconsistent",
    "unsupported_mime": "file type is not supported",
    "corrupt_file": "file is corrupt or cannot be read",
    "encrypted_file": "file is password-protected or encrypted",
    "empty_file": "file is empty",
    "ocr_quality_too_low": "OCR text quality is too low for reliable extraction",
    "etag_mismatch": "file was modified since it was downloaded",
    "collision": "proposed filename already exists at the destination",
    "already_processed": "document has already been processed with this policy",
    "policy_mismatch": "document does not match the configured policy",
}
