"""Normalization, per-field status, cross-field checks, score and status of extracted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.text import apart
from ..plans.policy import Policy

#: Reason code of an invalid value by field type.
INVALID = {"date": "invalid_date", "decimal": "invalid_amount", "currency": "invalid_currency"}
MISSING, LOW, INCONSISTENT = "missing_required_field", "low_confidence", "cross_field_inconsistency"


def normalize_fields(df: DataFrame, policy: Policy, pivot: int = normalize.PIVOT_YEAR) -> DataFrame:
    """``df`` with norm_<field> (text) and adj_<field> (confidence after adjustment, within 0 and 1) for each raw_<field>."""
    both = {f.id: normalize.normalized(f.type, F.col(f"raw_{f.id}"), pivot) for f in policy.fields}
    df = df.withColumns({f"norm_{f}": F.when(F.col(f"raw_{f}").isNotNull(), value) for f, (value, _) in both.items()})
    return df.withColumns({f"adj_{f}": F.when(F.col(f"norm_{f}").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"conf_{f}") + change))) for f, (_, change) in both.items()})


def field_status(policy: Policy, field: str) -> Column:
    low = F.col(f"adj_{field}") < policy.thresholds.manual_review
    return F.when(F.col(f"raw_{field}").isNull(), "missing").when(F.col(f"norm_{field}").isNull(), "invalid").when(low, LOW).otherwise("ok")


def validate(df: DataFrame, policy: Policy, pivot: int = normalize.PIVOT_YEAR) -> DataFrame:
    """``df`` (raw_, conf_ columns) with norm_, adj_ and status_ columns, field_codes (field -> codes), reason_codes, overall and
    validation_status.

    The score adds weighted confidences in the order of the policy's fields, so it is the same to the last bit everywhere."""
    df = normalize_fields(df, policy, pivot)
    df = df.withColumns({f"status_{f.id}": apart(field_status(policy, f.id)) for f in policy.fields})
    none = F.array().cast("array<string>")

    def codes(f) -> Column:  # noqa: ANN001
        s = F.col(f"status_{f.id}")
        missing = F.array(F.lit(MISSING)) if f.required else none
        return F.when(s == "missing", missing).when(s == "invalid", F.array(F.lit(INVALID.get(f.type, MISSING)))).when(s == LOW, F.array(F.lit(LOW))).otherwise(none)

    df = df.withColumn("field_codes", apart(F.create_map(*[x for f in policy.fields for x in (F.lit(f.id), codes(f))])) if policy.fields else F.lit(None).cast("map<string,array<string>>"))
    ids = {f.id for f in policy.fields}
    across = F.lit(False)
    if {"invoice_date", "due_date"} <= ids:
        across = F.coalesce(F.col("norm_due_date") < F.col("norm_invoice_date"), F.lit(False))
    reasons = F.concat(none, *[codes(f) for f in policy.fields if f.required], F.when(across, F.array(F.lit(INCONSISTENT))).otherwise(none))
    score, weight = F.lit(0.0), F.lit(0.0)
    for f in policy.fields:
        full = 2.0 if f.required else 1.0
        score = score + F.when(F.col(f"status_{f.id}").isin("ok", LOW), F.col(f"adj_{f.id}") * full).otherwise(0.0)
        weight = weight + F.when((F.col(f"status_{f.id}") == "missing") & F.lit(not f.required), 0.0).otherwise(full)
    total = F.when(weight == 0.0, 0.0).otherwise(F.try_divide(score, weight))
    df = df.withColumns({"reason_codes": apart(reasons), "overall": apart(total)})
    broken = F.lit(False)
    for f in policy.fields:
        if f.required:
            broken = broken | F.col(f"status_{f.id}").isin("missing", "invalid")
    t = policy.thresholds
    status = F.when(broken, "rejected").when(F.col("overall") >= t.auto_apply, "accepted").when(F.col("overall") >= t.manual_review, "review").otherwise("rejected")
    return df.withColumn("validation_status", apart(status))
