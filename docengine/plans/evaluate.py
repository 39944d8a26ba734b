"""Accuracy against a golden manifest, and the measures that build on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GATE = 0.90


def compare(manifest: DataFrame, results: DataFrame, fields: list[str]) -> DataFrame:
    """(path, field_id, expected, actual, correct) for each field of each manifest row (path, expected map). correct is null where
    nothing is expected; a document without results is wrong in every expected field."""
    m = manifest.select("path", "expected")
    r = results.select("path", F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"norm_{f}").cast("string"))]).alias("actual"))
    rows = m.join(r, "path", "left").select("path", "expected", "actual", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_id"))
    expected, actual = F.trim(F.col("expected")[F.col("field_id")]), F.trim(F.col("actual")[F.col("field_id")])
    return rows.select("path", "field_id", expected.alias("expected"), actual.alias("actual"), F.when(expected.isNotNull(), F.coalesce(actual == expected, F.lit(False))).alias("correct"))


def field_accuracy(compared: DataFrame, gate: float = GATE) -> DataFrame:
    """(field_id, n_correct, n_docs, accuracy, passes); all documents count, also those that expect nothing of the field."""
    out = compared.groupBy("field_id").agg(F.count_if("correct").alias("n_correct"), F.count("*").alias("n_docs"))
    out = out.withColumn("accuracy", F.try_divide("n_correct", "n_docs"))
    return out.withColumn("passes", F.col("accuracy") >= gate)


def document_accuracy(compared: DataFrame) -> DataFrame:
    """(path, all_correct): no expected field is wrong."""
    return compared.groupBy("path").agg(F.bool_and(F.coalesce("correct", F.lit(True))).alias("all_correct"))


def gate_fails(accuracy: DataFrame) -> bool:
    """Whether any field misses the gate; also without documents."""
    row = accuracy.agg(F.count("*").alias("n"), F.bool_or(~F.col("passes")).alias("bad")).first()
    return not row["n"] or bool(row["bad"])


# -- extensions: measures that are planned but nowhere built --------------------------------------------------------


def slices(results: DataFrame, *by: str) -> DataFrame:
    """Documents, accepted ones and mean score by every prefix of ``by`` (rollup); '(all)' stands for a total."""
    out = results.rollup(*by).agg(F.count("*").alias("n_docs"), F.count_if(F.col("validation_status") == "accepted").alias("n_accepted"), F.round(F.avg("overall"), 6).alias("avg_overall"), F.grouping_id().alias("level"))
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(all)")).alias(c) for c in by], "n_docs", "n_accepted", "avg_overall", "level")


def coverage_at_threshold(scored: DataFrame, steps: int = 20) -> DataFrame:
    """(threshold, n_covered, n_correct, coverage, error) of (overall, all_correct) rows: what an auto-apply threshold would let
    through. Scores are counted per step first, so the cumulative window sees a row per step."""
    step = F.least(F.floor(F.col("overall") * steps), F.lit(steps)).cast("int")
    per = scored.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.count_if("all_correct").alias("ok"))
    every = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step")).join(F.broadcast(per), "step", "left").na.fill(0)
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    out = every.select("step", F.sum("n").over(down).alias("n_covered"), F.sum("ok").over(down).alias("n_correct"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return out.select((F.col("step") / steps).alias("threshold"), "n_covered", "n_correct", F.round(F.try_divide("n_covered", "total"), 6).alias("coverage"), F.round(F.try_divide(F.col("n_covered") - F.col("n_correct"), F.col("n_covered")), 6).alias("error"))


def character_error(compared: DataFrame) -> DataFrame:
    """(field_id, n, edits, chars, cer): edit distance of actual to expected values over their length."""
    rows = compared.where("expected is not null").select("field_id", F.levenshtein(F.coalesce("actual", F.lit("")), F.col("expected")).alias("e"), F.length("expected").alias("c"))
    return rows.groupBy("field_id").agg(F.count("*").alias("n"), F.sum("e").alias("edits"), F.sum("c").alias("chars"), F.round(F.try_divide(F.sum("e"), F.sum("c")), 6).alias("cer"))
