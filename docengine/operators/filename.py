"""Fields from file names of the form ``YYYYMMDD - Vendor - Type Ref - R1,234.56 - Entity.pdf``, and their merge with content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import strip

CI = "(?iUd)"
FIELDS = ["invoice_date", "organization_name", "invoice_number", "total_amount", "currency"]


def stem(name: Column) -> Column:
    """The name without its folder and without any extensions of two to five characters."""
    return F.regexp_replace(F.substring_index(name, "/", -1), "(?U)" + P.EXTENSIONS, "")


def segment_type(segment: Column) -> Column:
    out: Column = F.lit("unknown")
    for pattern, name in reversed(P.FILENAME_TYPES):
        out = F.when(segment.rlike(CI + pattern), name).otherwise(out)
    return out


def segment_reference(segment: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(segment, CI + p, 1), F.lit("")) for p in P.FILENAME_REFERENCES])


def parse(df: DataFrame, name: str = "filename") -> DataFrame:
    """``df`` with parsed (whether the name has the form), doc_type, doc_confidence, and raw_/conf_ columns of FIELDS."""
    df = df.withColumn("_stem", stem(F.coalesce(F.col(name), F.lit(""))))
    df = df.withColumn("parsed", F.col("_stem").rlike(CI + P.FILENAME))
    part = lambda i: strip(F.regexp_extract("_stem", CI + P.FILENAME, i))
    df = df.withColumn("_part", F.when(F.col("parsed"), F.struct(*[part(i).alias(f"p{i}") for i in range(1, 5)])))
    p = lambda i: F.col(f"_part.p{i}")
    amount = strip(F.regexp_replace(p(4), "^[Rr]+", ""))
    raw = {
        "invoice_date": F.concat_ws("-", F.substring(p(1), 1, 4), F.substring(p(1), 5, 2), F.substring(p(1), 7, 2)),
        "organization_name": F.nullif(p(2), F.lit("")),
        "invoice_number": segment_reference(p(3)),
        "total_amount": F.when(amount.rlike("(?U)\\d"), amount),
        "currency": F.lit("ZAR"),
    }
    df = df.withColumns({f"raw_{k}": F.when(F.col("parsed"), v) for k, v in raw.items()})
    df = df.withColumns({f"conf_{k}": F.when(F.col(f"raw_{k}").isNotNull(), P.FILENAME_CONFIDENCE) for k in FIELDS})
    known = {"doc_type": F.when(F.col("parsed"), segment_type(p(3))), "doc_confidence": F.when(F.col("parsed"), P.FILENAME_CONFIDENCE)}
    return df.withColumns(known).drop("_stem", "_part")


def merge(from_name: DataFrame, content: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key of either side: each field from the name if it is there, else from the content; the type from the name
    unless that is unknown; versions joined with '+'. One shuffle of each side by key."""
    left, right = from_name.alias("n"), content.alias("c")
    named = F.col("n.parsed")
    out = left.join(right, F.col(f"n.{key}") == F.col(f"c.{key}"), "full")
    use = F.coalesce(named & (F.col("n.doc_type") != "unknown"), F.lit(False))
    own = {c[4:] for c in from_name.columns if c.startswith("raw_")}

    def pick(prefix: str, f: str) -> Column:
        c = F.col(f"c.{prefix}_{f}")
        if f not in own:
            return c
        return F.when(F.col(f"n.raw_{f}").isNotNull(), F.col(f"n.{prefix}_{f}")).otherwise(c)

    versions = F.concat_ws("+", F.when(named, F.lit("filename-v1")), F.when(F.col(f"c.{key}").isNotNull(), F.lit("rules-v1")))
    return out.select(
        F.coalesce(f"n.{key}", f"c.{key}").alias(key),
        F.when(use, F.col("n.doc_type")).otherwise(F.coalesce("c.doc_type", "n.doc_type")).alias("doc_type"),
        F.when(use, F.col("n.doc_confidence")).otherwise(F.coalesce("c.doc_confidence", "n.doc_confidence")).alias("doc_confidence"),
        *[pick(p, f).alias(f"{p}_{f}") for f in fields for p in ("raw", "conf")],
        versions.alias("extractor_version"),
    )
