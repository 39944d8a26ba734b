"""The whole treatment of documents as one lazy plan, and decisions on what it proposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.text import strip
from ..operators import extract as x
from ..operators.classify import classify
from ..operators.validate import validate
from . import audit
from .policy import Policy


def analyse(docs: DataFrame, policy: Policy, text: str = "text", extractor: str = "rules-v1", whole_amounts: bool = False) -> DataFrame:
    """Classify, extract, normalize and validate rows with a text column. Narrow: no shuffle."""
    fields = [f.id for f in policy.fields]
    found = classify(docs, text)
    found = x.extract(found, fields, text, whole_amounts) if extractor == "rules-v1" else x.extractor(extractor)(found, fields)
    return validate(found, policy)


def value(field: str) -> Column:
    """The normalized value, or the raw one where normalization failed."""
    return F.coalesce(f"norm_{field}", f"raw_{field}")


def propose(results: DataFrame, policy: Policy, extension: Column, content_hash: Column, keep_date: bool = True, path: str = "path") -> DataFrame:
    """``results`` with category, name and proposed_path: category/name, or the name in the document's own folder."""
    have = {f.id for f in policy.fields}
    fields = {k: value(k) for k in ("invoice_date", "organization_name", "invoice_number") if k in have} | {"document_type": F.col("doc_type")}
    named = results.withColumns({"category": naming.destination(list(policy.categories), fields, keep_date), "name": naming.file_name(policy.naming, fields, extension), "content_hash": content_hash})
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    where = F.when(F.coalesce(F.col("category"), F.lit("")) != "", F.col("category")).otherwise(folder)
    return named.withColumn("proposed_path", F.when(where == "", F.col("name")).otherwise(F.concat_ws("/", where, "name")))


def batch_collisions(proposed: DataFrame, key: str = "item_id") -> DataFrame:
    """Extension: names that several documents of one batch would get; all but the least key get a suffix of their content hash, and
    copies of one content, which would get the same one, one of their key as well. ``proposed`` should be stored."""
    stem, ext = F.regexp_replace("proposed_path", "\\.[^./]*$", ""), F.regexp_extract("proposed_path", "(\\.[^./]*)$", 1)
    mark = F.substring("content_hash", 1, 8)
    first = proposed.groupBy("proposed_path").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    same = proposed.groupBy("proposed_path", mark.alias("_mark")).agg(F.count("*").alias("_copies")).where("_copies > 1").withColumnRenamed("proposed_path", "_path")
    out = proposed.join(first, "proposed_path", "left").join(same, (F.col("proposed_path") == F.col("_path")) & (mark == F.col("_mark")), "left")
    clash = F.coalesce(F.col(key) != F.col("_first"), F.lit(False))
    own = F.when(F.col("_copies").isNotNull(), F.concat(F.lit("_"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8))).otherwise("")
    renamed = F.when(clash, F.concat(stem, F.lit("_"), mark, own, ext)).otherwise(F.col("proposed_path"))
    return out.withColumns({"proposed_path": renamed, "renamed": clash}).drop("_first", "_n", "_path", "_mark", "_copies")


def results(analysed: DataFrame, policy: Policy, content_hash: Column | None = None, page_count: Column | None = None, total_chars: Column | None = None) -> DataFrame:
    """``analysed`` with the result that a caller of one document gets: overall and doc_confidence to 3 places, and ``fields`` with raw,
    normalized (the raw one where normalization failed), confidence to 3 places (0 if the field wasn't found) and required.

    ``content_hash`` is 64 zeros unless given. ``page_count`` is one unless given, and 0 for a document without characters; ``total_chars``, if
    they were counted page by page, else the stripped text decides."""
    places = lambda c: F.round(c, 3)
    shown = [
        F.struct(F.col(f"raw_{f.id}").alias("raw"), value(f.id).alias("normalized"), places(F.coalesce(f"adj_{f.id}", f"conf_{f.id}", F.lit(0.0))).alias("confidence"), F.lit(f.required).alias("required")).alias(f.id)
        for f in policy.fields
    ]
    chars = F.length(F.coalesce(strip(F.col("text")), F.lit(""))) if total_chars is None else total_chars
    pages = F.when(chars == 0, F.lit(0)).otherwise(F.lit(1) if page_count is None else page_count).cast("long")
    hashed = F.repeat(F.lit("0"), F.lit(64)) if content_hash is None else content_hash
    return analysed.withColumns({"fields": F.struct(*shown), "overall": places(F.col("overall")), "doc_confidence": places(F.col("doc_confidence")), "content_hash": hashed, "page_count": pages})


def suffix(path: Column) -> Column:
    """The suffix of the last part of a path, with its dot; '' if it has none."""
    return F.regexp_extract(path, "[^/](\\.[^./]+)$", 1)


def plan(docs: DataFrame, policy: Policy, batch_id: str, runs: DataFrame | None = None, apply: bool = False) -> DataFrame:
    """Mutation plans of ``docs`` (item_id, path, content_hash, mime, text, error): status and reason of every document.

    Unsupported types are quarantined, unreadable files failed, and documents whose key has an applied run skipped as rows of this
    batch. With ``apply``, only accepted documents go on, others are quarantined. Ids are hashes of batch and item."""
    from ..sources.local import SUPPORTED

    keyed = docs.withColumn("policy_version", F.lit(policy.policy_version))
    if runs is not None:
        keyed = audit.find_existing(keyed, runs)
    else:
        keyed = keyed.withColumns({"existing_run_id": F.lit(None).cast("string"), "existing_status": F.lit(None).cast("string")})
    found = propose(analyse(keyed, policy), policy, suffix(F.col("path")), F.col("content_hash"))
    bad_type, unread = ~F.col("mime").isin(SUPPORTED), F.col("error").isNotNull()
    refused = F.lit(apply) & (F.col("validation_status") != "accepted")
    status = F.when(audit.skips(F.col("existing_status")), "skipped").when(bad_type, "quarantined").when(unread, "failed").when(refused, "quarantined").otherwise("planned")
    codes = F.when(bad_type, F.array(F.lit("unsupported_mime"))).when(unread, F.array("error")).otherwise(F.col("reason_codes"))
    return found.select(
        F.sha2(F.concat_ws("|", F.lit(batch_id), "item_id"), 256).alias("run_id"), F.lit(batch_id).alias("batch_id"), "item_id", "path", "content_hash", "policy_version",
        F.lit(policy.schema_version).alias("schema_version"), status.alias("status"), "doc_type", "overall", "validation_status", codes.alias("reason_codes"),
        F.when(status == "quarantined", audit.quarantine_reason(codes, audit.REASON_WORDS)).alias("reason"), F.when(status == "planned", F.col("proposed_path")).alias("proposed_path"),
        F.col("category"), F.lit("rename").alias("op"), F.lit(not apply).alias("dry_run"),
    )


def apply_gate(plans: DataFrame, runs: DataFrame, compat: bool = False) -> DataFrame:
    """Rows of a plan whose run is still planned and has a proposed path; unless ``compat``, also only accepted ones."""
    now = audit.latest(runs).select("run_id", F.col("status").alias("_now"))
    out = plans.join(now, "run_id").where((F.col("_now") == "planned") & F.col("proposed_path").isNotNull()).drop("_now")
    return out if compat else out.where(F.col("validation_status") == "accepted")
