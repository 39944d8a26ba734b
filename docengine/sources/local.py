"""Files of a folder: discovery, types, download names, decisions on renames, and renames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .journal import settle

# Types by suffix and by first bytes.
SUFFIX_TYPES = {
    ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tiff": "image/tiff", ".tif": "image/tiff",
    ".bmp": "image/bmp", ".webp": "image/webp",
}
SUPPORTED = ["application/pdf", "image/png", "image/jpeg", "image/tiff", "image/bmp", "image/webp"]
MAGIC = {"25504446": "application/pdf", "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "424D": "image/bmp"}
UNKNOWN_TYPE = "application/octet-stream"


def suffix_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, "[^/](\\.[^./]*)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_TYPES.items() for x in kv]), suffix), F.lit(UNKNOWN_TYPE))


def detect_type(path: Column, content: Column) -> Column:
    """The type by the first bytes, else by the suffix."""
    head = F.hex(F.substring(content, 1, 16))
    by_bytes = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for start, kind in MAGIC.items():
        by_bytes = by_bytes.when(head.startswith(start), kind)
    return F.coalesce(by_bytes, suffix_type(path))


def supported(mime: Column) -> Column:
    return mime.isin(SUPPORTED)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, path, content_hash, etag, mime, file_size, modified) of the supported files below a folder.

    Every file is read, as its type is told by its first bytes and only then by its suffix; unreadable files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(folder)
    clean = F.regexp_replace("path", "^file:/+", "/")
    rows = files.where(supported(detect_type(F.col("path"), F.col("content")))).select(clean.alias("path"), "content", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    hashed = rows.select("path", F.sha2("content", 256).alias("content_hash"), detect_type(F.col("path"), F.col("content")).alias("mime"), "file_size", "modified")
    return hashed.select(F.sha2("path", 256).alias("item_id"), "path", "content_hash", F.col("content_hash").alias("etag"), "mime", "file_size", "modified")


def download_names(items: DataFrame) -> DataFrame:
    """``items`` (path, content_hash) with download_name: the first path of each name keeps it, as do its equal files; others are
    preceded by eight characters of their hash."""
    named = items.withColumn("_base", F.substring_index("path", "/", -1))
    first = named.groupBy("_base").agg(F.min_by("content_hash", "path").alias("_hash"))
    out = named.join(first, "_base")
    return out.withColumn("download_name", F.when(F.col("content_hash") == F.col("_hash"), F.col("_base")).otherwise(F.concat(F.substring("content_hash", 1, 8), F.lit("_"), "_base"))).drop("_base", "_hash")


def changed(items: DataFrame, listing: DataFrame) -> DataFrame:
    """``items`` (path, etag) with current_etag, null if the file is gone, and changed."""
    now = listing.select("path", F.col("etag").alias("current_etag"))
    return items.join(now, "path", "left").withColumn("changed", ~F.col("etag").eqNullSafe(F.col("current_etag")))


def decide(plans: DataFrame, listing: DataFrame) -> DataFrame:
    """``plans`` (path, proposed_path, op, etag, dry_run) with a decision: missing, etag_mismatch, metadata_only, collision, dry_run
    or rename, in this order. A null etag skips the guard. Of plans that share a target the one of the least path may go on, as if
    they came one after another. Two joins with the listing by path, one grouping of the targets."""
    now = listing.select("path", F.col("etag").alias("_now"))
    taken = listing.select(F.col("path").alias("_taken")).distinct()
    moves = plans.where("op <> 'metadata_update' and not dry_run").groupBy(F.col("proposed_path").alias("_target")).agg(F.min("path").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    out = plans.join(now, "path", "left").join(taken, F.col("proposed_path") == F.col("_taken"), "left").join(moves, F.col("proposed_path") == F.col("_target"), "left")
    decision = (
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("etag").isNotNull() & (F.col("etag") != F.col("_now")), "etag_mismatch")
        .when(F.col("op") == "metadata_update", "metadata_only")
        .when(F.col("_taken").isNotNull(), "collision")
        .when(F.col("dry_run"), "dry_run")
        .when(F.col("_first") != F.col("path"), "collision")
        .otherwise("rename")
    )
    return out.withColumn("decision", decision).drop("_now", "_taken", "_target", "_first", "_n")


def rename_approved(decisions: DataFrame, outcomes: str, root: str = "") -> DataFrame:
    """Carry out the renames of an approved plan (path, proposed_path, decision and, if there is one, etag as SHA-256 of the content)
    on a file system that all executors see. Content and target are looked at once more at that moment. The tasks' outcomes
    (path, proposed_path, outcome) are written to the folder ``outcomes``, which is read back. :mod:`.journal` also stores intents."""
    etag = F.col("etag") if "etag" in decisions.columns else F.lit(None)
    rows = decisions.where(F.col("decision") == "rename").select("path", "proposed_path", etag.cast("string").alias("etag"))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            done = [settle(p, os.path.join(root, t), e) for p, t, e in zip(batch["path"], batch["proposed_path"], batch["etag"], strict=True)]
            yield batch[["path", "proposed_path"]].assign(outcome=done)

    rows.mapInPandas(run, "path string, proposed_path string, outcome string").write.mode("append").parquet(outcomes)
    return decisions.sparkSession.read.schema("path string, proposed_path string, outcome string").parquet(outcomes)
