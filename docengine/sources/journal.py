"""Approved renames with a journal: intents before, outcomes after, and a way to go on from any step between.

Intents (path, target, etag, file) are stored before anything is touched; ``file`` is the source's device and inode. A rename is a hard
link, which fails if the target exists, and an unlink, so no file is ever overwritten or missing. An attempt that was stopped is settled by
what is there: a target that is the source's own file was linked by it. Outcomes are stored by the tasks. :func:`carry_out` does the
intents that have none, so it may be repeated until none is left.

The folders are on a file system that all executors see at the same paths; the journal is anywhere that Spark can write.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTENTS, OUTCOMES = "path string, proposed_path string, target string, etag string, file string", "path string, proposed_path string, outcome string"


def identity(path: str) -> str | None:
    """Device and inode of a file; None if there is none."""
    try:
        found = os.stat(path)
    except FileNotFoundError:
        return None
    return f"{found.st_dev}:{found.st_ino}"


def sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def settle(path: str, target: str, etag: str | None = None, file: str | None = None) -> str:
    """Bring a rename to its end, from the start or from where an attempt was stopped: renamed, unchanged, missing, etag_mismatch,
    collision or no_hard_links. Without ``file``, a source that is gone counts as renamed if the target has its content."""
    if path == target:
        return "unchanged" if identity(path) else "missing"
    here, there = identity(path), identity(target)
    if here is None:
        known = there == file if file else there is not None and etag is not None and sha256(target) == etag
        return "renamed" if there is not None and known else "missing"
    if there is None:
        if file and here != file or etag and sha256(path) != etag:
            return "etag_mismatch"
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        try:
            os.link(path, target)
        except FileNotFoundError:  # another attempt was faster
            return settle(path, target, etag, file)
        except FileExistsError:
            there = identity(target)
        except OSError:
            return "no_hard_links"
        else:
            there = here
    if there != here:
        return "collision"
    try:
        os.unlink(path)
    except FileNotFoundError:
        pass
    return "renamed"


def _written(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def intend(decisions: DataFrame, journal: str, root: str = "") -> DataFrame:
    """Store the renames of an approved plan (path, proposed_path, decision[, etag]); a journal that has them keeps them."""
    spark = decisions.sparkSession
    if not _written(spark, f"{journal}/intents"):
        etag = F.col("etag") if "etag" in decisions.columns else F.lit(None)
        rows = decisions.where(F.col("decision") == "rename").select("path", "proposed_path", etag.cast("string").alias("etag"))

        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                batch["target"] = [os.path.join(root, p) for p in batch["proposed_path"]]
                yield batch.assign(file=[identity(p) for p in batch["path"]])[["path", "proposed_path", "target", "etag", "file"]]

        rows.mapInPandas(run, INTENTS).write.mode("overwrite").parquet(f"{journal}/intents")
    return spark.read.schema(INTENTS).parquet(f"{journal}/intents")


def carry_out(spark: SparkSession, journal: str) -> DataFrame:
    """Do the intents that have no outcome, and return all outcomes, one an intent. A repeated start finds what earlier ones left."""
    spark.createDataFrame([], OUTCOMES).write.mode("append").parquet(f"{journal}/outcomes")
    done = spark.read.schema(OUTCOMES).parquet(f"{journal}/outcomes")
    left = spark.read.schema(INTENTS).parquet(f"{journal}/intents").join(done, ["path", "proposed_path"], "left_anti")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            columns = (batch[c] for c in ("path", "target", "etag", "file"))
            yield batch[["path", "proposed_path"]].assign(outcome=[settle(*row) for row in zip(*columns, strict=True)])

    left.mapInPandas(run, OUTCOMES).write.mode("append").parquet(f"{journal}/outcomes")
    return spark.read.schema(OUTCOMES).parquet(f"{journal}/outcomes").dropDuplicates(["path", "proposed_path"])
