"""A corpus pipeline: documents pass through five stages of docengine.llm, each stored as Parquet and read again by the next.

1. quality rules: documents that fail the base rule or a certified threshold go;
2. line dedup: of each component of similar lines one line stays, so documents lose lines, not rows;
3. MinHash near-dedup: of each class of near-duplicates the document of the least id stays;
4. benchmark decontamination: documents with at least a twentieth of their words in benchmark windows go;
5. SentencePiece encoding: (doc_id, n_ids, ids, round_trip) of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docengine.llm import bagminhash, decontam, linededup, quality, transducer
from docengine.llm.common import Shelf, table
from docengine.llm.queries import MODEL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.remove(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return transducer.encode(docs, MODEL)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SQL can't express Poisson signatures or piece encoding; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
