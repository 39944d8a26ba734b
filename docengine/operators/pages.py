"""Text of documents page by page: garbled text, the need of OCR, merging OCR pages, joining pages.

Tables: pages(doc_id, page_number, text), words(doc_id, page_number, word, confidence).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

NATIVE_CHARS, GARBLED_CHARS, GARBLED_RATIO, PAGE_CHARS, KEEP_CHARS = 50, 50, 0.30, 500, 20


def word_ratio(text: Column) -> Column:
    """Share of white-space-separated tokens that are two or more ASCII letters; 0 without tokens."""
    tokens = F.filter(F.split(text, "(?U)\\s+"), lambda t: t != "")
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: t.rlike("^[a-zA-Z]{2,}$"))) / F.size(tokens)).otherwise(0.0)


def garbled(text: Column, ratio: float = GARBLED_RATIO) -> Column:
    return (F.length(text) >= GARBLED_CHARS) & (word_ratio(text) < ratio)


def page_table(pages: DataFrame) -> DataFrame:
    """``pages`` with char_count, the length of the stripped text."""
    return pages.withColumn("char_count", F.length(strip(F.col("text"))))


def documents(pages: DataFrame) -> DataFrame:
    """(doc_id, full_text, page_count, total_chars, is_native): pages in order, joined by an empty line."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text", "char_count")))
    out = page_table(pages).groupBy("doc_id").agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n")
    total = F.aggregate("p", F.lit(0), lambda a, x: a + F.coalesce(x["char_count"], F.lit(0)))
    return out.select("doc_id", text.alias("full_text"), F.size("p").alias("page_count"), total.alias("total_chars"), (total >= NATIVE_CHARS).alias("is_native"))


def needs_ocr(docs: DataFrame, coverage: float = GARBLED_RATIO) -> DataFrame:
    """``docs`` of documents() with needs_ocr: no pages, no native text, too little text a page, or garbled text."""
    thin = F.try_divide(F.col("total_chars"), F.col("page_count")) < coverage * PAGE_CHARS
    return docs.withColumn("needs_ocr", (F.col("page_count") == 0) | ~F.col("is_native") | F.coalesce(thin, F.lit(True)) | garbled(F.col("full_text")))


def ocr_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page_number, confidence, word_count) over words with a confidence of 0 or more that aren't blank."""
    real = (F.col("confidence") >= 0) & (strip(F.col("word")) != "")
    return words.groupBy("doc_id", "page_number").agg(F.coalesce(F.avg(F.when(real, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.count_if(real).alias("word_count"))


def ocr_documents(ocr: DataFrame) -> DataFrame:
    """(doc_id, average_confidence, total_text): the mean of the pages' means, and their texts in order."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return ocr.groupBy("doc_id").agg(F.avg("confidence").alias("average_confidence"), parts.alias("p")).select("doc_id", "average_confidence", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("total_text"))


def merge_ocr(pages: DataFrame, ocr: DataFrame, least: int = KEEP_CHARS) -> DataFrame:
    """(doc_id, page_number, text, char_count, from_ocr): a native page stays if it has enough readable text, else the OCR page
    takes its place if there is one. One join by (doc_id, page_number)."""
    n, o = page_table(pages).alias("n"), ocr.alias("o")
    joined = n.join(o, ["doc_id", "page_number"], "left")
    swap = ((F.col("n.char_count") < least) | garbled(F.col("n.text"))) & F.col("o.text").isNotNull()
    text = F.when(swap, F.col("o.text")).otherwise(F.col("n.text"))
    return joined.select("doc_id", "page_number", text.alias("text"), F.length(strip(text)).alias("char_count"), F.coalesce(swap, F.lit(False)).alias("from_ocr"))


def decode(files: DataFrame, decoder: Callable[[bytes], Iterator[tuple[int, str]]]) -> DataFrame:
    """(path, page_number, text, error) of binary files: ``decoder`` gives (page number, text) of one file's bytes. An empty file
    and a decoder that raises give one row with an error instead of a failed job."""

    def run(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    if not content:
                        raise ValueError("empty_file")
                    rows = [(path, n, text, None) for n, text in decoder(content)]
                except Exception as e:  # noqa: BLE001
                    rows = [(path, None, None, str(e) if str(e) in ("empty_file", "encrypted_file") else "corrupt_file")]
                yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, error string")
