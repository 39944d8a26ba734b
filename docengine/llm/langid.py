"""Operator 6, language identification by rank-order profiles of n-grams.

A profile is a list of a language's most frequent n-grams (1 to 3 characters of lower-cased words, which are runs of
letters, with a mark on each side), most frequent first, equal counts in order of the packed n-gram. A document's own list is compared with every
language's by the out-of-place distance: the sum, over its n-grams, of how far each has moved, and the length of the list
for one that the language's list lacks. The nearest language wins; of equals the first by name.

Profiles count every n-gram of all learning rows. Workers count in parts, Spark adds the parts up. An n-gram is packed
into one integer (21 bits a character); a text's are made by shifting the array of its code points, and one sort counts
them. A profile has PROFILE entries. Every language that the learning rows name has one; workers are sent at most LANGUAGES of them at
once, further ones in passes of their own, each of which keeps the nearest language so far.

Defined results: null texts and texts without a letter are ``und`` with score 0; an empty learning set makes every
prediction ``und``; repeated rows are predicted each. The score is 1 less the distance as a share of the largest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, small_batches

PROFILE, LANGUAGES = 400, 1000
#: Counts that a worker holds before it adds them up and hands them on.
FLUSH_GRAMS = 2_000_000
MARK = ord("_")
UND = "und"


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Which code points are letters, looked up once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a text in their order, and their counts; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where(letter, codes, MARK).astype(np.int64)
    codes, letter = np.concatenate([[MARK], codes, [MARK]]), np.concatenate([[False], letter, [False]])
    one = letter | np.concatenate([[True], letter[:-1]])  # one mark between two words
    codes, letter = codes[one], letter[one]
    two = (codes[:-1] << 21) | codes[1:]
    three = ((two[:-1] << 21) | codes[2:])[letter[1:-1]]
    grams = np.sort(np.concatenate([codes[letter], two, three]))
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[at], np.diff(np.append(at, len(grams)))


def profile(text: str | None) -> np.ndarray:
    """Packed n-grams of a text by rank, at most PROFILE."""
    grams, counts = counted(text)
    if len(grams) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


def learn(docs: DataFrame, lang: Column, text_col: str = "text") -> list[tuple[str, list[int]]]:
    """Profiles of all languages that ``lang`` names: (language, packed n-grams by rank)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = counted(text)
                held.setdefault(name, []).append(got)
                size += len(got[0])
            if size > FLUSH_GRAMS:
                yield from flush()
                size = 0
        yield from flush()

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A language has as many rows here as it has different n-grams of up to three characters, however large the corpus.
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    profiles = ranked.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"]).alias("grams"))
    return sorted((r["lang"], r["grams"]) for r in profiles.collect())


class Profiles:
    def __init__(self, profiles: list[tuple[str, list[int]]]) -> None:
        self.names = [n for n, _ in profiles]
        self.keys = np.unique(np.concatenate([np.empty(0, np.int64), *(np.array(g, np.int64) for _, g in profiles)]))
        self.rank = np.full((len(profiles), len(self.keys) + 1), -1, np.int16)
        for k, (_, grams) in enumerate(profiles):
            self.rank[k, np.searchsorted(self.keys, grams)] = np.arange(len(grams))

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.names:
            return UND, 0.0
        at = np.searchsorted(self.keys, grams)
        known = (at < len(self.keys)) & (np.append(self.keys, -1)[at] == grams)
        theirs = self.rank[:, np.where(known, at, len(self.keys))].astype(np.int64)
        moved = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(grams))))
        distance = moved.sum(axis=1)
        best = int(np.argmin(distance))
        return self.names[best], float(1 - distance[best] / (PROFILE * len(grams)))


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]], id_col: str = "doc_id", text_col: str = "text", languages: int = LANGUAGES) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text, in one narrow pass for each ``languages`` profiles."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    names, schema = rows.columns, "doc_id long, text string, lang_pred string, score double"
    for start in range(0, max(len(profiles), 1), languages):
        last, some = start + languages >= len(profiles), profiles[start : start + languages]
        model: list[Profiles] = []

        def run(batch: pa.RecordBatch, last: bool = last, some: list = some, model: list = model) -> pa.RecordBatch:
            if not model:
                model.append(Profiles(some))
            got = []
            for text, name, score in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                new = model[0].predict(profile(text))
                # Profiles come in order of their names, so of equals the earlier one stays.
                got.append(new if name == UND or new[1] > score else (name, score))
            columns = [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            return pa.RecordBatch.from_arrays([c for c, n in zip(columns, names, strict=True) if not last or n != "text"], names=[n for n in names if not last or n != "text"])

        rows = map_batches(rows, names, schema.replace(" text string,", "") if last else schema, run)
    return rows


def fold(id_col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n
