"""Operator 13, best-fit packing: bounded-space online best-fit of token pieces into sequences.

A document is its tokens and an end token. One longer than a sequence is cut into pieces of a whole sequence, the first of which is
shorter if the length isn't a multiple. Pieces are packed by best fit: each goes to the open sequence (bin) with the least free
space that holds it. A bin's free space is its key in a bitset, so the best fit is the lowest set bit from the piece's length
up. At most OPEN bins are open; when one more is needed, the fullest closes for good. Full bins close themselves.

Pieces are dealt by a hash of their place into groups of about GROUP, which are packed apart, the longest arriving first. A group's
open bins are the items of the next round, where FAN groups meet, until one group is left. A group never holds more than GROUP pieces or
FAN * OPEN bins, whatever the size of the table. Only places and lengths are shuffled, texts and ids aren't. What a round did is stored, and
bins put into bins are followed back once at the end.

Ids are those of the tokenizer file. For a plain byte-level BPE file they are made by tiktoken's merge loop, set up from
that file, which takes a fifth of the time; a text that its pattern matcher refuses (millions of spaces in a row) goes to the tokenizer itself.

Defined results: a null text is an empty one, whose only piece is the end token; repeated rows are pieces each; null ids stay;
an empty table has no pieces. Lengths outside 0 to the capacity raise an error.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import Shelf, map_batches

CAPACITY, END = 1024, 2
#: Pieces of a group, bins that it keeps open, groups that meet in a round.
GROUP, OPEN, FAN = 16_384, 8_192, 8
#: How the byte-level form splits a text before merges, and the bytes that stand for themselves in its vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
PLACE = "packing_place"


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Tokens as bytes, by id, if the file is a plain byte-level BPE whose merges are in order of their ids; else None."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    others = [b for b in range(256) if b not in PRINTED]
    byte_of = {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(others)}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"] for t in spec["added_tokens"]}
    words = {w: i for w, i in model["vocab"].items() if w not in special}
    if made != sorted(made) or len(made) != len(words) - 256 or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    return {bytes(byte_of[c] for c in w): i for w, i in words.items()}


@functools.cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """The function from a text to its ids (special strings of the file are their ids, none are added), made once per worker."""
    exact = Tokenizer.from_file(path)
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    ranks = _byte_ranks(spec)

    def by_tokenizer(text: str) -> list[int]:
        return exact.encode(text, add_special_tokens=False).ids

    if ranks is None:
        return by_tokenizer
    fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def by_ranks(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            return by_tokenizer(text)

    return by_ranks


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` tokens start, and ``n``."""
    return [0, *range((n - 1) % capacity + 1, n, capacity), n]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of the pieces of every row; without ``ids`` the last column is left out."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else fields)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for row, text in enumerate(batch.column(1)):
            tokens = np.array([*encode(text.as_py() or ""), end], "<u4")
            at = cuts(len(tokens), capacity)
            spans = list(zip(at, at[1:], strict=False))
            columns = [
                pa.repeat(batch.column(0)[row], len(spans)), pa.array(range(len(spans)), pa.int32()), pa.array(at[:-1], pa.int64()),
                pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(tokens[a:b]) for a, b in spans], pa.int64()),
            ]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.view("<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The pieces of all texts of a batch as one, unless they carry their ids."""
        made = list(run(batch)) if not ids else []
        yield from run(batch) if ids else [pa.Table.from_batches(made).combine_chunks().to_batches()[0]] if made else []

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(texts, ["doc_id", "text"], schema, joined)


class Bins:
    """At most ``most`` open bins of a capacity, in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free, self.held, self.n = 0, [[] for _ in range(capacity + 1)], 0

    def _take(self, free: int) -> int:
        bins = self.held[free]
        at = bins.pop()
        if not bins:
            self.free ^= 1 << free
        self.n -= 1
        return at

    def put(self, item: int, size: int) -> tuple[int, int]:
        """The bin of an item and its offset there; a new bin has the item's name."""
        fitting = self.free >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            into = self._take(free)
        else:
            if self.n == self.most and size < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
            free, into = self.capacity, item
        left = free - size
        if left:
            self.held[left].append(into)
            self.free |= 1 << left
            self.n += 1
        return into, self.capacity - free

    def open(self) -> dict[int, int]:
        """Bytes used of the bins that are still open."""
        return {b: self.capacity - free for free, bins in enumerate(self.held) for b in bins}


def _packed(items: DataFrame, capacity: int, most: int) -> DataFrame:
    """(item, bin, offset, used, group) of items (item, size, group); used is set in the row that opened a bin which is still open."""

    def fill(table: pa.Table) -> pa.Table:
        item, size = (table.column(c).to_numpy() for c in ("item", "size"))
        if len(size) and (size.min() < 0 or size.max() > capacity):
            raise ValueError(f"lengths go from {size.min()} to {size.max()}, the capacity is {capacity}")
        order = np.lexsort((item, -size))
        bins = Bins(capacity, most)
        into = [bins.put(i, s) for i, s in zip(item[order].tolist(), size[order].tolist(), strict=True)]
        left = bins.open()
        used = [left.get(b) if b == i else None for i, (b, _) in zip(item[order].tolist(), into, strict=True)]
        columns = [pa.array(item[order]), pa.array([b for b, _ in into], pa.int64()), pa.array([o for _, o in into], pa.int64()), pa.array(used, pa.int64()), table.column("group").combine_chunks()]
        return pa.Table.from_arrays(columns, names=["item", "bin", "offset", "used", "group"])

    return items.groupBy("group").applyInArrow(fill, "item long, bin long, offset long, used long, group long")


def pack(rows: DataFrame, capacity: int = CAPACITY, length_col: str = "length", group: int = GROUP, most: int = OPEN) -> DataFrame:
    """``rows`` with sequence_id and offset; their lengths fill sequences of ``capacity`` without gaps from 0."""
    shelf = Shelf(rows.sparkSession)
    rows = shelf.put(rows.withColumn(PLACE, F.monotonically_increasing_id()))
    n = max(1, -(-rows.count() // group))
    items = rows.select(F.col(PLACE).alias("item"), F.col(length_col).cast("long").alias("size"), _dealt(F.xxhash64(PLACE), n))
    rounds = []
    while True:
        rounds.append(shelf.put(_packed(items, capacity, most)))
        if n == 1:
            break
        n = -(-n // FAN)
        items = rounds[-1].where("used is not null").select("item", F.col("used").alias("size"), _dealt(F.col("group"), n))
    where = rounds.pop().select("item", "bin", "offset")
    while rounds:
        over = where.select(F.col("item").alias("bin"), F.col("bin").alias("over"), F.col("offset").alias("more"))
        where = rounds.pop().join(over, "bin", "left").select("item", F.coalesce("over", "bin").alias("bin"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
    where = where.select(F.col("item").alias(PLACE), F.col("bin").alias("sequence_id"), "offset")
    return rows.join(where, PLACE).drop(PLACE)


def _dealt(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n)).cast("long").alias("group")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids; at most a sequence's capacity is gathered at once."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
