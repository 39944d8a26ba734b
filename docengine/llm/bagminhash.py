"""Operator 3, near-duplicate documents by BagMinHash over 5-word shingles.

A text is the multiset of its 5-word shingles (words as in :mod:`.decontam`; a text of 1 to 4 words is one shingle). Two
texts are near-duplicates if their multisets' weighted Jaccard similarity, the sum of least counts over the sum of greatest,
is at least 0.8.

Signatures are BagMinHash: every shingle has, for every unit of weight, a Poisson process of points (x, k); component k of
the signature is the least x at k over all units that the text has. Weights are integers, and their axis is divided
dyadically, [0,1) [1,2) [2,4) [4,8) ...: one process per part, at the rate of the part's width, stands for all its units, and
each of its points falls on a unit drawn at random; only points on units below the shingle's count are kept. So texts share
the points of the units that they share, and a component agrees with exactly the weighted Jaccard probability. A process ends
once its next x exceeds the text's largest component. All this is done for a batch of texts at once in numpy.

BANDS bands of ROWS components are hashed into buckets: a pair at 0.8 shares one with probability 1 - (1 - 0.8**4)**16 =
0.9998. Texts of equal words are one node from the start. Nodes of a bucket are compared exactly by :func:`.components.links`,
which lists no pairs of a group, and components become classes.

Defined results: the class of a document is the least doc_id in it (null ids rank last); texts that are null or have no word
are classes of their own; rows repeated with id and text are one document in :func:`deduplicate`, which keeps one; other
columns pass through it unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, map_batches
from .components import links, verifier, within
from .decontam import words

SHINGLE, BANDS, ROWS, SIMILAR = 5, 16, 4, 0.8
SIZE = BANDS * ROWS
CACHE_WORDS = 400_000
U = np.uint64
_word_hash: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hash_of(word: bytes) -> int:
    got = _word_hash.get(word)
    if got is None:
        if len(_word_hash) >= CACHE_WORDS:
            _word_hash.clear()
        got = _word_hash[word] = xxhash.xxh64_intdigest(word)
    return got


def shingles(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of a text's words, in order, and their counts."""
    if not ws:
        return np.empty(0, U), np.empty(0, np.int64)
    h = np.fromiter(map(_hash_of, ws), U, len(ws))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, U)
    for i in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BagMinHash signatures, a row of SIZE points x for each (hashes, counts)."""
    best = np.full((len(sets), SIZE), np.inf)
    if not sets:
        return best
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    item, weight = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    flat, part = best.ravel(), 0
    low, width = 0, 1
    while len(item):
        seed = mix(item ^ U((part * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64))
        x, at, d, w = np.zeros(len(item)), seed, doc, weight
        step = 0
        while len(at):
            step += 1
            r = mix(at + U((step * 0x9E3779B97F4A7C15) % 2**64))
            x = x - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            r = mix(r ^ U(0xA0761D6478BD642F))
            k = (r % U(SIZE)).astype(np.int64)
            unit = low + ((r >> U(32)).astype(np.float64) * (width * 2.0**-32)).astype(np.int64)
            own = unit < w
            np.minimum.at(flat, d[own] * SIZE + k[own], x[own])
            go = x < best.max(axis=1)[d]
            x, at, d, w = x[go], at[go], d[go], w[go]
        low, width, part = low + width, max(1, low + width), part + 1
        keep = weight > low
        item, weight, doc = item[keep], weight[keep], doc[keep]
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per text and band."""
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        out = mix(out * U(0x9E3779B97F4A7C15) + bits[:, :, i])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def units(multiset: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set whose Jaccard similarity is the weighted one of multisets: the k-th time of a shingle is an item of its own."""
    item, times = multiset
    kth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return mix(np.repeat(item, times) ^ (kth.astype(U) * U(0x9E3779B97F4A7C15)))


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, seen, node, buckets): seen is a hash of the text, node stands for its words, both null-safe."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ws = [words(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        has = [i for i, w in enumerate(ws) if w]
        keys = band_keys(signatures([shingles(ws[i]) for i in has])) if has else []
        buckets: list = [None] * len(ws)
        for i, k in zip(has, keys, strict=True):
            buckets[i] = k
        node = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in ws]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "seen", "node", "buckets"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("seen"), "text"), ["doc_id", "seen", "text"], "doc_id long, seen long, node binary, buckets array<long>", run)


def text_units(text: str) -> np.ndarray:
    return np.sort(units(shingles(words(text.encode()))))


def classes(docs: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, seen, class_id) of every document; seen is xxhash64 of the text."""
    shelf = shelf or Shelf(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = shelf.put(sign(rows))
    # One row for each different text; its first document supplies the text to compare.
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "seen")
    nodes = shelf.put(signed.where("node is not null").groupBy("node").agg(F.min(order).alias("first"), F.any_value("buckets").alias("buckets")))
    spread = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("bucket")
    members = shelf.put(spread.join(shared, "bucket").select("bucket", "node"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("id"), F.col("first.seen").alias("at"))
    texts = rows.withColumn("seen", F.xxhash64("text")).join(wanted, (F.col("seen") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("node").agg(F.any_value("text").alias("text"))
    texts = shelf.put(texts)
    roots = links(shelf, members, verifier(texts, text_units, "binary"), SIMILAR, within(texts, text_units, "binary", SIMILAR))
    rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    known = rooted.join(heads, "root").select(F.col("node"), F.col("head"))
    out = signed.select("doc_id", "seen", "node").join(known, "node", "left")
    return out.select("doc_id", "seen", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.coalesce(F.col("head.seen"), F.col("seen")).alias("class_seen"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, its least doc_id, with all columns as they were."""
    marked = classes(docs)
    kept = marked.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("seen") == F.col("class_seen"))).select(F.col("doc_id").alias("kept_id"), F.col("seen").alias("kept_seen")).groupBy("kept_id", "kept_seen").agg(F.count("*").alias("times"))
    kept = Shelf(docs.sparkSession).put(kept)
    seen = "_".join(["seen", *docs.columns])
    found = docs.withColumn(seen, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(f"`{seen}`") == F.col("kept_seen")), "left_semi")
    # Whole rows that are repeated are rare; without any the texts needn't be grouped.
    return found.drop(seen) if kept.where("times > 1").isEmpty() else found.dropDuplicates(["doc_id", seen]).drop(seen)
