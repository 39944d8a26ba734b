"""Operator 9, benchmark decontamination: a broadcast hash set of the benchmark's word windows.

Words are runs of digits, lower-cased ASCII letters and any non-ASCII characters. Each benchmark item gives its windows
of 13 consecutive words, a shorter item one window of all its words. Workers hold the benchmark's words as numbers and
the windows as a hash set; a document becomes an array of those numbers (0 for any other word), only stretches of
benchmark words are looked at, and each hashed hit is verified word by word.

The benchmark is broadcast only up to MAX_ITEM_BYTES, which is checked; a larger one is scanned in slices of at most that size, which is
checked as well (one item may be larger). Each has a narrow pass of its own that adds to the hits of the stored pass before it, and the
driver holds one slice at a time.

Defined results: null texts have no words; an item without words has no window; repeated items count once per item_id,
null item_ids are left out; an empty benchmark contaminates nothing; repeated documents give a row each; columns other
than the named ones pass through :func:`remove` unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, Shelf, small_batches

WINDOW = 13
#: Text of a slice. A worker holds about 32 bytes a word and 150 a different word: some 110 MB for ordinary text, and at most 600 MB, as words that
#: are all different have four characters or more on average.
MAX_ITEM_BYTES = 16 << 20
MARK = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.LongType()))])
#: Lower-cases A-Z and turns what can't be in a word into spaces; bytes of non-ASCII characters stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class Windows:
    """The hash set: of each length, the different windows by their 64-bit key, sorted, with a place where each one's words stand, for
    verification, and the items that have it. All of it is arrays: 4 bytes a word, 20 a window and 8 for each item that has it."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.word_id: dict[bytes, int] = {}
        number = self.word_id
        parts = [np.fromiter((number.setdefault(w, len(number) + 1) for w in words(text)), np.int32) for _, text in items]
        self.flat = np.concatenate([np.empty(0, np.int32), *parts])
        lengths = np.array([len(p) for p in parts], np.int64)
        begins = np.cumsum(lengths) - lengths
        self.sets = {}
        for size in np.unique(np.minimum(lengths, WINDOW)):
            of = np.flatnonzero(np.minimum(lengths, WINDOW) == size)
            if size:
                start = np.concatenate([np.arange(b, b + n - size + 1, dtype=np.int32) for b, n in zip(begins[of], lengths[of], strict=True)])
                owner = np.repeat(np.array([items[i][0] for i in of], np.int64), lengths[of] - size + 1)
                self.sets[int(size)] = self._built(start, owner, int(size))

    def _built(self, start: np.ndarray, owner: np.ndarray, size: int) -> tuple:
        """(multipliers, keys, a start of each, ends of their items, items). Multipliers are drawn anew until different windows differ in key."""
        seed = size
        while True:
            mix = np.random.default_rng(seed).integers(1, 2**63, size, np.uint64) | np.uint64(1)
            key = keyed(self.flat, start, mix)
            order = np.lexsort((owner, key))
            key, place, item = key[order], start[order], owner[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = place[np.flatnonzero(new)[np.cumsum(new) - 1]]
            if all((self.flat[place + j] == self.flat[first + j]).all() for j in range(size)):
                break
            seed += WINDOW
        once = new | np.concatenate([[True], item[1:] != item[:-1]])
        heads = np.flatnonzero(new[once])
        return mix, key[new], place[new], np.append(heads, int(once.sum())), item[once]

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Words of a text, which of them lie in a benchmark window, and the items concerned, sorted."""
        ws = words(text)
        ids = np.fromiter(map(self.word_id.get, ws, repeat(0)), np.int32, len(ws))
        cover, found = np.zeros(len(ws) + 1, np.int64), [np.empty(0, np.int64)]
        inside = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, (mix, keys, place, ends, owner) in self.sets.items():
            starts = np.flatnonzero(inside[size:] - inside[: len(inside) - size] == size) if len(ws) >= size else []
            if not len(starts):
                continue
            mine = keyed(ids, starts, mix)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            good = keys[at] == mine
            starts, at = starts[good], at[good]
            for j in range(size):
                good = ids[starts + j] == self.flat[place[at] + j]
                starts, at = starts[good], at[good]
            cover[starts] += 1
            cover[starts + size] -= 1
            found += [owner[ends[k] : ends[k + 1]] for k in np.unique(at)]
        return len(ws), np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(found))


def keyed(ids: np.ndarray, starts: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """Keys of the windows that begin at ``starts``, a word at a time, so that no copy of all their words is made."""
    out = np.zeros(len(starts), np.uint64)
    for j, m in enumerate(mix):
        out += ids[starts + j].astype(np.uint64) * m
    return out


_windows: dict[int, Windows] = {}


def _of(items: list[tuple[int, bytes]]) -> Windows:
    key = hash(tuple(items))
    if key not in _windows:
        _windows.clear()
        _windows[key] = Windows(items)
    return _windows[key]


def slices(benchmark: DataFrame, max_bytes: int = MAX_ITEM_BYTES) -> Iterator[tuple[bool, list[tuple[int, bytes]]]]:
    """The benchmark in lists of at most ``max_bytes`` of text each (or one item), and whether each is the last."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, key = -(-total // max_bytes) or 1, F.xxhash64("item_id", "text")
    while n > 1:
        parts = items.groupBy(F.pmod(key, F.lit(n)).alias("part")).agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("rows"))
        if parts.where((F.col("size") > max_bytes) & (F.col("rows") > 1)).isEmpty():
            break
        n *= 2
    for k in range(n):
        yield k == n - 1, sorted((r[0], bytes(r[1])) for r in items.where(F.pmod(key, F.lit(n)) == k).collect())


def _scanned(rows: DataFrame, benchmark: DataFrame, max_bytes: int, mark: str, keep_text: bool) -> DataFrame:
    """``rows`` with a struct ``mark`` of n_words, hits (places of words) and items. Slices follow each other as narrow passes over the
    same rows, each adding its hits to those it gets and stored if it isn't the last; without ``keep_text`` the last drops the text."""
    small_batches(rows.sparkSession)
    shelf, before = Shelf(rows.sparkSession), None
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])
    for k, (last, items) in enumerate(slices(benchmark, max_bytes)):
        names = rows.columns if keep_text or not last else [c for c in rows.columns if c != "text"]
        names = [c for c in names if c != mark]
        ddl = rows.select(*[f"`{c}`" for c in names]).schema.add(mark, MARK)
        at = rows.columns.index("text")

        def run(batches, items=items, names=names, at=at, k=k, columns=rows.columns):  # noqa: ANN001, ANN202
            w = _of(items)
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE_ROWS):
                    b = batch.slice(i, SLICE_ROWS)
                    got = [w.scan(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
                    before = b.column(columns.index(mark)).to_pylist() if k else repeat({"hits": [], "items": []})
                    marks = [{"n_words": n, "hits": np.union1d(p["hits"], np.flatnonzero(hit)).astype(np.int32), "items": np.union1d(found, np.array(p["items"], np.int64)).astype(np.int64)} for (n, hit, found), p in zip(got, before)]  # noqa: B905
                    yield pa.RecordBatch.from_arrays([*(b.column(columns.index(c)) for c in names), pa.array(marks, kind)], names=[*names, mark])

        rows = rows.mapInArrow(run, ddl)
        if not last:
            rows = shelf.put(rows)
            if before is not None:
                shelf.drop(before)
            before = rows
    return rows


def _contaminated(mark: str):  # noqa: ANN202
    n_hit = F.size(f"{mark}.hits").cast("long")
    return (n_hit > 0) & (20 * n_hit >= F.col(f"{mark}.n_words"))


def scan(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_ITEM_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits) of every document; hits are the places of the
    words in benchmark windows, which are the spans to remove. One narrow pass if the benchmark fits ``max_bytes``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = _scanned(rows, benchmark, max_bytes, "mark", keep_text=False)
    return got.select(
        "doc_id",
        "mark.n_words",
        F.size("mark.hits").cast("long").alias("n_hit"),
        F.size("mark.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("mark.items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        _contaminated("mark").alias("contaminated"),
        "mark.hits",
    )


def remove(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with all their columns as they were. A document is contaminated if at least
    a twentieth of its words lie in windows of the benchmark."""
    mark = "_".join(["mark", *docs.columns])
    return _scanned(docs, benchmark, max_bytes, mark, keep_text=True).where(~_contaminated(f"`{mark}`")).drop(mark)
