"""Operator 10, fuzzy line deduplication by MinHash. DataFrame functions only.

Lines that aren't blank (white space at the ends aside) and resemble each other are one component, of which one line stays: the
first by (doc_id, hash of the text, place). Two lines resemble each other if the Jaccard similarity of their sets of
SHINGLE-character shingles is at least 0.8; a shorter line is one shingle.

Equal lines are one node from the start, a 128-bit hash. A node's shingles are all hashed once and sorted, which puts the set in the order
of one random permutation, on a ring. The signature reads the ring at STARTS fixed places: from each, the next WINDOW values are the
WINDOW least ones of the permutation that begins there, and their hash is the bucket of one band. Two lines share it exactly if the
next WINDOW elements of their union are in both, so with probability 0.8**6 at 0.8, and none of the 20 with 0.002, wherever and in whatever
script they differ. Sets of at most SMALL shingles give windows of 4 from every element instead: among u elements on a ring of which at most a
fifth differ, 4 in a row are in both, so no pair is missed. Lines of FEW to SMALL give both, so that a pair at 0.8 always has a kind in common.

Pairs are found and compared exactly by :func:`.components.linked`, after its first round only those whose sketches don't rule out a link; components come from its distributed union-find.

Defined results: a null text has no lines and stays null; blank lines stay always; equal texts under one doc_id are one document,
all its rows losing the same lines; null ids rank last; other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, broadcast_if_small
from .components import linked

SHINGLE, SIMILAR, LEAST_CHARS = 5, 0.8, 1
WINDOW, STARTS, SMALL_WINDOW = 6, 20, 4
SMALL, FEW = 40, 32
SPACES = " \t\n\x0b\x0c\r"
#: The second half of a character that Java stores as two is no place to start at.
ANY = "[^\\uDC00-\\uDFFF]"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, seen, place, line) of every line that takes part."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("seen"), F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    rows = rows.select("doc_id", "seen", "place", F.btrim("raw", F.lit(SPACES)).alias("line"))
    return rows.where(F.length("line") >= LEAST_CHARS)


def _id(line: str = "line") -> Column:
    return F.unhex(F.md5(line))


def shingles(line: Column) -> Column:
    """A line's shingles, in order; a short line is one shingle."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=({ANY}.{{{SHINGLE - 1}}}))"), F.lit(1))
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(found)


def shingle_set(line: Column) -> Column:
    """64-bit hashes of the different :func:`shingles`. Lines are cut in UTF-32, where a character of any script is four bytes, so without a pattern and
    without counting characters. The binary is bound to a lambda variable, which isn't copied at every use."""
    size = 4 * SHINGLE

    def cut(b: Column) -> Column:
        starts = F.sequence(F.lit(1), F.octet_length(b) - (size - 1), F.lit(4))
        return F.when(F.octet_length(b) < size, F.array(F.xxhash64(b))).otherwise(F.transform(starts, lambda i: F.xxhash64(F.substr(b, i, F.lit(size)))))

    return F.array_distinct(F.get(F.transform(F.array(F.encode(line, "UTF-32")), cut), F.lit(0)))


#: The least values of STARTS equal parts of the 64-bit integers.
PLACES = [-(-(k * 2**64) // STARTS) - 2**63 for k in range(STARTS)]


def _hashed(ring: Column, at: Column, kind: int, size: int) -> Column:
    """Hashes of ``size`` elements in a row of a ring, from each of the places ``at`` (from 1)."""
    return F.transform(at, lambda i: F.xxhash64(F.lit(kind), *[F.get(ring, i + k) for k in range(-1, size - 1)]))


def signed(lines: DataFrame) -> DataFrame:
    """(id, buckets) of different lines (id, line). What is used twice is a column of its own, so that it is evaluated once.

    The first element after each of PLACES is found by sorting the places in among the elements: the k-th place's own position, less the k places
    before it, is that element's position on the ring (one behind the last is the first again)."""
    rings = lines.select("id", F.sort_array(shingle_set(F.col("line"))).alias("ring"))
    places = F.array(*[F.lit(x).cast("long") for x in PLACES])
    rings = rings.select("id", "ring", F.size("ring").alias("n"), F.sort_array(F.concat("ring", places)).alias("among"))
    at = F.array(*[(F.array_position("among", F.lit(x).cast("long")) - k).cast("int") for k, x in enumerate(PLACES)])
    # Rings go on from the start behind their last element.
    rings = rings.select("id", "n", F.concat("ring", F.slice("ring", 1, WINDOW)).alias("ring"), F.when(F.col("n") >= FEW, F.array_distinct(at)).alias("at"))
    n, ring = F.col("n"), F.col("ring")
    kinds = [_hashed(ring, F.col("at"), 0, WINDOW), F.when(n.between(1, SMALL), _hashed(ring, F.sequence(F.lit(1), n), 1, SMALL_WINDOW))]
    none = F.array().cast("array<bigint>")
    return rings.select("id", F.array_distinct(F.concat(*[F.coalesce(x, none) for x in kinds])).alias("buckets"))


def _similar(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines resemble each other; ``texts`` is (node, line). The set of a, which has many pairs, is made once."""
    b = texts.select(F.col("node").alias("b"), F.col("line").alias("line_b"))
    a = texts.join(pairs.select(F.col("a").alias("node")).distinct(), "node").select(F.col("node").alias("a"), shingle_set(F.col("line")).alias("set_a"))
    rows = pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", shingle_set(F.col("line_b")).alias("set_b"))
    both = rows.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("sizes"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
    return both.where(F.col("both") >= F.lit(SIMILAR) * (F.col("sizes") - F.col("both")) - 1e-9).select("a", "b")


def dropped(docs: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, seen, lines) of the documents that lose lines; seen is xxhash64 of the text, lines their sorted places."""
    shelf = shelf or Shelf(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "seen", "place")
    different = _lines(docs).select(_id().alias("id"), "line").groupBy("id").agg(F.any_value("line").alias("line"))
    signatures = shelf.put(signed(different))
    spread = signatures.select(F.col("id").alias("node"), F.explode("buckets").alias("bucket"))
    # Only buckets are shuffled here, counted before that; a line has no bucket twice.
    shared = shelf.put(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    members = shelf.put(spread.join(broadcast_if_small(shared, 8), "bucket").select("bucket", "node"))
    shelf.drop(signatures)
    shelf.drop(shared)
    wanted = shelf.put(members.select("node").distinct())
    texts = _lines(docs).select(_id().alias("node"), "line").join(broadcast_if_small(wanted, 16), "node", "left_semi")
    texts = shelf.put(texts.groupBy("node").agg(F.any_value("line").alias("line")))
    def sets(nodes: DataFrame) -> DataFrame:
        return texts.join(broadcast_if_small(shelf.put(nodes), 16), "node", "left_semi").select("node", shingle_set(F.col("line")).alias("items"))

    roots = shelf.put(linked(shelf, members, lambda pairs: _similar(texts, pairs), sets, SIMILAR))
    shelf.drop(members)
    shelf.drop(texts)
    lines = shelf.put(_lines(docs).select("doc_id", "seen", "place", _id().alias("id")))
    # Each node's first line, then each component's; lines whose node has one line and no link need no further look.
    firsts = lines.groupBy("id").agg(F.min(order).alias("first"), F.count("*").alias("times"))
    rooted = firsts.join(roots.withColumnRenamed("node", "id"), "id", "left").where("times > 1 or root is not null")
    rooted = shelf.put(rooted.select("id", F.coalesce("root", "id").alias("root"), "first"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    heads = shelf.put(rooted.join(heads, "root").select("id", "head"))
    lost = lines.join(broadcast_if_small(heads, 64), "id")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("seen") == F.col("head.seen")) & (F.col("place") == F.col("head.place"))
    return lost.where(~kept).groupBy("doc_id", "seen").agg(F.sort_array(F.collect_set("place")).alias("lines"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("seen"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    lost = dropped(docs).select(F.col("doc_id").alias("lost_id"), F.col("seen").alias("lost_seen"), "lines")
    out = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("seen") == F.col("lost_seen")), "left")
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(lines).cast("long").alias("n_dropped"), lines.alias("dropped"))


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` without the dropped lines, all other columns as they were; n_chars, if there is one, follows the text."""
    shelf = Shelf(docs.sparkSession)
    lost = shelf.put(dropped(docs, shelf)).select(F.col("doc_id").alias("lost_id"), F.col("seen").alias("lost_seen"), F.col("lines").alias("lost_lines"))
    names, mark = docs.columns, "_".join(["lost", *docs.columns])
    n_lines = lost.agg(F.count("*"), F.sum(F.size("lost_lines"))).first()
    lost = lost.select(F.struct("lost_id", "lost_seen", "lost_lines").alias(mark))
    lost = broadcast_if_small(lost, 32, n_lines[0] + (n_lines[1] or 0) // 8)
    joined = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(F.col(f"`{mark}`.lost_id")) & (F.xxhash64(docs["text"]) == F.col(f"`{mark}`.lost_seen")), "left")
    gone = F.col(f"`{mark}`.lost_lines")
    places = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    left = F.array_join(F.transform(F.filter(places, lambda p: ~F.array_contains(gone, p["i"])), lambda p: p["x"]), "\n")
    text = F.when(gone.isNull(), F.col("text")).otherwise(left)
    out = joined.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in names])
