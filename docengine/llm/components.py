"""Links between the members of buckets, and connected components, as Spark jobs whose state is tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, broadcast_if_small, small_batches

#: Nodes of a block; a pair of blocks is handled by one task at once.
BLOCK = 256
#: Items of sets that a worker keeps, so that a text met in several groups is taken apart once.
CACHE_ITEMS = 4_000_000
#: How many times more nodes lead a bucket in each round.
LEADERS = 16
#: Words of 64 bits in the sketch of a set.
SKETCH_WORDS = 8
#: Parts of a node's edges when the least neighbour is joined to them, so that no task has all edges of a hub.
SALTS = 8


def components(shelf: Shelf, edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least node of its component.

    Large-star and small-star steps alternate until nothing changes: each links a node's neighbours to the least of them.
    Their number grows with the logarithm of the longest path. A step takes two shuffles of the edges that are left; the
    least neighbour is found with partial aggregation and joined to the edges in SALTS parts, so a node with very many neighbours is
    no group of one task."""
    now = shelf.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _salted(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, now = now, shelf.put(small)
        shelf.drop(old)
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _salted(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) joined to ``least`` (u, m), each node's edges in SALTS parts."""
    parts = least.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(parts, ["u", "salt"]).drop("salt")


def links(shelf: Shelf, members: DataFrame, verify: Callable[[DataFrame], DataFrame], threshold: float, within: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components of the nodes whose similarity, found by ``verify``, reaches ``threshold`` within some bucket.

    ``members`` is (bucket, node), buckets of at least two nodes. ``verify`` takes pairs (a, b) and returns (a, b, sim); 1 - sim
    must be a metric. Pairs within a bucket are not listed. In the first round each bucket's leader, the node that shares most
    buckets with most others, is compared with the others, which joins copies of one text. Then only buckets count whose
    remaining nodes are still in different components. They are dealt into blocks of at most BLOCK nodes, and each pair of blocks
    of a bucket goes to ``within`` as one group (bucket, i, j, node, comp), which returns links (a, b) that
    span those in it. No link is lost and nothing is capped.

    Returns (node, root) of the nodes that have a link."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weight = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))
    members = shelf.put(members.join(weight, "node").select("bucket", "node", "weight"))
    first = members.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("first"))
    star = members.join(first, "bucket").where("node <> first").select("bucket", "node", "first")
    sims = shelf.put(verify(star.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()))
    edges = shelf.put(sims.where(F.col("sim") >= threshold).select("a", "b"))
    # The leaders are done. What is left of buckets of three or more goes on.
    left = star.select("bucket", "node")
    more = left.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("bucket")
    left = left.join(more, "bucket")
    roots = shelf.put(components(shelf, edges))
    named = left.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    # Near copies share several buckets: of buckets with the same nodes, told by 128 bits, one is looked into.
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"mark{k}") for k in (1, 2)]
    open_ = named.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"), *marks).where("x <> y")
    open_ = open_.groupBy("size", "mark1", "mark2").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    named = shelf.put(named.join(open_, "bucket"))
    if named.isEmpty():
        return roots
    return components(shelf, edges.unionByName(shelf.put(within(_blocks(named)).distinct())))


def _joined(shelf: Shelf, roots: DataFrame, new: DataFrame) -> DataFrame:
    """``roots`` (node, root) with the components that the links ``new`` (a, b) join: only old roots go through the union-find."""
    ends = new.select(F.col("a").alias("node")).union(new.select("b")).distinct().join(roots, "node", "left_anti")
    known = roots.unionByName(ends.withColumn("root", F.col("node")))
    a, b = (known.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    between = new.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    over = components(shelf, between).select(F.col("node").alias("root"), F.col("root").alias("over"))
    return known.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root"))


def sketched(sets: DataFrame) -> DataFrame:
    """(node, size, w0, w1, ...) of sets (node, items) of 64-bit hashes: each item flips one bit of a sketch of SKETCH_WORDS words. Two sketches
    differ in at most as many bits as there are items in only one of the sets."""
    rows = sets.select("node", F.explode("items").alias("x"))
    word, bit = F.expr(f"shiftrightunsigned(x, 6) % {SKETCH_WORDS}"), F.expr("shiftleft(1L, CAST(x & 63 AS INT))")
    words = [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(SKETCH_WORDS)]
    return rows.groupBy("node").agg(F.count("*").alias("size"), *words)


def may_reach(threshold: float, other: str) -> Column:
    """False only if the Jaccard similarity of two sketched sets, the columns of one with the prefix ``other``, is below ``threshold``."""
    bits = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"{other}w{k}"))) for k in range(1, SKETCH_WORDS)), F.bit_count(F.col("w0").bitwiseXOR(F.col(f"{other}w0"))))
    only_one = F.greatest(bits.cast("long"), F.abs(F.col("size") - F.col(f"{other}size")))
    return only_one <= (F.col("size") + F.col(f"{other}size")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-6


def linked(shelf: Shelf, members: DataFrame, similar: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.0) -> DataFrame:
    """(node, root) of the nodes that have a link; ``similar`` takes pairs (a, b), a the leader, and returns those that are links.

    ``members`` is (bucket, node), buckets of at least two nodes, stored. Rounds follow each other. In each, a bucket whose nodes are
    still in different components has leaders, which are compared with its nodes in other components; then components are found
    anew. The first leader is the node that shares most buckets with most others, so copies of one text need no second round.
    After that LEADERS times as many lead a bucket as in the round before, nodes of its largest component excepted. A pair is
    compared once in all buckets. It ends when no bucket is left that has nodes of two components and a node that hasn't led,
    so no link is lost and nothing is capped; nodes of one component are never compared with each other again.

    With ``sets``, which gives (node, items) of nodes, links have a Jaccard similarity of at least ``threshold``. After the first round leaders
    and nodes then meet by sketch, and pairs whose sketches differ too much for a link are no rows. What a bucket of nodes that don't
    resemble each other costs is still a look at the sketches of all its pairs within the join, but no pair that is stored, shuffled and verified."""
    if members.isEmpty():
        return members.select("node", F.col("node").alias("root"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weight = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))
    now = shelf.put(members.join(weight, "node").select("bucket", "node", "weight", F.col("node").alias("comp"), F.lit(False).alias("led")))
    tested = roots = sketches = None
    slots = 1
    while True:
        slot = F.pmod(F.xxhash64("node"), F.lit(slots))
        free = now.where(~F.col("led") & (F.col("comp") != F.col("largest"))) if roots is not None else now
        lead = free.groupBy("bucket", slot.alias("slot")).agg(F.max(F.struct("weight", "node", "comp")).alias("x"))
        lead = shelf.put(lead.select("bucket", F.col("x.node").alias("leader"), F.col("x.comp").alias("own")))
        ends = [F.least("leader", "node").alias("x"), F.greatest("leader", "node").alias("y")]
        if sketches is None:
            met = now.join(lead, "bucket").where("comp <> own")
        else:
            of_lead = sketches.select(*[F.col(c).alias("leader" if c == "node" else f"lead_{c}") for c in sketches.columns])
            met = now.join(sketches, "node").join(lead.join(of_lead, "leader"), "bucket").where("comp <> own").where(may_reach(threshold, "lead_"))
        pairs = met.groupBy(*ends).agg(F.min("leader").alias("a"))
        pairs = pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti")
        pairs = shelf.put(pairs.select("x", "y", "a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b")))
        tested = pairs.select("x", "y") if tested is None else tested.unionByName(pairs.select("x", "y"))
        fresh = False
        if roots is None or not pairs.isEmpty():
            new = shelf.put(similar(pairs.select("a", "b")))
            fresh = roots is None or not new.isEmpty()
        if fresh:
            roots = shelf.put(components(shelf, new) if roots is None else _joined(shelf, roots, new))
        led = lead.select("bucket", F.col("leader").alias("node"), F.lit(True).alias("leads"))
        named = now.select("bucket", "node", "weight", "led").join(roots, "node", "left").join(led, ["bucket", "node"], "left")
        named = shelf.put(named.select("bucket", "node", "weight", F.coalesce("root", "node").alias("comp"), (F.col("led") | F.col("leads").isNotNull()).alias("led")))
        # Buckets of two components or more that have a node outside the largest which hasn't led.
        parts = named.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.count_if(~F.col("led")).alias("left"))
        wide = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max_by("left", F.struct("n", "comp")).alias("own_left"), F.sum("left").alias("left"), F.count("*").alias("comps"))
        wide = wide.where("comps > 1 and left > own_left").select("bucket", "largest")
        old, now = now, shelf.put(named.join(wide, "bucket"))
        for x in (old, named, lead):
            shelf.drop(x)
        if now.isEmpty():
            return roots
        if sets and sketches is None:
            sketches = shelf.put(sketched(sets(now.select("node").distinct())))
            sketches = broadcast_if_small(sketches, 8 * (SKETCH_WORDS + 4))
        slots *= LEADERS


def _blocks(named: DataFrame) -> DataFrame:
    """(bucket, i, j, node, comp): each node of a bucket of n blocks in the n pairs (i <= j) that its block takes part in."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = named.select("bucket", "node", "comp", n.alias("n"), F.pmod(F.xxhash64("node"), n).cast("int").alias("own"))
    spread = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return spread.select("bucket", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "node", "comp")


class _Sets:
    """``sets_of`` of texts by node, kept in a bounded cache."""

    def __init__(self, sets_of: Callable[[str], np.ndarray]) -> None:
        self.sets_of, self.kept, self.items = sets_of, {}, 0

    def of(self, node: object, text: str) -> np.ndarray:
        got = self.kept.get(node)
        if got is None:
            got = self.sets_of(text)
            if self.items + len(got) > CACHE_ITEMS:
                self.kept, self.items = {}, 0
            self.kept[node] = got
            self.items += len(got)
        return got


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct items."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def verifier(texts: DataFrame, sets_of: Callable[[str], np.ndarray], kind: str) -> Callable[[DataFrame], DataFrame]:
    """Exact similarities of pairs of nodes; ``texts`` is (node, text), ``sets_of`` makes a text a sorted array of distinct items."""

    def verify(pairs: DataFrame) -> DataFrame:
        small_batches(pairs.sparkSession)
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = _Sets(sets_of)
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                sims = [jaccard(sets.of(x, s), sets.of(y, t)) for x, y, s, t in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

        return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, sim double")

    return verify


def _near(sets: list[np.ndarray], comps: list, threshold: float) -> tuple[list[int], list[int]]:
    """Index pairs that span the links between sets of different components, by products of incidence matrices."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    every, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(every), -1)
    place[shared] = np.arange(len(shared))
    at = place[col]
    for start in range(0, len(shared), 4096):
        part = (at >= start) & (at < start + 4096)
        m = np.zeros((len(sets), min(4096, len(shared) - start)), np.float32)
        m[row[part], at[part] - start] = 1
        both += m @ m.T
    comp = np.unique(comps, return_inverse=True)[1]
    near = (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6) & (comp[:, None] != comp[None, :])
    return forest(near)


def forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric boolean matrix: fewer than its rows, with the same components."""
    a: list[int] = []
    b: list[int] = []
    unseen = np.ones(len(near), bool)
    for start in range(len(near)):
        stack = [start] if unseen[start] else []
        unseen[start] = False
        while stack:
            x = stack.pop()
            new = np.flatnonzero(near[x] & unseen)
            unseen[new] = False
            a += [x] * len(new)
            b += new.tolist()
            stack += new.tolist()
    return a, b


def within(texts: DataFrame, sets_of: Callable[[str], np.ndarray], kind: str, threshold: float) -> Callable[[DataFrame], DataFrame]:
    """Links of groups (bucket, i, j, node, comp) of at most two blocks each. Rows stream by sorted, a group is held at once."""

    def find(blocks: DataFrame) -> DataFrame:
        small_batches(blocks.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = _Sets(sets_of)
            rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for _, group in groupby(rows, key=lambda r: r[:3]):
                found = {r[3]: (r[4], r[5]) for r in group}
                nodes, comps = list(found), [c for c, _ in found.values()]
                if len(set(comps)) < 2:
                    continue
                mine = [sets.of(n, t) for n, (_, t) in found.items()]
                if len(nodes) <= 4:
                    links = [(x, y) for x in range(len(nodes)) for y in range(x + 1, len(nodes)) if comps[x] != comps[y] and jaccard(mine[x], mine[y]) >= threshold - 1e-9]
                    a, b = [x for x, _ in links], [y for _, y in links]
                else:
                    a, b = _near(mine, comps, threshold)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in a]), pa.array([nodes[y] for y in b])], names=["a", "b"])

        rows = blocks.join(texts, "node").select("bucket", "i", "j", "node", "comp", "text")
        return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, f"a {kind}, b {kind}")

    return find
