"""Joins by time: as-of (the last version at a moment) and range (moments within intervals), without non-equi joins.

Both deal their rows by keys that also hold a piece of time, so a key with very many rows is spread over its pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of time that an as-of join is dealt by, in microseconds.
PIECE = 86_400_000_000
#: Points of a node that one task of a range join gets, and heavy nodes that are broadcast at most.
HEAVY, HEAVY_NODES = 200_000, 100_000


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], tie: str | None = None, piece: int = PIECE) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` that has the same keys and isn't later; null if there is none.

    Of right rows of equal time the one with the largest ``tie`` counts. Null keys and times match nothing. Both sides are put into one table and
    dealt by keys and piece of time; within a piece, the last right value so far is each left row's. What a piece starts with is the last value of
    the pieces before, found from one row a piece. No join of rows: one shuffle of both sides, and a small one of the pieces."""
    micros, names = (lambda c: F.unix_micros(F.col(c).cast("timestamp"))), [f"_k{n}" for n in range(len(keys))]
    keyed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    value = F.struct(*columns)
    known = right.where(F.col(right_time).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    known = known.select(*keyed, micros(right_time).alias("_t"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), value.alias("_v")).withColumn("_piece", F.floor(F.col("_t") / F.lit(piece)))
    asked = left.select(*keyed, micros(left_time).alias("_t"), F.struct("*").alias("_l")).withColumn("_piece", F.floor(F.col("_t") / F.lit(piece)))
    last = known.groupBy(*names, "_piece").agg(F.max_by("_v", F.struct("_t", "_tie")).alias("_v"))
    pieces = last.unionByName(asked.select(*names, "_piece").distinct().withColumn("_v", F.lit(None).cast(last.schema["_v"].dataType))).groupBy(*names, "_piece").agg(F.max_by("_v", F.col("_v").isNotNull()).alias("_v"))
    before = Window.partitionBy(*names).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    start = pieces.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_v is not null and _piece is not null")
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = (
        start.select(*names, "_piece", F.lit(None).cast("long").alias("_t"), F.lit(0).alias("_side"), null(known, "_tie"), "_v", null(asked, "_l"))
        .unionByName(known.select(*names, "_piece", "_t", F.lit(1).alias("_side"), "_tie", "_v", null(asked, "_l")))
        .unionByName(asked.select(*names, "_piece", "_t", F.lit(2).alias("_side"), null(known, "_tie"), null(known, "_v"), "_l"))
    )
    so_far = Window.partitionBy(*names, "_piece").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(so_far)).where("_side = 2")
    return found.select("_l.*", *[F.col(f"_v.{c}").alias(c) for c in columns])


def nodes(start: str, end: str, finest: int) -> Column:
    """The dyadic nodes (level, node) that together are the bins of ``finest`` units which [start, end) touches: at most two a level."""
    low, high = f"(({start} - pmod({start}, {finest})) div {finest})", f"(({end} + pmod(-{end}, {finest})) div {finest})"
    l, r = f"(-shiftright(-{low}, k))", f"shiftright({high}, k)"
    level = f"array(if({l} < {r} and {l} & 1 = 1, struct(k as level, {l} as node), null), if({l} < {r} and {r} & 1 = 1, struct(k as level, {r} - 1 as node), null))"
    return F.expr(f"if({start} < {end}, filter(flatten(transform(sequence(0, length(bin({high} - {low}))), k -> {level})), n -> n is not null), null)")


def within(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, keys: Sequence[str] = (), finest: int = 1, heavy: int = HEAVY) -> DataFrame:
    """Pairs of a row of ``points`` and a row of ``intervals`` (columns of both) with start <= point < end and equal keys.

    The three columns are integers, of which ``finest`` make a bin. An interval is cut into dyadic nodes, a point lies in one node of each level that
    intervals use, so every pair meets in exactly one node, whatever the interval's length; the ends are compared exactly after. Nodes with more than
    ``heavy`` points are split by point, their intervals copied to each part. Null values and empty intervals match nothing. Column names
    other than keys have to differ."""
    cut = intervals.select("*", F.explode(nodes(start, end, finest)).alias("_at")).select("*", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node")).drop("_at")
    levels = sorted(r._level for r in cut.select("_level").distinct().collect())  # 64 at most
    if not levels:
        return points.join(intervals.drop(*keys), F.lit(False)) if keys else points.join(intervals, F.lit(False))
    bins = F.expr(f"({point} - pmod({point}, {finest})) div {finest}")
    spread = points.where(F.col(point).isNotNull()).withColumn("_bin", bins).withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    spread = spread.withColumn("_node", F.expr("shiftright(_bin, _level)")).drop("_bin")
    at = [*keys, "_level", "_node"]
    counts = spread.groupBy(*at).count().where(F.col("count") > heavy).select(*at, F.ceil(F.col("count") / heavy).alias("_parts"))
    counts = F.broadcast(counts) if counts.limit(HEAVY_NODES + 1).count() <= HEAVY_NODES else counts
    parts = F.coalesce("_parts", F.lit(1))
    spread = spread.join(counts, at, "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts)).drop("_parts")
    cut = cut.join(counts, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return spread.join(cut, [*at, "_part"]).where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_level", "_node", "_part")


def totals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: Sequence[str], sums: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """What within() grouped by ``by`` (columns of ``intervals``) counts and sums: n_points and sum_<column> of all pairs of each group that has any.

    No pair is made: points are added up by node first, and an interval takes the totals of the nodes that it is cut into, two a level at most. Bins
    are single units, so nodes hold exactly the points of their intervals."""
    groups, at = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], [*[f"_k{i}" for i in range(len(keys))], "_level", "_node"]
    keyed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    cut = intervals.select(*groups, *keyed, F.explode(nodes(start, end, 1)).alias("_at")).select("*", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node")).drop("_at")
    levels = sorted(r._level for r in cut.select("_level").distinct().collect()) or [0]  # 64 at most
    added = [F.sum("n_points").alias("n_points"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums]]
    bins = points.where(F.col(point).isNotNull()).groupBy(*keyed, F.col(point).alias("_bin")).agg(F.count("*").alias("n_points"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    spread = bins.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_node", F.expr("shiftright(_bin, _level)")).groupBy(*at).agg(*added)
    out = cut.join(spread, at).groupBy(*[f"_b{i}" for i in range(len(by))]).agg(*added)
    return out.withColumnsRenamed({f"_b{i}": c for i, c in enumerate(by)})
