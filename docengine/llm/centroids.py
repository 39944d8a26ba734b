"""Operator 12, centroid clustering with Drake's adaptive bounds, exact in integers.

Vectors of integer components are assigned to the nearest of k centroids (squared Euclidean distance, ties to the smaller number), and
centroids become the floors of their vectors' means, in rounds. Each vector keeps an upper bound of the distance to its own
centroid, lower bounds of those to the b next nearest, by number, and one lower bound for all others, the remainder. When centroids
have moved, bounds are loosened by how far. An upper bound below every lower one certifies that the own centroid is still the
nearest. Else the own distance is made exact; if the remainder is still above it, only those of the b that aren't are measured, else all k. Bounds
are doubles rounded outwards by SLACK, decisions are made on exact integers only, and ties are never certified, so results don't
depend on rounding. b starts at a quarter of k; a round lowers it to the most that were measured, to an eighth at the least.

A round is one pass over the stored state (vectors and bounds). Its tasks also hand on exact sums of each cluster, as rows of their own, of
which Spark adds up k x components at most for each task; the driver holds k centroids and nothing else.

Defined results: vectors of another length, null ones, and those with a null or non-finite component are left out; repeated rows are
vectors each; a null id is hashed as an empty one, equal hashes are taken in order of components; with fewer vectors than k there are as
many centroids; no vectors, no rows. A component beyond 2**27 after scaling raises an error, as distances wouldn't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Shelf

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
LIMIT = 1 << 27
#: Relative margin of a bound; the error of a square root, a sum and a difference of doubles is below 1e-15.
SLACK = 1e-12
#: Vectors handled at once.
ROWS = 8192
PART = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("depth", T.IntegerType()), T.StructField("measured", T.LongType())])


@dataclass
class Model:
    """Final centroids, and what finding them took: distances measured in each round, and the bounds kept in each."""

    centroids: list[list[int]]
    measured: list[int]
    bounds: list[int]

    def digest(self, number: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[number])).encode()).hexdigest()


def gathered(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to ``rows`` rows, so that a numpy pass doesn't depend on how Spark cut them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=rows)
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=rows)


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that are kept; x has floor(scale * component)."""
    schema = T.StructType([T.StructField("vec_id", vectors.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            rows = np.flatnonzero(pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy() == dims)
            flat = batch.column(1).take(pa.array(rows)).flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            ok = np.isfinite(values).all(1)
            scaled = np.floor(scale * values[ok])
            if len(scaled) and np.abs(scaled).max() > LIMIT:
                raise ValueError(f"a component is beyond {LIMIT} after scaling")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[ok])), _lists(scaled.astype(np.int32))], names=schema.names)

    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).mapInArrow(run, schema)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(np.ascontiguousarray(matrix).ravel()))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows against all centroids."""
    out = np.empty((len(x), len(c)), np.int64)
    for k, row in enumerate(c):
        d = x - row
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


class Bounded:
    """Assignments of a batch of vectors and their bounds."""

    def __init__(self, x: np.ndarray, centroids: np.ndarray, b: int) -> None:
        self.x, self.c, self.b, self.depth, self.measured = x.astype(np.int64), centroids, b, 0, 0

    def start(self) -> None:
        n = len(self.x)
        self.cluster, self.upper = np.zeros(n, np.int64), np.zeros(n)
        self.near, self.low = np.zeros((n, self.b), np.int64), np.zeros((n, self.b + 1))
        self._all(np.arange(n))

    def resume(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, moved: np.ndarray) -> None:
        """Loosen the bounds by what each centroid has moved, drop those beyond ``b``, and measure what they can't certify."""
        self.cluster, self.near = cluster.astype(np.int64), near.astype(np.int64)
        self.upper = (upper + moved[self.cluster]) * (1 + SLACK)
        low = low - np.column_stack([moved[self.near], np.full(len(low), moved.max())])
        low = np.where(low > 0, low * (1 - SLACK), low * (1 + SLACK))
        # The remainder takes the bounds of those that are no longer told apart.
        self.low = np.column_stack([low[:, : self.b], low[:, self.b :].min(1)])
        self.near = self.near[:, : self.b]
        doubt = np.flatnonzero(self.low.min(1) <= self.upper)
        own = self._exact(doubt, self.cluster[doubt])
        self.upper[doubt] = np.sqrt(own.astype(float)) * (1 + SLACK)
        everything = self.low[doubt, self.b] <= self.upper[doubt]
        self._all(doubt[everything])
        self._some(doubt[~everything], own[~everything])

    def _exact(self, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.c[numbers]
        self.measured += len(rows)
        return np.einsum("ij,ij->i", d, d)

    def _all(self, rows: np.ndarray) -> None:
        """Measure all centroids for these rows."""
        squares = _squares(self.x[rows], self.c)
        self.measured += squares.size
        order = np.argsort(squares, axis=1, kind="stable")
        roots = np.sqrt(np.take_along_axis(squares, order, 1).astype(float))
        self.cluster[rows], self.near[rows] = order[:, 0], order[:, 1 : self.b + 1]
        self.upper[rows] = roots[:, 0] * (1 + SLACK)
        rest = roots[:, self.b + 1] if self.b + 1 < len(self.c) else np.full(len(rows), np.inf)
        self.low[rows] = np.column_stack([roots[:, 1 : self.b + 1], rest]) * (1 - SLACK)

    def _some(self, rows: np.ndarray, own: np.ndarray) -> None:
        """Measure those of the b next centroids whose bounds aren't above the own distance; the others are certified farther."""
        asked = self.low[rows, : self.b] <= self.upper[rows, None]
        if not asked.any():
            return
        self.depth = max(self.depth, int(asked.sum(1).max()))
        at, place = np.nonzero(asked)
        squares = np.full(asked.shape, np.iinfo(np.int64).max)
        squares[at, place] = self._exact(rows[at], self.near[rows[at], place])
        self.low[rows[at], place] = np.sqrt(squares[at, place].astype(float)) * (1 - SLACK)
        least = squares.min(1)
        # Of equal distances the smaller number.
        best = np.where(squares == least[:, None], self.near[rows], len(self.c)).argmin(1)
        number = self.near[rows, best]
        new = np.flatnonzero((least < own) | (least == own) & (number < self.cluster[rows]))
        r, j = rows[new], best[new]
        self.near[r, j], self.low[r, j] = self.cluster[r], np.sqrt(own[new].astype(float)) * (1 - SLACK)
        self.cluster[r], self.upper[r] = number[new], np.sqrt(least[new].astype(float)) * (1 + SLACK)
        order = np.argsort(self.low[rows, : self.b], axis=1, kind="stable")
        self.near[rows] = np.take_along_axis(self.near[rows], order, 1)
        self.low[rows, : self.b] = np.take_along_axis(self.low[rows, : self.b], order, 1)


def _assigned(state: DataFrame, schema: T.StructType, centroids: list[list[int]], moved: list[float] | None, before: int, b: int) -> DataFrame:
    """A round's pass: the vectors with their clusters and bounds, and after them each task's sums by cluster (part)."""
    dims, arrow = len(centroids[0]), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        n, sums = np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64)
        depth = measured = 0
        for batch in gathered(batches):
            own = Bounded(_matrix(batch.column(1), dims), c, b)
            if moved is None:
                own.start()
            else:
                own.resume(batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4), before), _matrix(batch.column(5), before + 1), np.array(moved))
            n += np.bincount(own.cluster, minlength=len(c))
            np.add.at(sums, own.cluster, own.x)
            depth, measured = max(depth, own.depth), measured + own.measured
            columns = [batch.column(0), batch.column(1), pa.array(own.cluster.astype(np.int32)), pa.array(own.upper), _lists(own.near.astype(np.int32)), _lists(own.low)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(batch.num_rows, arrow[6].type)], schema=arrow)
        found = np.flatnonzero(n)
        part = pa.StructArray.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found]), _lists(sums[found]), pa.array(np.full(len(found), depth, np.int32)), pa.array(np.where(np.arange(len(found)) == 0, measured, 0))], fields=list(arrow[6].type))
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(found), f.type) for f in list(arrow)[:6]], part], schema=arrow)

    return state.select(*[c for c in schema.names[:6] if c in state.columns]).mapInArrow(run, schema)


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "1:", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Model]:
    """(vec_id, x, cluster, distance) of every kept vector after ``rounds`` rounds and one more assignment, and the model.

    The centroids start as the k vectors whose ids, after ``seed``, have the smallest SHA-256."""
    shelf = Shelf(vectors.sparkSession)
    state = shelf.put(integers(vectors, dims, scale, id_col, vec_col))
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.x) for r in state.orderBy(hashed, "x").limit(k).select("x").collect()]
    schema = T.StructType([*state.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("near", T.ArrayType(T.IntegerType())), T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("part", PART)])
    found = Model(centroids, [], [])
    if not centroids:
        return state.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), found
    b = before = min(max(len(centroids) // 4, 1), len(centroids) - 1)
    moved = None
    for turn in range(rounds + 1):
        old, state = state, shelf.put(_assigned(state, schema, found.centroids, moved, before, b))
        shelf.drop(old)
        parts, state = state.where("part is not null").select("part.*"), state.where("part is null")
        state._shelf_path = f"{shelf.root}/{shelf.n}"
        depth, measured = parts.agg(F.max("depth"), F.sum("measured")).first()
        found.measured.append(measured)
        found.bounds.append(b)
        if turn < rounds:
            summed = parts.select("cluster", "n", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at")
            new = [list(c) for c in found.centroids]
            for r in summed.agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n")).collect():
                new[r.cluster][r["at"]] = int(r["sum"]) // r.n
            moved = [float(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))))) * (1 + SLACK) for x, y in zip(found.centroids, new, strict=True)]
            found.centroids = new
            before, b = b, b if turn == 0 else min(b, max(len(centroids) // 8, depth, 1))
    return _distances(state, found.centroids), found


def _distances(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    schema = T.StructType([*state.schema.fields[:3], T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in gathered(batches):
            d = _matrix(batch.column(1), c.shape[1]).astype(np.int64) - c[batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.einsum("ij,ij->i", d, d))], names=schema.names)

    return state.select("vec_id", "x", "cluster").mapInArrow(run, schema)


def report(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    rows, model = fit(vectors, k, rounds, dims, scale, "1:", id_col, vec_col)
    rows = Shelf(spark).put(rows.select("vec_id", "cluster", "distance"))
    sums = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    clusters = spark.createDataFrame([(c, d, sum(sums.values()), model.digest(c)) for c, d in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most


def sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """DuckDB SQL of report(): the rounds in sequence, every distance measured."""
    ctes = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256(concat('1:', vec_id)) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
        f"e AS (SELECT r, unnest(x) AS xi, unnest(range({dims})) AS i FROM v)",
    ]
    for t in range(rounds + 1):
        ctes.append(f"s{t} AS (SELECT c, unnest(x) AS ci, unnest(range({dims})) AS i FROM c{t})")
        ctes.append(f"d{t} AS (SELECT r, c, CAST(sum((xi - ci) * (xi - ci)) AS BIGINT) AS d FROM e JOIN s{t} USING (i) GROUP BY r, c)")
        ctes.append(f"a{t} AS (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if t < rounds:
            ctes.append(f"m{t} AS (SELECT c, i, sum(CAST(xi AS HUGEINT)) AS s, CAST(count(*) AS HUGEINT) AS n FROM e JOIN a{t} USING (r) GROUP BY c, i)")
            ctes.append(f"n{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{t} GROUP BY c)")
            ctes.append(f"c{t + 1} AS (SELECT c, coalesce(n.x, o.x) AS x FROM c{t} AS o LEFT JOIN n{t} AS n USING (c))")
    last = rounds
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(CAST(o.x AS VARCHAR[]), ',')) AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN c{last} AS o USING (c)"""
