"""As-of and range joins against plain versions, and their plans."""

import datetime as dt
import random

import pytest

from docengine.operators import temporal

T0 = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [3_600_000_000, temporal.PIECE, 10**15])
def test_as_of(spark, piece):
    rng = random.Random(piece)
    at = lambda: None if rng.random() < 0.03 else T0 + dt.timedelta(minutes=rng.randrange(9000))
    key = lambda: rng.choice(["hot", "hot", "a", "b", None, "only"])
    left = [(n, key(), at()) for n in range(500)]
    right = [(n, k, t, rng.choice(["x", "y", None])) for n in range(300) for k, t in [(key(), at())] if k != "only"]
    right += [(n + 1000, *r[1:3], "tied") for n, r in enumerate(right[:20])]
    got = temporal.as_of(spark.createDataFrame(left, "n int, k string, t timestamp"), spark.createDataFrame(right, "m int, k string, u timestamp, v string"), ["k"], "t", "u", ["m", "v"], tie="m", piece=piece)
    want = []
    for n, k, t in left:
        last = max(((u, m, v) for m, j, u, v in right if k is not None and j == k and t is not None and u is not None and u <= t), key=lambda r: r[:2], default=(None, None, None))
        want.append((n, k, t, last[1], last[2]))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_as_of_nothing(spark):
    left, right = spark.createDataFrame([(1, "a", T0)], "n int, k string, t timestamp"), spark.createDataFrame([], "m int, k string, u timestamp")
    assert [tuple(r) for r in temporal.as_of(left, right, ["k"], "t", "u", ["m"]).collect()] == [(1, "a", T0, None)]
    assert temporal.as_of(left.limit(0), right, ["k"], "t", "u", ["m"]).count() == 0


@pytest.mark.parametrize("finest, heavy, keyed", [(1, 10**6, True), (7, 20, True), (1, 5, False), (1000, 50, False)])
def test_range(spark, finest, heavy, keyed):
    rng = random.Random(finest)
    points = [(n, rng.choice(["hot", "a", None]), None if n % 50 == 0 else rng.choice([0, rng.randrange(-300, 300)])) for n in range(400)]
    spans = [(n, rng.choice(["hot", "b", "a", None]), s, s + rng.choice([0, 1, 5, 64, rng.randrange(0, 500), -3])) for n in range(150) for s in [rng.randrange(-310, 300)]] + [(999, "hot", None, 5), (998, "hot", -(10**12), 10**12), (997, "a", 5, None)]
    left, right = spark.createDataFrame(points, "n int, k string, p long"), spark.createDataFrame(spans, "m int, k string, s long, e long")
    right = right if keyed else right.withColumnRenamed("k", "j")
    got = temporal.within(left, right, "p", "s", "e", ["k"] if keyed else [], finest, heavy)
    want = sorted((n, m) for n, k, p in points for m, j, s, e in spans if None not in (p, s, e) and s <= p < e and (not keyed or k is not None and k == j))
    assert sorted((r.n, r.m) for r in got.collect()) == want and len(want) > 300
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_range_of_nothing(spark):
    points, spans = spark.createDataFrame([(1, 5)], "n int, p long"), spark.createDataFrame([(1, 9, 9)], "m int, s long, e long")
    assert temporal.within(points, spans, "p", "s", "e").count() == 0 == temporal.within(points.limit(0), spans.selectExpr("m", "s", "e + 9 as e"), "p", "s", "e").count()


def test_nodes_are_few_and_cover_each_bin_once(spark):
    rng = random.Random(1)
    spans = [(s, s + rng.randrange(1, 3000)) for s in (rng.randrange(-2000, 2000) for _ in range(300))] + [(0, 1), (-1, 0), (-1, 1), (-(2**40), 2**40)]
    df = spark.createDataFrame(spans, "s long, e long").select("s", "e", temporal.nodes("s", "e", 1).alias("nodes"))
    for r in df.collect():
        assert len(r.nodes) <= 2 * (r.e - r.s).bit_length()
        covered = sorted((x.node << x.level, (x.node + 1) << x.level) for x in r.nodes)
        assert covered[0][0] == r.s and covered[-1][1] == r.e and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


@pytest.mark.parametrize("keyed", [True, False])
def test_totals_are_those_of_the_pairs(spark, keyed):
    rng = random.Random(5)
    points = [(n if n % 9 else None, rng.choice(["hot", "a", None]), None if n % 50 == 0 else rng.choice([0, rng.randrange(-300, 300)])) for n in range(400)]
    spans = [(n % 120, rng.choice(["hot", "b", "a", None]), s, s + rng.choice([0, 1, 5, 64, rng.randrange(0, 500), -3])) for n in range(150) for s in [rng.randrange(-310, 300)]] + [(999, "hot", None, 5), (998, "hot", -(10**12), 10**12), (997, "a", 5, None)]
    left, right = spark.createDataFrame(points, "n long, k string, p long"), spark.createDataFrame(spans, "m int, k string, s long, e long")
    right = right if keyed else right.withColumnRenamed("k", "j")
    got = temporal.totals(left, right, "p", "s", "e", ["m"], ["n"], ["k"] if keyed else [])
    want = {}
    for n, k, p in points:
        for m, j, s, e in spans:
            if None not in (p, s, e) and s <= p < e and (not keyed or k is not None and k == j):
                want.setdefault(m, []).append(n)
    assert {r.m: (r.n_points, r.sum_n) for r in got.collect()} == {m: (len(v), sum(n or 0 for n in v) if any(n is not None for n in v) else None) for m, v in want.items()} and len(want) > 30
    assert temporal.totals(left, right.limit(0), "p", "s", "e", ["m"], ["n"]).count() == 0 == temporal.totals(left.limit(0), right, "p", "s", "e", ["m"]).count()


def test_totals_make_no_pairs(spark):
    """200,000 intervals that all hold the same 200,000 points: 40 billion pairs."""
    points, spans = spark.range(200_000).selectExpr("id as n", "7L as p"), spark.range(200_000).selectExpr("id as m", "7 - id % 3 as s", "8 + id % 5 as e")
    got = temporal.totals(points, spans, "p", "s", "e", ["m"], ["n"])
    assert got.where("n_points = 200000 and sum_n = 19999900000").count() == 200_000
