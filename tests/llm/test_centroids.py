"""Centroid clustering against SQL and a plain integer version."""

import hashlib
import math
import random

import pytest
from oracle import same, tables

from docengine.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x double"


def brute(vectors, k, rounds, dims):
    """Rows (vec_id, cluster, distance), and the final centroids."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    found = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(found))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for n in range(len(found)):
            mine = [x for (_, x), o in zip(kept, own) if o == n]
            if mine:
                found[n] = [sum(xs) // len(mine) for xs in zip(*mine)]
    return sorted(((i, n, d) for (i, x) in kept for d, n in [nearest(x)]), key=str), found


def test_matches_sql(spark, sf_dir):
    same(queries.op12_centroid_clustering(spark, sf_dir), tables(sf_dir), centroids.sql())


@pytest.mark.parametrize("k, rounds, spread", [(16, 3, 40), (16, 6, 2), (40, 8, 300), (3, 2, 1), (1, 2, 5)])
def test_by_definition(spark, k, rounds, spread):
    rng = random.Random(k)
    middles = [[rng.uniform(-spread, spread) for _ in range(6)] for _ in range(12)]
    rows = [(i, [m + rng.choice([0, 0.25, -0.5]) for m in rng.choice(middles)]) for i in range(700)]
    rows += [(i % 9, rows[5][1]) for i in range(60)] + [(None, rows[7][1]), (900, [1.0] * 5), (901, None), (902, [1.0] * 5 + [None]), (903, [float("nan")] + [0.0] * 5), (904, [float("inf")] * 6), (905, []), (906, [-0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "y", 0.5) for i, v in rows], SCHEMA).repartition(5)
    got, model = centroids.fit(df, k=k, rounds=rounds, dims=6)
    want, final = brute(rows, k, rounds, 6)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want
    assert model.centroids == final
    assert model.digest(0) == hashlib.sha256(",".join(map(str, final[0])).encode()).hexdigest()
    if k >= 16:
        # All distances are measured in the first round; bounds spare most of them in the last.
        assert model.measured[0] == len(want) * k and model.measured[-1] < 0.6 * model.measured[0]
        assert model.bounds[-1] <= model.bounds[0] == k // 4


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(50 + i, [0.5, 0.0]) for i in range(9)]
    got, _ = centroids.fit(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2, rounds=3, dims=2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == sorted(brute(rows, 2, 3, 2)[0])


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0])], "vec_id int, embedding array<double>")
    assert sorted((r.vec_id, r.cluster, r.distance, r.inertia) for r in centroids.report(df, dims=2).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert centroids.report(df.limit(0)).collect() == [] and centroids.report(df, dims=9).collect() == []
    with pytest.raises(Exception, match="after scaling"):
        centroids.report(spark.createDataFrame([(1, [1e30])], "vec_id int, embedding array<double>"), dims=1).collect()
