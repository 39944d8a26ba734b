"""Sketches of batches against exact counts and quantiles, over sets of batches."""

import random

from docengine.plans import audit, sketches


def test_any_set_of_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(n % 8, None if n % 97 == 0 else f"u{int(rng.random() ** 2 * 9000)}", None if n % 89 == 0 else rng.gauss(10, 4)) for n in range(40_000)]
    at = str(tmp_path / "sketches")
    for batch in range(8):
        part = spark.createDataFrame([r for r in rows if r[0] == batch], "batch int, item string, value double")
        sketches.sketch(part, ["batch"], "item", "value").write.mode("append").parquet(at)
    for some in ({0}, {1, 2, 5}, set(range(8))):
        stored = spark.read.parquet(at).where(f"batch in ({','.join(map(str, some))})")
        got = sketches.merged(stored).select(sketches.n_items().alias("items"), sketches.n_values().alias("n"), *[sketches.quantile(q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 0.99))]).first()
        items = len({i for b, i, _ in rows if b in some and i})
        values = sorted(v for b, _, v in rows if b in some and v is not None)
        assert got.n == len(values) and abs(got["items"] - items) <= sketches.DISTINCT_ERROR * items
        for k, q in enumerate((0.1, 0.5, 0.99)):
            rank = sum(v <= got[f"q{k}"] for v in values) / len(values)
            assert abs(rank - q) <= sketches.RANK_ERROR + 1 / len(values)


def test_batches_are_small_and_merge_by_group(spark):
    rows = spark.range(200_000).selectExpr("id % 4 as batch", "id as item", "cast(id as double) as value")
    made = sketches.sketch(rows, ["batch"], "item", "value")
    assert all(len(r["items"]) + len(r["values"]) < 20_000 for r in made.collect())
    halves = sketches.merged(made.withColumn("half", made["batch"] % 2), ["half"]).select("half", sketches.n_values().alias("n")).collect()
    assert {r.half: r.n for r in halves} == {0: 100_000, 1: 100_000}
    assert sketches.merged(made.limit(0)).select(sketches.n_items().alias("n")).first().n in (0, None)


def test_data_of_different_shapes(spark):
    rows = [("a", '{"x": 1, "y": {"z": [true, null, "s"]}}'), ("a", '{"x": "text"}'), ("b", "not json"), ("b", None), ("c", "[1.5, 2]")]
    events = audit.with_data(spark.createDataFrame(rows, "event_type string, data string"))
    got = events.select(audit.datum("$.x", "int").alias("x"), audit.datum("$.y.z[2]", "string").alias("s"), audit.datum("$[0]", "double").alias("first")).collect()
    assert [tuple(r) for r in got] == [(1, "s", None), (None, None, None), (None, None, None), (None, None, None), (None, None, 1.5)]
    shapes = {r.event_type: (r["shape"], r.n) for r in audit.data_shapes(events).collect()}
    assert shapes["b"][1] == 0 and shapes["a"][1] == 2 and shapes["a"][0].startswith("OBJECT<") and shapes["c"][0].startswith("ARRAY<")
