"""Files and results as two streams, against the join of the tables."""

import datetime as dt
import random

from docengine.streaming import joined

T0 = dt.datetime(2024, 1, 1)
FILES, RESULTS = "file_id long, item string, arrived_at timestamp", "result_id long, item string, finished_at timestamp"


def test_streams_equal_tables_and_state_shrinks(spark, tmp_path):
    rng = random.Random(9)
    item = lambda: rng.choice(["hot", "hot", None, *"abcdefgh"])
    at = lambda n, wide: T0 + dt.timedelta(minutes=n * 2 + rng.randrange(wide))
    files = [(n, item(), at(n, 40)) for n in range(400)]
    results = [(n, item(), at(n, 40)) for n in range(400)]
    want = joined.with_results(spark.createDataFrame(files, FILES), spark.createDataFrame(results, RESULTS), "item", "arrived_at", "finished_at", "30 MINUTES")
    key = lambda df: sorted(map(repr, map(tuple, df.select("file_id", "item", "arrived_at", "result_id", "finished_at").collect())))
    held = []
    # Results come a step behind their files; rows are late by less than an hour. Each step is a start of its own, so state is read again.
    for step in range(0, 400, 100):
        last = step == 300
        end = T0 + dt.timedelta(days=9)
        spark.createDataFrame(files[step : step + 100] + ([(-1, "(files)", end)] if last else []), FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "files"))
        spark.createDataFrame(results[step : step + 100] + ([(-1, "(results)", end)] if last else []), RESULTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "results"))
        both = joined.with_results(spark.readStream.schema(FILES).parquet(str(tmp_path / "files")), spark.readStream.schema(RESULTS).parquet(str(tmp_path / "results")), "item", "arrived_at", "finished_at", "30 MINUTES", "1 hour")
        query = joined.start(both, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in query.recentProgress if p["stateOperators"])
    got = spark.read.schema(want.schema).parquet(str(tmp_path / "out"))
    lost, more = set(key(want)) - set(key(got)), set(key(got)) - set(key(want))
    assert not lost and not more, (held, sorted(lost)[:6], sorted(more)[:6])
    assert key(got) == key(want) and got.where("result_id is null").count() > 20 and got.where("result_id is not null").count() > 100
    assert max(held[:-1]) < 400 and held[-1] < 10
