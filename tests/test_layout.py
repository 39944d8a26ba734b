"""Tables laid out by key: the same answers, and no shuffle of what is stored."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docengine.plans import audit, layout

T0 = dt.datetime(2024, 1, 1)


def history(spark, n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        run = "hot" if rng.random() < 0.34 else f"r{rng.randrange(40)}"
        item = f"i{sum(map(ord, run)) % 9}"
        rows.append((run, seq, f"b{seq % 3}", item, f"h-{item}", "p1", rng.choice(audit.STATUSES), T0 + dt.timedelta(minutes=rng.randrange(200)), T0 + dt.timedelta(minutes=rng.randrange(200))))
    return spark.createDataFrame(rows, "run_id string, seq long, batch_id string, item_id string, content_hash string, policy_version string, status string, created_at timestamp, updated_at timestamp")


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect()))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_history(spark, tmp_path, no_broadcast):
    rows = history(spark)
    old = layout.Laid(spark, "t_old", str(tmp_path / "old"), 8)
    for part in (rows.where("seq < 200"), rows.where("seq >= 200")):
        for table, x in zip(("runs", "run_events"), layout.versions(part), strict=True):
            old.add(table, x)
    new = old.compacted("t_new", str(tmp_path / "new"))
    runs, events = layout.versions(rows)
    latest, items = audit.latest(runs), runs.select(*layout.KEY).distinct()
    for laid in (old, new):
        same(laid.latest(), latest)
        same(laid.load(), audit.load_runs(runs, events))
        assert layout.exchanged(laid.latest()) == [] and layout.exchanged(laid.load()) == []
    same(new.existing(items), audit.find_existing(items, latest))
    # Only the items that ask are shuffled.
    stored = spark.createDataFrame(items.collect(), items.schema)
    assert len(layout.exchanged(new.existing(stored))) == 1
    assert len(layout.exchanged(audit.latest(runs))) == 1  # what it is without the layout
    # One file a bucket after compaction.
    assert len(list((tmp_path / "new/runs").glob("*.parquet"))) <= 8 < len(list((tmp_path / "old/runs").glob("*.parquet")))
    old.drop()
    new.drop()
    assert (tmp_path / "new/runs").exists()


def test_empty_history(spark, tmp_path):
    laid = layout.Laid(spark, "t_none", str(tmp_path), 4)
    for table, x in zip(("runs", "run_events"), layout.versions(history(spark, 3).where(F.lit(False))), strict=True):
        laid.add(table, x)
    assert laid.load().count() == 0 and laid.latest().count() == 0
    laid.drop()
