"""Batches that are added exactly once, renames with a journal, and the state machine of runs, each stopped at every step."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from docengine.plans import apply, audit, history, run
from docengine.plans.history import History, add_batch, run_batches
from docengine.plans.policy import DEFAULT
from docengine.sources import journal, local
from docengine.streaming import incremental, runs

T0 = dt.datetime(2024, 1, 1)
INVOICE = "Tax Invoice\nInvoice No: INV-{0}\nDate: 15/01/2024\nSupplier: Acme Trading\nTotal Due: R 1,234.56"
ITEMS = "item_id string, path string, content_hash string, mime string, text string, error string, arrived_at timestamp"


def items(spark, numbers, folder="in", version=""):
    rows = []
    for n in numbers:
        mime = "text/plain" if n % 7 == 3 else "application/pdf"
        rows.append((f"i{n}", f"{folder}/scan{n}" + (".pdf" if n % 2 else ""), f"{n:032d}{version}", mime, "Memo" if n % 5 == 4 else INVOICE.format(n), "empty_file" if n % 11 == 10 else None, T0 + dt.timedelta(hours=n)))
    return spark.createDataFrame(rows, ITEMS)


def everything(h):
    """All rows of all tables, in order."""
    return {t: sorted(map(repr, h.read(t).collect())) for t in history.SCHEMAS} | {"markers": sorted(map(repr, h.markers().collect()))}


def test_names_of_files_without_a_suffix(spark):
    paths = {"in/scan": "", "a.b/scan": "", "in/x.pdf": ".pdf", "x.tar.gz": ".gz", ".hidden": "", "in/.hidden": "", "a/b.": "", "plain": ""}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.s for r in df.select("path", run.suffix(F.col("path")).alias("s")).collect()} == paths
    named = run.plan(items(spark, [0, 1]).drop("arrived_at"), DEFAULT, "b").select("path", "proposed_path").collect()
    assert {r.path: r.proposed_path.rpartition(".")[2] == "pdf" for r in named} == {"in/scan0": False, "in/scan1.pdf": True}
    assert not any("scan" in r.proposed_path.rpartition("/")[2] for r in named)


def test_all_files_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, name in enumerate(["a.pdf", "b.pdf", "c.pdf"]):
        (tmp_path / "in" / name).write_bytes(b"%PDF-1.4 " + (b"same" if k < 2 else b"other"))

    def take():
        stream = incremental.new_files(spark, str(tmp_path / "in")).select("path").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        assert stream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(90)
        return sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert take() == ["a.pdf", "b.pdf", "c.pdf"]
    (tmp_path / "in/old.pdf").write_bytes(b"%PDF-1.4 old")
    os.utime(tmp_path / "in/old.pdf", (1_000_000_000, 1_000_000_000))
    assert take() == ["a.pdf", "b.pdf", "c.pdf", "old.pdf"]


# -- batches -----------------------------------------------------------------------------------------------------------


def batches_of(spark, root):
    for k, numbers in enumerate(([0, 1, 2, 3], [4, 5, 10], [1, 6])):
        items(spark, numbers).coalesce(1).write.mode("append").parquet(f"{root}/items")
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(f"{root}/items")


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    """A stream of three batches, and the history of a run that nothing stopped."""
    at = tmp_path_factory.mktemp("clean")
    docs, h = batches_of(spark, at), History(spark, f"{at}/h")
    assert run_batches(docs, DEFAULT, h, "scan", f"{at}/checkpoint").awaitTermination(300)
    return docs, everything(h)


@pytest.mark.parametrize("stop", ["runs", "marker"])
def test_a_stopped_batch_leaves_no_trace(spark, tmp_path, monkeypatch, stop, clean):
    docs, want = clean
    h = History(spark, f"{tmp_path}/stopped")
    real, commit, fails = History.write, History.commit, [2]

    def write(self, table, query, batch, rows):
        out = real(self, table, query, batch, rows)
        if self is h and table == stop and batch == 1 and fails:
            fails.pop()
            raise RuntimeError("killed")
        return out

    def marker(self, query, batch, n):
        if self is h and stop == "marker" and batch == 1 and fails:
            fails.pop()
            raise RuntimeError("killed")
        commit(self, query, batch, n)

    monkeypatch.setattr(History, "write", write)
    monkeypatch.setattr(History, "commit", marker)
    with pytest.raises(Exception, match="killed"):
        run_batches(docs, DEFAULT, h, "scan", f"{tmp_path}/checkpoint1").awaitTermination(300)
    assert {r.batch for r in h.markers().collect()} == {0} and {r.batch for r in h.read("runs").select("batch").collect()} == {0}
    assert run_batches(docs, DEFAULT, h, "scan", f"{tmp_path}/checkpoint1").awaitTermination(300)
    assert everything(h) == want and len(everything(h)["markers"]) == 3


def test_a_batch_is_added_once(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    assert h.read("runs").count() == 0 and h.markers().count() == 0
    assert add_batch(h, items(spark, range(12)), DEFAULT, "scan", 0)
    before = everything(h)
    assert not add_batch(h, items(spark, [99]), DEFAULT, "scan", 0) and everything(h) == before
    status = {r.item_id: r.status for r in h.read("runs").collect()}
    assert status["i3"] == "quarantined" and status["i10"] in ("failed", "quarantined") and status["i1"] == "planned" and len(status) == 12
    events = audit.load_runs(h.read("runs").drop("query", "batch"), h.read("events")).collect()
    assert all([e.seq for e in r.events] == list(range(1, r.seq + 1)) for r in events)
    legal = {f"{a}>{b}" for a, b in audit.TRANSITIONS}
    assert {f"{r.data['from']}>{r.data['to']}" for r in h.read("events").collect()} <= legal
    # Refused documents were planned first; versions of one item in a batch are one run, the newest.
    assert add_batch(h, items(spark, [4, 4, 1]).union(items(spark, [1], version="v2").withColumn("arrived_at", F.lit(T0 + dt.timedelta(days=9)))), DEFAULT, "scan", 1, apply=True)
    new = {r.item_id: r for r in h.read("runs").where("batch = 1").collect()}
    assert sorted(new) == ["i1", "i4"] and new["i1"].content_hash.endswith("v2") and new["i4"].status == "quarantined" and new["i4"].seq == 3
    assert {r.batch_id: r.total for r in history.summaries(h).collect()} == {"scan-0": 12, "scan-1": 2}
    assert not add_batch(h, items(spark, []), DEFAULT, "scan", 1) and add_batch(h, items(spark, []), DEFAULT, "scan", 2)


# -- renames -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("etag", [True, False])
@pytest.mark.parametrize("step", ["before_link", "after_link", "after_unlink"])
def test_a_stopped_rename_goes_on(tmp_path, monkeypatch, step, etag):
    source, target = tmp_path / "a.pdf", tmp_path / "new/b.pdf"
    source.write_bytes(b"content")
    args = (str(source), str(target), journal.sha256(str(source)) if etag else None, journal.identity(str(source)))

    def stopped(*_):
        raise KeyboardInterrupt

    def after(f):
        def g(*a):
            f(*a)
            raise KeyboardInterrupt

        return g

    with monkeypatch.context() as m:
        if step == "before_link":
            m.setattr(journal.os, "link", stopped)
        elif step == "after_link":
            m.setattr(journal.os, "unlink", stopped)
        else:
            m.setattr(journal.os, "unlink", after(os.unlink))
        with pytest.raises(KeyboardInterrupt):
            journal.settle(*args)
    assert source.exists() or target.exists(), "the content is always somewhere"
    for _ in range(2):
        assert journal.settle(*args) == "renamed"
        assert target.read_bytes() == b"content" and not source.exists()


def test_what_stops_a_rename(tmp_path):
    for name in ("a", "b", "c", "taken"):
        (tmp_path / name).write_bytes(name.encode())
    at = lambda n: str(tmp_path / n)
    assert journal.settle(at("a"), at("taken")) == "collision" and (tmp_path / "taken").read_bytes() == b"taken"
    assert journal.settle(at("gone"), at("x")) == "missing" == journal.settle(at("gone"), at("taken")) == journal.settle(at("gone"), at("gone"))
    assert journal.settle(at("b"), at("x"), "0" * 64) == "etag_mismatch" == journal.settle(at("b"), at("x"), None, "1:2")
    assert journal.settle(at("c"), at("c")) == "unchanged" and (tmp_path / "c").exists()
    # An empty file that an older attempt has left is somebody's file, too.
    (tmp_path / "empty").write_bytes(b"")
    assert journal.settle(at("b"), at("empty")) == "collision"


def folder_of(tmp_path, name, numbers):
    root = tmp_path / name
    (root / "in").mkdir(parents=True)
    for n in numbers:
        (root / f"in/scan{n}.pdf").write_bytes(b"%PDF-1.4 " + str(n).encode())
    return root


def planned(spark, h, root):
    """A batch whose runs are planned, with the files' own hashes, and the listing of the files."""
    listing = local.discover(spark, str(root / "in")).select("path", "etag")
    n = F.regexp_extract("path", "scan(\\d+)", 1)
    text = F.concat(F.lit(INVOICE.split("{0}")[0]), n, F.lit(INVOICE.split("{0}")[1]))
    docs = listing.select(n.alias("item_id"), "path", F.col("etag").alias("content_hash"), F.lit("application/pdf").alias("mime"), text.alias("text"), F.lit(None).cast("string").alias("error"), F.lit(T0).alias("arrived_at"))
    add_batch(h, docs, DEFAULT, "scan", 0)
    target = F.concat(F.lit("done/"), "item_id", F.lit(".pdf"))
    return h.read("plans").drop("query", "batch").withColumn("proposed_path", target), listing


@pytest.mark.parametrize("stop", ["carry_out", "runs", "commit"])
def test_stopped_applies_go_on(spark, tmp_path, monkeypatch, stop):
    root = folder_of(tmp_path, "files", range(6))
    (root / "done").mkdir()
    (root / "done/2.pdf").write_bytes(b"was here")
    h = History(spark, str(tmp_path / "h"))
    plans, listing = planned(spark, h, root)
    listing = spark.createDataFrame(listing.collect(), listing.schema)
    (root / "in/scan4.pdf").write_bytes(b"changed since")
    (root / "in/scan5.pdf").unlink()

    def killed(f):
        def g(*a, **k):
            f(*a, **k)
            raise RuntimeError("killed")

        return g

    with monkeypatch.context() as m:
        if stop in ("intend", "carry_out"):
            m.setattr(journal, stop, killed(getattr(journal, stop)))
        elif stop == "commit":
            m.setattr(History, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        else:
            real = History.write
            m.setattr(History, "write", lambda self, table, *a: killed(real)(self, table, *a) if table == stop else real(self, table, *a))
        with pytest.raises(RuntimeError, match="killed"):
            apply.apply_plans(h, plans, listing, 0, str(root), compat=True)
    assert not h.has(apply.APPLY, 0) and {r.status for r in h.read("runs").collect()} == {"planned"}
    for _ in range(2):
        got = {r.path.rsplit("scan")[-1][0]: r.outcome for r in apply.apply_plans(h, plans, listing, 0, str(root), compat=True).collect()}
        assert got == {"0": "renamed", "1": "renamed", "2": "collision", "3": "renamed", "4": "etag_mismatch", "5": "missing"}
    assert {p.name for p in (root / "done").iterdir()} == {"0.pdf", "1.pdf", "2.pdf", "3.pdf"} and (root / "done/2.pdf").read_bytes() == b"was here"
    now = audit.latest(h.read("runs").drop("query", "batch")).collect()
    assert sorted((r.item_id, r.status, r.applied_path) for r in now) == [(str(n), "applied" if n in (0, 1, 3) else "planned", f"done/{n}.pdf" if n in (0, 1, 3) else None) for n in range(6)]
    events = h.read("events").where("query = 'apply'").collect()
    assert sorted(r.event_type for r in events) == ["apply_refused"] * 3 + ["state_transition"] * 3
    # Applied files are skipped by the next batch.
    assert stop != "commit" or add_batch(h, items(spark, [0]).withColumns({"item_id": F.lit("0"), "content_hash": F.lit([r.content_hash for r in now if r.item_id == "0"][0])}), DEFAULT, "scan", 1)
    assert stop != "commit" or [r.status for r in h.read("runs").where("query = 'scan' and batch = 1").collect()] == ["skipped"]


# -- the state machine -------------------------------------------------------------------------------------------------


def brute(rows, recorded):
    out, state = [], {}
    for run_id, seq, wanted, at in sorted(rows, key=lambda r: (r[3], r[1])):
        now = state.get(run_id, "pending")
        moved = (now, wanted) in audit.TRANSITIONS
        out.append((run_id, seq, now, wanted, wanted if moved else now, moved))
        state[run_id] = wanted if moved or recorded else now
    return sorted(out)


@pytest.mark.parametrize("recorded", [False, True])
def test_runs_as_a_stream(spark, tmp_path, recorded):
    rng = random.Random(4)
    rows = [(f"r{rng.randrange(12)}", n, rng.choice(audit.STATUSES), T0 + dt.timedelta(minutes=n, microseconds=rng.randrange(999))) for n in range(240)]
    kind, at = "run_id string, seq long, to_status string, occurred_at timestamp", str(tmp_path / "in")

    def take():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(at)
        assert runs.start(runs.machine(stream, "2 hours", stuck_ms=10**12, recorded=recorded), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(300)

    # Files of 40 requests, out of order by up to an hour and a half, over two starts of the stream.
    parts = [rows[k : k + 40] for k in range(0, 240, 40)]
    for k, (a, b) in enumerate(zip(parts[::2], parts[1::2])):
        for part in (b, a):
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(at)
        if k == 0:
            take()
    runs.clock(spark, T0 + dt.timedelta(hours=12)).coalesce(1).write.mode("append").parquet(at)
    take()
    out = runs.outcomes(spark, str(tmp_path / "out"))
    assert sorted((r.run_id, r.seq, r.from_status, r.to_status, r.status, r.moved) for r in out.collect()) == brute(rows, recorded)
    assert {r.kind for r in out.where("not moved").collect()} == {"refused"} and {r.kind for r in out.where("moved").collect()} == {"moved"}


def test_state_is_read_by_shard_and_not_by_run(spark, tmp_path):
    """Runs of a shard share a key of the state: its lists and its timer are read once a batch, however many runs there are."""
    kind, at, n = "run_id string, seq long, to_status string, occurred_at timestamp", str(tmp_path / "in"), 3000
    rows = [(f"r{k % n}", k, audit.STATUSES[1 + k % 5], T0 + dt.timedelta(seconds=k)) for k in range(2 * n)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(at)
    runs.clock(spark, T0 + dt.timedelta(days=2)).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(at)
    query = runs.start(runs.machine(stream, "3 hours", stuck_ms=10**12, shards=4), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(300)
    out = runs.outcomes(spark, str(tmp_path / "out"))
    assert sorted((r.run_id, r.seq, r.from_status, r.to_status, r.status, r.moved) for r in out.collect()) == brute(rows, False)
    timers = [op.customMetrics["numRegisteredTimers"] for p in query.recentProgress for op in p.stateOperators]
    assert 0 < max(timers) <= 5


def test_stuck_runs_are_told_once(spark, tmp_path):
    kind, at = "run_id string, seq long, to_status string, occurred_at timestamp", str(tmp_path / "in")
    day = lambda n: T0 + dt.timedelta(days=n)
    rows = [("slow", 1, "processing", day(0)), ("done", 2, "failed", day(0)), ("late", 3, "processing", day(1)), ("late", 4, "planned", day(9))]
    for part in (rows[:3], [("x", 5, "failed", day(5))], rows[3:], [("y", 6, "failed", day(30))]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(at)
    runs.clock(spark, day(60)).write.mode("append").parquet(at)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(at)
    assert runs.start(runs.machine(stream, "1 hour", stuck_ms=3 * 86_400_000), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(300)
    told = runs.outcomes(spark, str(tmp_path / "out")).where("kind = 'stuck'").collect()
    assert sorted((r.run_id, r.status) for r in told) == [("late", "planned"), ("late", "processing"), ("slow", "processing")]
    shutil.rmtree(tmp_path / "checkpoint")
