"""Files, streams and the entry point."""

import subprocess
import sys

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from docengine.plans import audit, run
from docengine.sources import local, manifest, remote
from docengine.streaming import incremental


def test_discover(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"%PDF-1.4 fake")
    (tmp_path / "a/y.bin").write_bytes(b"nothing")
    found = local.discover(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.mime) for r in found] == [("x.pdf", "application/pdf")]


def test_types_by_first_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = {"scan": b"%PDF-1.4 a", "invoice.pdf.bak": b"%PDF-1.4 b", "photo.data": b"\xff\xd8\xff\xe0", "plain.pdf": b"no header"}
    for name, content in (want | {"notes.txt": b"nothing", "bare": b"nothing"}).items():
        (tmp_path / "in" / name).write_bytes(content)
    folder = str(tmp_path / "in")
    assert {r.path.rsplit("/", 1)[-1] for r in local.discover(spark, folder).collect()} == set(want)
    out = str(tmp_path / "out")
    stream = incremental.new_files(spark, folder).select("path").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert stream.awaitTermination(60)
    assert {r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(out).collect()} == set(want)


def test_renames_never_overwrite(spark, tmp_path):
    names = {"a.pdf": b"one", "b.pdf": b"two", "c.pdf": b"three", "d.pdf": b"four", "taken.pdf": b"here before"}
    for name, content in names.items():
        (tmp_path / name).write_bytes(content)
    hashed = {n: hashlib.sha256(c).hexdigest() for n, c in names.items()}
    at = lambda n: str(tmp_path / n)
    listing = spark.createDataFrame([(at(n), h) for n, h in hashed.items()], "path string, etag string")
    plans = [("a.pdf", "new/x.pdf"), ("b.pdf", "new/x.pdf"), ("c.pdf", "taken.pdf"), ("d.pdf", "new/y.pdf"), ("gone.pdf", "new/z.pdf")]
    df = spark.createDataFrame([(at(p), at(t), "rename", hashed.get(p), False) for p, t in plans], "path string, proposed_path string, op string, etag string, dry_run boolean")
    decided = local.decide(df, listing)
    assert {r.path.rsplit("/", 1)[-1]: r.decision for r in decided.collect()} == {"a.pdf": "rename", "b.pdf": "collision", "c.pdf": "collision", "d.pdf": "rename", "gone.pdf": "missing"}
    # What changed since the listing is found at the moment of renaming.
    (tmp_path / "d.pdf").write_bytes(b"changed")
    forced = decided.withColumn("decision", F.lit("rename"))
    outcomes = str(tmp_path / "outcomes")
    got = {(r.path.rsplit("/", 1)[-1], r.outcome) for r in local.rename_approved(forced, outcomes).collect()}
    assert got >= {("c.pdf", "collision"), ("d.pdf", "etag_mismatch"), ("gone.pdf", "missing")} and sorted(o for p, o in got if p in ("a.pdf", "b.pdf")) == ["collision", "renamed"]
    assert (tmp_path / "taken.pdf").read_bytes() == b"here before" and (tmp_path / "new/x.pdf").read_bytes() in (b"one", b"two")
    again = {r.outcome for r in local.rename_approved(forced.where(F.col("path") == at("a.pdf")), str(tmp_path / "again")).collect()}
    assert again <= {"renamed", "collision"} and len(list((tmp_path / "new").iterdir())) == 1


def test_copies_of_a_batch_get_names_of_their_own(spark):
    rows = spark.createDataFrame([(i, "in/x.pdf", "same" * 4) for i in range(5)] + [(9, "in/x.pdf", "other" * 4), (10, "in/y.pdf", "z" * 8)], "item_id long, proposed_path string, content_hash string")
    got = {r.item_id: r.proposed_path for r in run.batch_collisions(rows).collect()}
    assert got[0] == "in/x.pdf" and got[10] == "in/y.pdf" and got[9] == "in/x_otheroth.pdf" and len(set(got.values())) == 7


def test_transitions_and_times(spark):
    now = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("r", 1, "pending", "processing", now), ("r", 2, "applied", "failed", now), ("r", 3, None, "failed", now)], "run_id string, seq long, from_status string, to_status string, occurred_at timestamp")
    got = {r.seq: r for r in audit.transitions(rows).collect()}
    assert got[1].moved and got[1].status == "processing" and got[1].event.data == {"from": "pending", "to": "processing"}
    assert not got[2].moved and got[2].status == "applied" and got[2].event is None and not got[3].moved
    texts = spark.createDataFrame([("2024-01-15T10:00:00",), ("2024-01-15",), ("soon",), (None,), ("5",)], "t string")
    assert [r[0] for r in texts.select(audit.timestamp(F.col("t"))).collect()] == [dt.datetime(2024, 1, 15, 10), dt.datetime(2024, 1, 15), None, None, None]
    assert all(r[0] for r in texts.select(audit.timestamp(F.col("t"), F.current_timestamp())).collect())


def test_remote_listing_and_download(spark):
    pages = {
        "root": {"value": [{"id": "1", "name": "a.PDF", "eTag": "e1", "size": 5, "driveId": "d"}, {"id": "2", "name": "sub", "folder": {}}, {"id": "3", "name": "n.txt"}], "@odata.nextLink": "more"},
        "more": {"value": [{"id": "4", "name": "b.png", "file": {"mimeType": "image/png"}}]},
        "other": {"value": [{"id": "5", "name": "c.tif"}]},
    }

    def fake(method, url):
        return (200, {}, json.dumps(pages[url]).encode()) if url in pages else (200, {}, b"body of " + url.encode())

    found = remote.discover(spark, fake, ["root", "other"])
    assert sorted((r.item_id, r.mime, r.etag) for r in found.collect()) == [("1", "application/pdf", "e1"), ("4", "image/png", None), ("5", "image/tiff", None)]
    got = {r.item_id: (bytes(r.content), r.content_hash) for r in remote.download(found, fake, lambda i: f"file/{i}").collect()}
    assert got["4"] == (b"body of file/4", hashlib.sha256(b"body of file/4").hexdigest()) and len(got) == 3


def test_retries():
    answers, slept = [(429, {"Retry-After": "7"}, b""), (429, {}, b""), (200, {}, b"ok")], []
    assert remote.request(lambda m, u: answers.pop(0), "GET", "x", slept.append)[2] == b"ok" and slept == [7.0, 4]
    slept.clear()
    assert remote.request(lambda m, u: (429, {}, b""), "GET", "x", slept.append)[0] == 429 and slept == [2, 4, 8]


def test_manifests_and_plans(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"path": "a.pdf", "expected": {"currency": "EUR"}}\n\n{"path": "b.pdf", "expected": {}}\n')
    rows = {r.path: r.expected for r in manifest.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert rows == {"a.pdf": {"currency": "EUR"}, "b.pdf": {}}
    runs = spark.createDataFrame([("r1", "b1", "planned"), ("r2", "b2", "planned"), ("r3", "b1", "failed")], "run_id string, batch_id string, status string")
    manifest.write_plan(runs, "b1", str(tmp_path / "plan"))
    assert {r.run_id for r in manifest.read_plan(spark, str(tmp_path / "plan"), "run_id string, batch_id string, status string").collect()} == {"r1", "r3"}
    assert [x["run_id"] for x in json.loads(manifest.plan_array(runs, "b1").first().plan)] == ["r1", "r3"]


def test_sessions(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")], "k long, t string").selectExpr("k", "cast(t as timestamp) t")
    assert sorted((r.k, r.n) for r in incremental.sessions(rows, "t", "10 minutes", "k").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_entry_without_llm():
    code = "import sys\nsys.modules['docengine.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
