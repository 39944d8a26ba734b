"""The remote library as batch and stream: pages, delta tokens, restarts, errors and mutations, with a client of files."""

import hashlib
import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docengine.sources import remote

# Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Library:
    """A client whose library is a folder of JSON files, one a change: numbers are its tokens. Pages have two items."""

    def __init__(self, root):
        self.root = str(root)

    def changes(self, folder):
        return [json.loads(p.read_text()) for p in sorted(Path(self.root, folder).glob("*.json"))]

    def change(self, into, **item):
        at = Path(self.root, into)
        at.mkdir(exist_ok=True)
        (at / f"{len(list(at.iterdir())):06d}.json").write_text(json.dumps(item))

    def __call__(self, method, url, body=None):
        if method == "PATCH":
            if url.endswith("locked"):
                return 423, {}, b""
            with Path(self.root, "patches").open("a") as f:
                f.write(json.dumps([url, json.loads(body)]) + "\n")
            return 200, {}, b"{}"
        path, _, query = url.partition("?")
        folder, kind = path.split("/")[3:5]
        every = self.changes(folder)
        if kind == "children":
            items = list({x["id"]: x for x in every if "deleted" not in x}.values())
            at = int(query.partition("skip=")[2] or 0)
            more = {"@odata.nextLink": f"{path}?skip={at + 2}"} if at + 2 < len(items) else {}
            return 200, {}, json.dumps({"value": items[at : at + 2]} | more).encode()
        if query == "token=latest":
            return 200, {}, json.dumps({"value": [], "@odata.deltaLink": f"{path}?token={len(every)}"}).encode()
        token = query.partition("token=")[2]
        if token and Path(self.root, "forget").exists():
            return 410, {}, b"gone"
        at = int(query.partition("at=")[2] or token or 0)
        more = {"@odata.nextLink": f"{path}?at={at + 2}"} if at + 2 < len(every) else {"@odata.deltaLink": f"{path}?token={len(every)}"}
        return 200, {}, json.dumps({"value": every[at : at + 2]} | more).encode()


def item(n, name=None, etag=None):
    return {"id": f"i{n}", "name": name or f"f{n}.pdf", "eTag": etag or f"e{n}", "size": n, "parentReference": {"path": "/root:/in", "driveId": "d"}}


@pytest.fixture
def client(tmp_path):
    (tmp_path / "lib").mkdir()
    made = Library(tmp_path / "lib")
    for n in range(5):
        made.change("root", **item(n))
    made.change("root", id="sub", name="sub", folder={})
    made.change("root", **item(9, "notes.txt"))
    made.change("a", **item(7, "SCAN.TIFF"))
    return made


def test_batch(spark, client):
    spark.dataSource.register(remote.library(client, "library_batch"))
    df = spark.read.format("library_batch").option("drive", "d").option("folders", '["root", "a", "root"]').load()
    assert df.rdd.getNumPartitions() == 2
    got = {r.item_id: r for r in df.collect()}
    assert sorted(got) == ["i0", "i1", "i2", "i3", "i4", "i7"] and got["i7"].mime == "image/tiff" and got["i7"].folder == "a"
    assert got["i3"].path == "/root:/in/f3.pdf" and got["i3"].etag == "e3" and got["i3"].file_size == 3 and got["i3"].drive_id == "d" and got["i3"].content_hash == ""


def test_listing_fails_on_other_answers(spark):
    spark.dataSource.register(remote.library(lambda m, u: (500, {}, b"oops"), "library_down"))
    with pytest.raises(Exception, match="status 500"):
        spark.read.format("library_down").load().collect()


def test_stream_goes_on_from_its_tokens(spark, client, tmp_path):
    spark.dataSource.register(remote.library(client, "library_stream"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(fail=False):
        """One run over what there is; ``fail`` stops it after its rows were read and written, before they count."""

        def write(df, n):
            df.write.mode("append").parquet(out)
            if fail:
                raise RuntimeError("killed")

        stream = spark.readStream.format("library_stream").option("drive", "d").option("folders", '["root", "a"]').load()
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception as e:  # noqa: BLE001
            assert fail and "killed" in str(e)

    def seen():
        return [(r.item_id, r.etag, r.deleted) for r in spark.read.parquet(out).collect()]

    run()
    first = seen()
    assert sorted(first) == [(f"i{n}", f"e{n}", False) for n in (0, 1, 2, 3, 4, 7)]
    run()
    assert seen() == first, "nothing has changed"
    client.change("root", **item(1, etag="e1b"))
    client.change("root", id="i2", deleted={})
    client.change("a", **item(8, "new.png"))
    run(fail=True)
    client.change("a", **item(11))
    run()
    got = seen()
    assert set(got) - set(first) == {("i1", "e1b", False), ("i2", None, True), ("i8", "e8", False), ("i11", "e11", False)}
    assert got.count(("i8", "e8", False)) == 2, "the killed batch was repeated"
    # Only changes were read, but for the repeats.
    assert [got.count(x) for x in first] == [1] * len(first)
    Path(client.root, "forget").write_text("")
    client.change("root", **item(12))
    run()
    assert ("i12", "e12", False) in seen() and seen().count(("i0", "e0", False)) == 2, "a forgotten token starts its folder anew"


def test_tokens_are_asked_for_without_listing(client):
    calls = []

    def counted(method, url):
        calls.append(url)
        return client(method, url)

    reader = remote._Changes(counted, "d", ["root", "a"])
    assert reader.initialOffset() == {"root": "", "a": ""}
    end = reader.latestOffset()
    assert len(calls) == 2 and all(c.endswith("token=latest") for c in calls)
    assert [p.folder for p in reader.partitions({"root": end["root"]}, end)] == ["a"], "a folder that is new is read whole"


def test_no_error_page_becomes_a_document(spark):
    def fake(method, url):
        return {"ok": (200, {}, b"body"), "gone": (404, {}, b"<html>not found"), "down": (500, {}, b"oops")}[url.partition("?")[0]]

    items = spark.createDataFrame([("ok",), ("gone",), ("down",)], "item_id string")
    got = {r.item_id: (r.content and bytes(r.content), r.content_hash, r.error) for r in remote.download(items, fake, lambda i: i).collect()}
    assert got == {"ok": (b"body", hashlib.sha256(b"body").hexdigest(), None), "gone": (None, None, "status 404"), "down": (None, None, "status 500")}

    def tagged(method, url):
        return (200, {}, b'{"eTag": "e"}') if url.startswith("ok") else fake(method, url)

    assert {tuple(r) for r in remote.etags(items, tagged, lambda i: i).collect()} == {("ok", "e", None), ("gone", None, None), ("down", None, "status 500")}


def test_patches(spark, client, tmp_path):
    rows = [("1", "in/new.pdf", "patch_name"), ("2", "to/there.pdf", "patch_name_and_parent"), ("3", "x", "etag_mismatch"), ("locked", "in/y.pdf", "patch_name")]
    df = spark.createDataFrame(rows, "item_id string, proposed_path string, decision string")
    outcomes = str(tmp_path / "outcomes")
    for _ in range(2):
        got = {tuple(r) for r in remote.patch(df, client, "d", lambda i: f"items/{i}", outcomes).collect()}
        assert got == {("1", 200, "applied"), ("2", 200, "applied"), ("locked", 423, "status 423")}
    sent = sorted(map(json.loads, Path(client.root, "patches").read_text().splitlines()))
    assert sent == [["items/1", {"name": "new.pdf"}], ["items/2", {"name": "there.pdf", "parentReference": {"path": "/drives/d/root:/to"}}]], "each once"
    assert df.select(remote.patch_body("d").alias("b")).where(F.col("b").contains("there")).count() == 1
