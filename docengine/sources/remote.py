"""A document library behind an HTTP API: a Python data source for batches and streams, downloads and mutations.

The client is injected: a callable (method, url[, body]) -> (status, headers, body) that can be pickled. No network code lives here.

``library(client)`` makes a data source. As a batch, a folder is a partition and its pages are followed inside the task:

    spark.dataSource.register(remote.library(client))
    spark.read.format("library").option("drive", "d").option("folders", '["root", "a"]').load()

As a stream, an offset holds a delta token for each folder. The newest tokens are asked for without listing anything, and a task follows the
changes of its folder from the token that the last batch ended at. What changes between the two calls comes in this batch and again in the
next one, and a batch that is repeated after a failure sees later changes too: a row may come twice, none is lost, and (item_id,
etag) tells repeats. A token that the library has forgotten (status 410) starts its folder anew.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .local import SUFFIX_TYPES, UNKNOWN_TYPE

Client = Callable[..., tuple[int, dict[str, str], bytes]]
RETRIES = 3
SCHEMA = "item_id string, path string, etag string, mime string, file_size long, drive_id string, content_hash string"
CHANGES = f"{SCHEMA}, folder string, deleted boolean"
#: What a listing asks for, and where pages and changes go on.
CHILDREN, DELTA = "drives/{drive}/items/{folder}/children?$select=id,name,file,size,eTag,parentReference,webUrl", "drives/{drive}/items/{folder}/delta"
NEXT, LAST = "@odata.nextLink", "@odata.deltaLink"


def request(client: Client, method: str, url: str, sleep: Callable[[float], Any] = time.sleep, body: bytes | None = None) -> tuple[int, dict[str, str], bytes]:
    """One call, tried again up to RETRIES times while the answer is 429, after Retry-After or 2, 4, 8 seconds."""
    for n in range(RETRIES + 1):
        status, headers, answer = client(method, url) if body is None else client(method, url, body)
        if status != 429 or n == RETRIES:
            return status, headers, answer
        sleep(float(headers.get("Retry-After") or 2 ** (n + 1)))
    raise AssertionError


def _page(client: Client, url: str) -> dict[str, Any]:
    status, _, body = request(client, "GET", url)
    if status != 200:
        raise RuntimeError(f"{url}: status {status}")
    return json.loads(body)


def _row(x: dict[str, Any]) -> tuple | None:
    """A supported file as a row; None for folders and other files."""
    name = x.get("name", "")
    suffix = "." + name.rpartition(".")[2].lower() if "." in name else ""
    if "folder" in x or suffix not in SUFFIX_TYPES:
        return None
    parent = x.get("parentReference", {})
    path = x.get("path") or (f"{parent['path']}/{name}" if parent.get("path") else name)
    mime = x.get("file", {}).get("mimeType") or SUFFIX_TYPES.get(suffix, UNKNOWN_TYPE)
    return x["id"], path, x.get("eTag"), mime, int(x.get("size", 0)), x.get("driveId") or parent.get("driveId"), ""


def list_folder(client: Client, url: str) -> Iterator[tuple]:
    """Supported files of a folder, page by page; folders are left out. Content hashes aren't known before download."""
    while url:
        page = _page(client, url)
        yield from filter(None, map(_row, page.get("value", [])))
        url = page.get(NEXT, "")


def list_changes(client: Client, url: str, whole: str) -> Iterator[tuple]:
    """Rows of the changes from ``url`` on, and of deleted items; from ``whole`` if the library has forgotten the token."""
    while url:
        status, _, body = request(client, "GET", url)
        if status == 410 and url != whole:
            url = whole
            continue
        if status != 200:
            raise RuntimeError(f"{url}: status {status}")
        page = json.loads(body)
        for x in page.get("value", []):
            if "deleted" in x:
                yield (x["id"], None, None, None, None, None, "", True)
            elif row := _row(x):
                yield (*row, False)
        url = page.get(NEXT, "")


class Folder(InputPartition):
    def __init__(self, folder: str, url: str) -> None:
        self.folder, self.url = folder, url


class _Reader(DataSourceReader):
    def __init__(self, client: Client, drive: str, folders: list[str]) -> None:
        self.client, self.drive, self.folders = client, drive, folders

    def partitions(self) -> list[Folder]:
        return [Folder(f, CHILDREN.format(drive=self.drive, folder=f)) for f in self.folders]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for row in list_folder(self.client, partition.url):
            yield (*row, partition.folder, False)


class _Changes(DataSourceStreamReader):
    """Offsets are {folder: delta link}; an empty link stands for everything."""

    def __init__(self, client: Client, drive: str, folders: list[str]) -> None:
        self.client, self.drive, self.folders = client, drive, folders

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.folders, "")

    def latestOffset(self) -> dict:  # noqa: N802
        """One call a folder; nothing is listed on the driver."""
        return {f: _page(self.client, f"{self._whole(f)}?token=latest")[LAST] for f in self.folders}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        """Folders whose token has changed, and those that are new since the last run."""
        return [Folder(f, start.get(f, "")) for f in end if start.get(f, "") != end[f]]

    def read(self, partition: Folder) -> Iterator[tuple]:
        whole = self._whole(partition.folder)
        for *row, deleted in list_changes(self.client, partition.url or whole, whole):
            yield (*row, partition.folder, deleted)

    def _whole(self, folder: str) -> str:
        return DELTA.format(drive=self.drive, folder=folder)


def library(client: Client, name: str = "library") -> type[DataSource]:
    """A data source to register; its options are ``drive`` and ``folders``, a JSON list (root by default)."""

    class Library(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return CHANGES

        def _of(self, kind: type) -> Any:
            folders = json.loads(self.options.get("folders", '["root"]')) or ["root"]
            return kind(client, self.options.get("drive", ""), list(dict.fromkeys(folders)))

        def reader(self, schema: Any) -> DataSourceReader:  # noqa: ARG002
            return self._of(_Reader)

        def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: ARG002, N802
            return self._of(_Changes)

    return Library


def discover(spark: SparkSession, client: Client, folders: list[str]) -> DataFrame:
    """Supported files of all folders, given by their URLs; a folder is a partition, so folders are listed in parallel."""
    rows = spark.createDataFrame([(f,) for f in folders if f], "folder string").repartition(max(len(folders), 1))

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for folder in batch["folder"]:
                yield pd.DataFrame(list(list_folder(client, folder)), columns=names)

    return rows.mapInPandas(run, SCHEMA)


def download(items: DataFrame, client: Client, url_of: Callable[[str], str]) -> DataFrame:
    """(item_id, content, content_hash, error) of items; the hash is taken after the download. An answer other than 200 gives a row
    with an error and without content, so that no error page becomes a document."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            for item in batch["item_id"]:
                status, _, body = request(client, "GET", url_of(item))
                yield pd.DataFrame({"item_id": [item], "content": [body if status == 200 else None], "error": [None if status == 200 else f"status {status}"]})

    got = items.select("item_id").mapInPandas(run, "item_id string, content binary, error string")
    return got.select("item_id", "content", F.sha2("content", 256).alias("content_hash"), "error")


def etags(items: DataFrame, client: Client, url_of: Callable[[str], str]) -> DataFrame:
    """(item_id, current_etag, error) of items as they are now, without their content; the etag of one that is gone (404) is null."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            for item in batch["item_id"]:
                status, _, body = request(client, "GET", f"{url_of(item)}?$select=eTag")
                etag = json.loads(body).get("eTag") if status == 200 else None
                yield pd.DataFrame({"item_id": [item], "current_etag": [etag], "error": [None if status in (200, 404) else f"status {status}"]})

    return items.select("item_id").mapInPandas(run, "item_id string, current_etag string, error string")


def decide(op: Column, etag: Column, current: Column, dry_run: Column) -> Column:
    """metadata updates: only as a dry run; a changed etag stops the rest; a dry run stops after that guard."""
    return (
        F.when((op == "metadata_update") & dry_run, "dry_run")
        .when(op == "metadata_update", "not_implemented")
        .when(current.isNull(), "missing")
        .when(etag.isNotNull() & (etag != current), "etag_mismatch")
        .when(dry_run, "dry_run")
        .when(op == "move", "patch_name_and_parent")
        .otherwise("patch_name")
    )


def patch_body(drive: str) -> Column:
    """The JSON of a PATCH of (proposed_path, decision): the new name, and for moves the new folder."""
    name, folder = F.substring_index("proposed_path", "/", -1), F.regexp_extract("proposed_path", "^(.*)/[^/]*$", 1)
    parent = F.when(F.col("decision") == "patch_name_and_parent", F.struct(F.concat(F.lit(f"/drives/{drive}/root:/"), folder).alias("path")))
    return F.to_json(F.struct(name.alias("name"), parent.alias("parentReference")))


def patch(decisions: DataFrame, client: Client, drive: str, url_of: Callable[[str], str], outcomes: str) -> DataFrame:
    """Carry out the PATCH decisions of an approved plan (item_id, proposed_path, decision). What became of each is written to the folder
    ``outcomes`` and read back; items that have a row there aren't sent again, and a PATCH that is repeated sets the same name."""
    spark, kind = decisions.sparkSession, "item_id string, status int, outcome string"
    wanted = decisions.where(F.col("decision").startswith("patch")).select("item_id", patch_body(drive).alias("body"))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            status = [request(client, "PATCH", url_of(i), body=b.encode())[0] for i, b in zip(batch["item_id"], batch["body"], strict=True)]
            yield batch[["item_id"]].assign(status=status, outcome=["applied" if 200 <= s < 300 else f"status {s}" for s in status])

    spark.createDataFrame([], kind).write.mode("append").parquet(outcomes)
    done = spark.read.schema(kind).parquet(outcomes).where("outcome = 'applied'").select("item_id")
    wanted.join(done, "item_id", "left_anti").mapInPandas(run, kind).write.mode("append").parquet(outcomes)
    return spark.read.schema(kind).parquet(outcomes)
