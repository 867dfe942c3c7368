"""Remote folders as tables: listings of many pages, and the files' contents.

`get(client_id, url)` fetches a URL for a tenant, with whatever authentication that takes, and runs
in tasks.  Each folder is a partition, whose pages follow one another; contents are fetched by as
many tasks as there are partitions of the listing's files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The fields of a page and of its items, and the ending of the files that count.
ITEMS, NEXT, FILE, NAME, ID, ENDING = "value", "@odata.nextLink", "file", "name", "id", ".xlsx"
SCHEMA = "client_id string, drive_id string, folder_id string, item_id string, name string, error string"

Get = Callable[[str, str], bytes]


class _Folder(InputPartition):
    def __init__(self, client_id: str, drive_id: str, folder_id: str):
        self.key = (client_id, drive_id, folder_id)


class _Reader(DataSourceReader):
    def __init__(self, folders: list, base: str, get: Get):
        self.folders, self.base, self.get = folders, base, get

    def partitions(self) -> list[InputPartition]:
        return [_Folder(*f) for f in self.folders]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        client, drive, folder = partition.key
        url, seen = f"{self.base}/drives/{drive}/items/{folder}/children", set()
        try:
            while url:
                if url in seen:
                    raise ValueError(f"the listing returns to {url}")
                seen.add(url)
                page = json.loads(self.get(client, url))
                for item in page.get(ITEMS, []):
                    if FILE in item and item.get(NAME, "").endswith(ENDING):
                        yield (*partition.key, item[ID], item[NAME], None)
                url = page.get(NEXT)
        except Exception as e:  # noqa: BLE001  one folder's failure is its own row
            yield (*partition.key, None, None, f"{type(e).__name__}: {e}")


def listed_files(spark: SparkSession, folders: list[tuple[str, str, str]], base: str, get: Get) -> DataFrame:
    """(client_id, drive_id, folder_id, item_id, name, error): the workbooks straight in folders of (client_id, drive_id, folder_id).

    All pages are followed.  A folder whose listing fails has a row with the error besides the files
    found before it: mirror a tenant's folder only if it has none.
    """

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "folder_listing"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(json.loads(self.options["folders"]), base, get)

    spark.dataSource.register(Listing)
    return spark.read.format("folder_listing").option("folders", json.dumps(folders)).load() if folders else spark.createDataFrame([], SCHEMA)


def complete(listed: DataFrame) -> DataFrame:
    """(client_id, source_file) of the tenants all of whose folders could be listed."""
    failed = listed.where(F.col("error").isNotNull()).select("client_id").distinct()
    return listed.where(F.col("name").isNotNull()).join(failed, "client_id", "left_anti").select("client_id", F.col("name").alias("source_file")).distinct()


def fetched(listed: DataFrame, base: str, get: Get, tasks: int | None = None) -> DataFrame:
    """(client_id, path, content) of the listed files, as `workbook` readers take them; a failed download fails its task, which Spark repeats."""

    def download(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for client, drive, item, name in zip(*[b.column(c).to_pylist() for c in ("client_id", "drive_id", "item_id", "name")], strict=True):
                content = get(client, f"{base}/drives/{drive}/items/{item}/content")
                yield pa.RecordBatch.from_arrays([pa.array([client]), pa.array([name]), pa.array([content], pa.binary())], ["client_id", "path", "content"])

    files = listed.where(F.col("item_id").isNotNull()).select("client_id", "drive_id", "item_id", "name")
    spread = files.repartition(tasks, "item_id") if tasks else files.repartition("item_id")
    return spread.mapInArrow(download, "client_id string, path string, content binary")
