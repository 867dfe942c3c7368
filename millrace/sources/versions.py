"""Sets of tables that change together: versioned manifests over folders of Parquet.

A store is a folder with `data` and `versions`.  A commit writes new rows to a folder of its own and
then one manifest, a small JSON file with the next number, that names every folder of every table.
A reader takes the newest manifest, so it sees all tables of one version or of an older one, never
half of a commit.  Rows are taken away by keys: a folder of removed keys counts for all rows of older
versions.  The manifest also holds the last batch of each stream that has been committed, so a batch
that is repeated after a crash adds nothing.

Two writers can't make the same version: the file is renamed to its number, which fails if there is
one, and the loser begins again upon the new version.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.config import small

KEYS = ("client_id", "source_file")
#: Times that a commit begins again when others commit at the same time.
ATTEMPTS = 20


class Conflict(Exception):
    """Another writer has made this version."""


class Store:
    """A set of tables in `folder`; `keys` are the columns by which rows are replaced."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...] = KEYS):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """The numbers of the manifests, in order."""
        where = self._path(f"{self.folder}/versions")
        if not self._fs.exists(where):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, tables: {name: {schema, parts: [[version, path]]}}, removed: [[version, path]], batches: {stream: id}}."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "tables": {}, "removed": [], "batches": {}}
            version = known[-1]
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{version:012d}.json", wholetext=True).first()[0])

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table of a version; give the tables of one `manifest` to read them of the same version."""
        m = manifest or self.manifest()
        table = m["tables"][name]
        schema = StructType.fromDDL(table["schema"])
        if not table["parts"]:
            return self.spark.createDataFrame([], schema)
        grouped: dict[int, list[str]] = {}  # parts with no removal between them are one scan
        for version, path in table["parts"]:
            grouped.setdefault(max([r for r, _ in m["removed"] if r <= version], default=0), []).append(path)
        parts = [self.spark.read.schema(schema).parquet(*paths).withColumn("_version", F.lit(version)) for version, paths in grouped.items()]
        rows = reduce(DataFrame.unionByName, parts)
        least = min(version for version, _ in table["parts"])
        gone = [self.spark.read.parquet(path).select(*self.keys).withColumn("_removed", F.lit(version)) for version, path in m["removed"] if version > least]
        if gone:
            taken = small(reduce(DataFrame.unionByName, gone).groupBy(*self.keys).agg(F.max("_removed").alias("_removed")))
            same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in self.keys]
            rows = rows.alias("r").join(taken.alias("g"), [*same, F.col("r._version") < F.col("g._removed")], "left_anti")
        return rows.drop("_version")

    def commit(self, added: dict[str, DataFrame], removed: DataFrame | None = None, batch: tuple[str, int] | None = None, replace: bool = False) -> int:
        """Add rows to tables and take those of the keys of `removed` away from the older rows of all tables, at once.

        batch(stream, id): nothing is done where this id, or a later one, has been committed.  With
        `replace`, the given tables' older rows all go.  Returns the version that holds the commit.
        """
        if batch is not None and self._done(self.manifest(), batch):
            return self.manifest()["version"]
        token, written = uuid.uuid4().hex, {}
        for name, rows in added.items():
            written[name] = (f"{self.folder}/data/{name}-{token}", rows.schema)
            rows.write.parquet(written[name][0])
        gone = None
        if removed is not None:
            gone = f"{self.folder}/data/removed-{token}"
            removed.select(*self.keys).distinct().write.parquet(gone)
        for _ in range(ATTEMPTS):
            old = self.manifest()
            if batch is not None and self._done(old, batch):
                return old["version"]
            version = old["version"] + 1
            tables = {k: dict(v) for k, v in old["tables"].items()}
            for name, (path, schema) in written.items():
                kept = [] if replace or name not in tables else tables[name]["parts"]
                tables[name] = {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "parts": [*kept, [version, path]]}
            least = min((v for t in tables.values() for v, _ in t["parts"]), default=version)
            removals = [r for r in old["removed"] if r[0] > least] + ([[version, gone]] if gone else [])
            batches = old["batches"] | ({batch[0]: batch[1]} if batch else {})
            try:
                self._publish(version, {"version": version, "tables": tables, "removed": removals, "batches": batches})
            except Conflict:
                continue
            return version
        raise Conflict(f"{ATTEMPTS} attempts met other writers")

    def compact(self) -> int:
        """A version of the same rows in one folder a table, without removed keys."""
        m = self.manifest()
        return self.commit({name: self.read(name, m) for name in m["tables"]}, replace=True) if m["tables"] else m["version"]

    def vacuum(self, keep: int = 10) -> None:
        """Delete all but the newest manifests, and the folders that only the deleted ones name.

        Folders that no manifest has named stay: a commit may be on its way.
        """
        known = self.versions()
        names = lambda vs: {path for v in vs for m in [self.manifest(v)] for path in [*[p for t in m["tables"].values() for _, p in t["parts"]], *[p for _, p in m["removed"]]]}
        for path in names(known[:-keep]) - names(known[-keep:]):
            self._fs.delete(self._path(path), True)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/versions/{v:012d}.json"), False)

    @staticmethod
    def _done(manifest: dict, batch: tuple[str, int]) -> bool:
        return manifest["batches"].get(batch[0], -1) >= batch[1]

    def _publish(self, version: int, manifest: dict) -> None:
        jvm = self.spark._jvm
        draft = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # never overwrite
        try:
            context.rename(draft, self._path(f"{self.folder}/versions/{version:012d}.json"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(version) from e
            raise
