"""Tables that change, in a shared folder: rows are written first, then one manifest makes them count.

A manifest is a small file that names the version's tables, their schemas and, for each
bucket of their keys, the folders with its rows. Readers follow the newest manifest and
see all tables of a version or none. Writers add folders that nobody reads yet and then
create the next manifest, which fails if it exists: of two writers that began with the
same version one gets `Conflict` and has changed nothing. After a crash there are folders
without a manifest, which `vacuum` removes. A load is named in the manifest that commits
it, so a repeated load is recognised.

Rows of a key are replaced bucket by bucket: buckets that a change does not touch keep
their folders. A bucket may be of any size, its rows are spread over files.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyline.functions.joins import null_safe_join

BUCKETS = 64
_MANIFESTS = "_versions"
_BUCKET = "stored_bucket"


class Conflict(RuntimeError):
    """Another writer has committed the version meanwhile; nothing of this change counts."""


class VersionedTables:
    """Named tables under one folder, read as of the newest version when this object was made."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.version, self.manifest = 0, {"loads": [], "tables": {}}
        names = [n for n in self._names(_MANIFESTS) if n.endswith(".json")]
        if names:
            newest = max(names)
            self.version, self.manifest = int(newest[: -len(".json")]), self._manifest(newest)

    def has(self, load: str) -> bool:
        return load in self.manifest["loads"]

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        """The table's rows; `schema` is what a table that was never written has."""
        table = self.manifest["tables"].get(name)
        if table is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self._rows(StructType.fromJson(table["schema"]), table["parts"])

    def change(self, load: str) -> Change:
        return Change(self, load)

    def vacuum(self, versions: int = 2, older_than_hours: float = 24.0) -> int:
        """Delete folders that the last `versions` manifests don't name and no running writer can still commit.

        Answers how many went. Manifests beyond those go too.
        """
        names = sorted(n for n in self._names(_MANIFESTS) if n.endswith(".json"))
        kept = names[-versions:]
        named = {
            part
            for manifest in map(self._manifest, kept)
            for table in manifest["tables"].values()
            for parts in table["parts"].values()
            for part in parts
        }
        before = (time.time() - older_than_hours * 3600) * 1000
        old = [s.getPath() for s in self._list("") if s.getModificationTime() <= before]
        gone = [p for p in old if p.getName().startswith("part-") and p.getName() not in named]
        for path in [*gone, *[self._path(f"{_MANIFESTS}/{n}") for n in names[:-versions]]]:
            self._fs().delete(path, True)
        return len(gone)

    # -- files ---------------------------------------------------------------

    def _rows(self, schema: StructType, parts: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.folder}/{part}/{_BUCKET}={bucket}" for bucket, of in parts.items() for part in of]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list:
        path = self._path(name)
        return list(self._fs().listStatus(path)) if self._fs().exists(path) else []

    def _names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._list(name)]

    def _manifest(self, name: str) -> dict:
        stream = self._fs().open(self._path(f"{_MANIFESTS}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Write the manifest beside its place, then rename it there unless something is there."""
        jvm = self.spark._jvm
        aside = self._path(f"{_MANIFESTS}/{uuid.uuid4().hex}.tmp")
        place = self._path(f"{_MANIFESTS}/{self.version + 1:012d}.json")
        stream = self._fs().create(aside)
        stream.write(bytearray(json.dumps(manifest), "utf-8"))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, place, no_overwrite)
        except Py4JJavaError as error:
            self._fs().delete(aside, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {self.version + 1} of {self.folder} exists") from error
            raise
        self.version, self.manifest = self.version + 1, manifest


class Change:
    """One load's changes to the tables of a version. Nothing counts before `commit`."""

    def __init__(self, tables: VersionedTables, load: str):
        if tables.has(load):
            raise ValueError(f"load {load!r} is committed")
        self.tables, self.load = tables, load
        self.manifest = json.loads(json.dumps(tables.manifest))

    def _bucketed(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(self.tables.buckets)).cast("int"))

    def _write(self, bucketed: DataFrame) -> tuple[str, list[int]]:
        part = f"part-{uuid.uuid4().hex}"
        # few files per bucket, and even ones: a bucket of a hot key is split
        bucketed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.tables.folder}/{part}")
        names = self.tables._names(part)
        return part, sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}="))

    def _entry(self, name: str, rows: DataFrame, keys: list[str]) -> dict:
        entry = {"schema": rows.schema.jsonValue(), "keys": keys, "buckets": self.tables.buckets, "parts": {}}
        entry = self.manifest["tables"].setdefault(name, entry)
        if entry["keys"] != keys or entry["buckets"] != self.tables.buckets:
            raise ValueError(f"table {name!r} is stored by {entry['keys']} in {entry['buckets']} buckets")
        if StructType.fromJson(entry["schema"]).names != rows.columns:
            raise ValueError(f"table {name!r} has other columns")
        return entry

    def append(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Add rows to the table. Answers the added rows, read from where they are stored."""
        entry = self._entry(name, rows, keys)
        part, buckets = self._write(self._bucketed(rows, keys))
        for b in buckets:
            entry["parts"].setdefault(str(b), []).append(part)
        return self._stored(part, buckets, rows)

    def replace(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """All rows of the keys that occur in `rows` go, `rows` come. Answers them, read from where they are stored.

        Only buckets with such keys are read and written.
        """
        entry = self._entry(name, rows, keys)
        part, buckets = self._write(self._bucketed(rows, keys))
        come = self._stored(part, buckets, rows)
        known = {str(b): entry["parts"][str(b)] for b in buckets if str(b) in entry["parts"]}
        if known:
            old = self.tables._rows(StructType.fromJson(entry["schema"]), known)
            new = come.select(*keys).distinct()
            rest, left = self._write(self._bucketed(null_safe_join(old, new, keys, "left_anti"), keys))
        else:
            rest, left = None, []
        for b in buckets:
            entry["parts"][str(b)] = [part] + ([rest] if b in left else [])
        return come

    def _stored(self, part: str, buckets: list[int], rows: DataFrame) -> DataFrame:
        return self.tables._rows(rows.schema, {str(b): [part] for b in buckets})

    def commit(self) -> None:
        """All changes become the next version, or `Conflict` is raised and none does."""
        self.manifest["loads"].append(self.load)
        self.tables._commit(self.manifest)
