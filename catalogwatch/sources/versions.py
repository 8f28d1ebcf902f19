"""Tables in immutable versions: a commit record names the folders a version consists of, and one rename decides who wins.

    <root>/data/<write>/bucket_of_key=…  rows of one write, by hash of the key
    <root>/commits/<number>.json      the record of a version: for each bucket the folder that holds it now

A writer puts new folders beside the old ones and then its record under the next number. Until the record stands there, the
table is the old one; a writer that finds the number taken has changed nothing. A reader takes one record and sees that version,
whatever is written meanwhile.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.operators.catalogue import keep_last

DEFAULT_BUCKETS = 64
RETRIES = 10
BUCKET = "bucket_of_key"


class VersionTaken(RuntimeError):
    """Another writer has committed this version first."""


class Folder:
    """What commit records need of a file system: list, read, and create a file that must not be there yet."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        parts = urlparse(self.uri)
        self.local = unquote(parts.path) if parts.scheme in ("", "file") else None

    def _hadoop(self, name: str = ""):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)
        return jvm, path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if self.local is not None:
            return sorted(os.listdir(self.local)) if os.path.isdir(self.local) else []
        _, path, fs = self._hadoop()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        if self.local is not None:
            with open(f"{self.local}/{name}", encoding="utf-8") as f:
                return f.read()
        return self.spark.sparkContext.wholeTextFiles(f"{self.uri}/{name}").first()[1]

    def create(self, name: str, text: str) -> None:
        """The whole file under a new name, or VersionTaken: written aside, then moved by one step that never replaces."""
        part = f".{name}.{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{part}", "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{self.local}/{part}", f"{self.local}/{name}")
            except FileExistsError as err:
                raise VersionTaken(name) from err
            finally:
                os.unlink(f"{self.local}/{part}")
            return
        jvm, source, fs = self._hadoop(part)
        out = fs.create(source, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}"), options)
        except Exception as err:
            fs.delete(source, False)
            if "FileAlreadyExists" in str(err) or "rename destination" in str(err):
                raise VersionTaken(name) from err
            raise

    def remove(self, name: str) -> None:
        _, path, fs = self._hadoop(name)
        fs.delete(path, True)


def record_name(version: int) -> str:
    return f"{version:020d}.json"


class Records:
    """Numbered records of one folder, of which the highest counts."""

    def __init__(self, spark: SparkSession, uri: str):
        self.folder = Folder(spark, uri)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names() if n.endswith(".json") and not n.startswith(".")]

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int) -> dict:
        return json.loads(self.folder.read(record_name(version)))

    def commit(self, version: int, record: dict) -> None:
        self.folder.create(record_name(version), json.dumps({"version": version, **record}, ensure_ascii=False))


class VersionedTable:
    """A table of the newest row of each key. Null keys are a key of their own.

    ``buckets`` and ``key`` are fixed by the first version; later ones take them from the record. A record has one entry for each
    bucket, whatever the table's size.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "url", buckets: int = DEFAULT_BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.records = Records(spark, f"{self.root}/commits")

    def _record(self, version: int | None) -> dict | None:
        version = self.records.latest() if version is None else version
        return None if version is None else self.records.read(version)

    def _rows(self, record: dict, buckets=None) -> DataFrame:
        schema = T.StructType.fromJson(record["schema"])
        paths = [f"{self.root}/data/{p}" for b, p in record["buckets"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _bucket(self, record: dict | None) -> Column:
        n = record["bucket_count"] if record else self.buckets
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(n)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one by default. The version is fixed when this is called."""
        record = self._record(version)
        if record is None:
            raise FileNotFoundError(f"no version of a table in {self.root}")
        return self._rows(record)

    def upsert(self, new: DataFrame, order, retries: int = RETRIES, step: Callable[[str], None] = lambda name: None) -> int:
        """Puts rows in; of each key the newest by ``order`` stays. Gives the number of the version made.

        Only buckets that the new rows fall into are read and written. If another writer commits first, the work is done again on
        top of theirs, at most ``retries`` times. New columns are added to the table; columns the new rows lack are null in them.
        An empty set of rows makes no version unless there is none. ``step`` is called between the steps (for tests of failures).
        """
        if BUCKET in new.columns:
            raise ValueError(f"the column name {BUCKET} is taken by the table itself")
        for attempt in range(retries + 1):
            step("begin")
            base = self.records.latest()
            record = self.records.read(base) if base is not None else None
            bucketed = keep_last(new, self.key, order).withColumn(BUCKET, self._bucket(record))
            touched = {r[0] for r in bucketed.select(BUCKET).distinct().collect()}  # at most the number of buckets
            if not touched and record is not None:
                return base
            step("read")
            rows = bucketed
            if record is not None:
                old = self._rows(record, touched).withColumn(BUCKET, self._bucket(record))
                rows = keep_last(old.unionByName(bucketed, allowMissingColumns=True), self.key, order)
            write = uuid.uuid4().hex
            # A folder per bucket, each made by one task: a bucket holds a fixed share of the keys.
            rows.repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{write}")
            step("written")
            schema = T.StructType([f for f in rows.schema.fields if f.name != BUCKET])
            held = {} if record is None else dict(record["buckets"])
            held.update({str(b): f"{write}/{BUCKET}={b}" for b in sorted(touched)})
            made = (base if base is not None else -1) + 1
            try:
                self.records.commit(made, {
                    "key": self.key, "bucket_count": record["bucket_count"] if record else self.buckets, "buckets": held, "schema": schema.jsonValue(),
                })
            except VersionTaken:
                if attempt == retries:
                    raise
                continue
            step("committed")
            return made
        raise AssertionError("unreachable")

    def expire(self, keep: int) -> list[int]:
        """Forgets all versions but the newest ``keep`` and removes the folders that only they name.

        Folders that no record names are left alone: a writer may be about to commit them.
        """
        versions = sorted(self.records.versions())
        old, kept = versions[:-keep] if keep else versions[:-1], versions[-max(keep, 1) :]
        needed = {p for v in kept for p in self.records.read(v)["buckets"].values()}
        dropped = {p for v in old for p in self.records.read(v)["buckets"].values()} - needed
        for v in old:
            self.records.folder.remove(record_name(v))
        data = Folder(self.spark, f"{self.root}/data")
        for p in sorted(dropped):
            data.remove(p)
        return old


def publish_payload(products: DataFrame, root: str, run: str) -> int:
    """Product payload as JSON under ``run=…``; a record then makes it the latest one. A failed run leaves the latest as it was.

    A run that is published again is written to a folder of its own, so that readers of the older one aren't disturbed.
    """
    spark = products.sparkSession
    folder = f"run={run}/{uuid.uuid4().hex}"
    products.write.json(f"{root}/{folder}")
    records = Records(spark, f"{root}/latest")
    while True:
        base = records.latest()
        made = (base if base is not None else -1) + 1
        try:
            records.commit(made, {"run": run, "folder": folder, "schema": products.schema.jsonValue()})
            return made
        except VersionTaken:
            continue


def read_payload(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """The latest payload, or the latest one of a run."""
    records = Records(spark, f"{root}/latest")
    for version in sorted(records.versions(), reverse=True):
        record = records.read(version)
        if run is None or record["run"] == run:
            return spark.read.schema(T.StructType.fromJson(record["schema"])).json(f"{root}/{record['folder']}")
    raise FileNotFoundError(f"no payload in {root}")
