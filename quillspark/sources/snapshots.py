"""Snapshots of a Parquet store: a log of versions, each a list of files.

The log is a folder of numbered entries that are created once and never changed, so of two writers that have read the same
version one fails. Inserts add files; updates and deletes rewrite the files that hold changed keys. Files are sorted by key
and dealt by ranges of it, so filters on the key skip files by their statistics.

A transaction over several stores adds an entry to each log that names the transaction's record, and then creates the record:
from then on all entries count. An entry whose record is missing doesn't count; a later writer may settle it by creating
the record as aborted, and the first to create it decides.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TransactionError
from .scratch import delete, file_system, stash

FILE = "__file"


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file whole; False if there is one."""
    temp, fs = file_system(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    final, _ = file_system(spark, path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(temp), fs.makeQualified(final), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        fs.delete(temp, False)
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            return False
        raise


def names(spark: SparkSession, path: str) -> list[str]:
    p, fs = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def plain(path: str) -> str:
    """A file's path in one form, however Spark or Hadoop write it."""
    return unquote(path).replace("file:///", "file:/")


@dataclass
class Snapshot:
    version: int
    files: list[str]
    schema: T.StructType
    next_key: int | None = None

    def text(self, txn: str | None) -> str:
        return json.dumps({"files": self.files, "schema": json.loads(self.schema.json()), "next_key": self.next_key, "txn": txn})


@dataclass
class Change:
    """What a transaction does to a store: keys that leave it (columns __k0, ...), rows that come."""

    gone: DataFrame | None = None
    added: DataFrame | None = None
    next_key: int | None = None


@dataclass
class Log:
    spark: SparkSession
    path: str
    root: str = field(init=False)

    def __post_init__(self):
        p, fs = file_system(self.spark, f"{self.path.rstrip('/')}.snapshots")
        self.root = fs.makeQualified(p).toString()

    def _entry(self, version: int) -> str:
        return f"{self.root}/log/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in names(self.spark, f"{self.root}/log") if n.endswith(".json")]

    def load(self, version: int) -> Snapshot | None:
        """A version; None if its transaction hasn't been committed."""
        made = json.loads(read_text(self.spark, self._entry(version)))
        if made["txn"] and read_text(self.spark, made["txn"]) != "committed":
            return None
        return Snapshot(version, made["files"], T.StructType.fromJson(made["schema"]), made["next_key"])

    def current(self) -> Snapshot:
        """The last version that counts; before any, the files of the folder."""
        for version in reversed(self.versions()):
            if found := self.load(version):
                return found
        df = self.spark.read.parquet(self.path)
        return Snapshot(0, sorted(df.inputFiles()), df.schema)

    def read(self, s: Snapshot) -> DataFrame:
        if s.version == 0:
            return self.spark.read.parquet(self.path)
        if not s.files:
            return self.spark.createDataFrame([], s.schema)
        return self.spark.read.schema(s.schema).parquet(*s.files)

    def _write(self, df: DataFrame, key: list[str]) -> list[str]:
        """New files, in the order of the key."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        by = [F.col(k) for k in key]
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(folder)
        return [f"{folder}/{n}" for n in names(self.spark, folder) if n.startswith("part-")]

    def prepare(self, base: Snapshot, key: list[str], change: Change) -> Snapshot:
        """Writes the files of the next version."""
        df = self.read(base)
        files, schema = list(base.files), df.schema
        if change.added is not None:
            kinds = {f.name: f for f in schema}
            schema = T.StructType([*schema, *[f for f in change.added.schema if f.name not in kinds]])
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        new = change.added
        if change.gone is not None and files:
            gone = stash(change.gone.distinct(), "gone")
            keys = gone.columns
            flat = df.select("*", *[F.col(k).alias(n) for k, n in zip(key, keys, strict=True)], F.col("_metadata.file_path").alias(FILE))
            found = [r[0] for r in flat.join(gone, keys, "left_semi").select(FILE).distinct().collect()]  # names of files
            if found:
                hit = {plain(f) for f in found}
                files = [f for f in files if plain(f) not in hit]
                rest = flat.filter(F.col(FILE).isin(found)).join(gone, keys, "left_anti").select(df.columns)
                new = rest if new is None else rest.unionByName(new, allowMissingColumns=True)
        if new is not None:
            files += self._write(new, key)
        next_key = max((k for k in (base.next_key, change.next_key) if k is not None), default=None)
        return Snapshot(base.version, files, schema, next_key)

    def publish(self, base: Snapshot, made: Snapshot, txn: str | None = None) -> Snapshot:
        """Makes the version after `base`, if no other writer has."""
        after = max(self.versions(), default=0)
        for version in [v for v in self.versions() if v > base.version]:
            record = json.loads(read_text(self.spark, self._entry(version)))["txn"]
            if not record or read_text(self.spark, record) == "committed" or (not create_once(self.spark, record, "aborted") and read_text(self.spark, record) == "committed"):
                raise TransactionError(f"{self.path}: another writer has committed version {version}; read the store anew")
        new = Snapshot(max(after, base.version) + 1, made.files, made.schema, made.next_key)
        if not create_once(self.spark, self._entry(new.version), new.text(txn)):
            raise TransactionError(f"{self.path}: another writer has committed version {new.version}; read the store anew")
        return new

    def vacuum(self, keep: int = 1) -> int:
        """Removes entries before the last `keep` versions that count, and files that no entry left names; how many folders
        and entries. Frames that still read older versions fail afterwards."""
        versions, kept, gone = self.versions(), [], 0
        for v in reversed(versions):
            if len(kept) < keep:
                if found := self.load(v):
                    kept.append(found)
            else:
                delete(self.spark, self._entry(v))
                gone += 1
        used = {plain(f).rsplit("/", 2)[-2] for v in self.versions() for f in json.loads(read_text(self.spark, self._entry(v)))["files"]}
        for folder in names(self.spark, f"{self.root}/data"):
            if folder not in used:
                delete(self.spark, f"{self.root}/data/{folder}")
                gone += 1
        return gone


def commit_all(changes: list[tuple[Log, Snapshot, list[str], Change]]) -> list[Snapshot]:
    """Writes all files first, then makes the versions of all stores count at once."""
    made = [(log, base, log.prepare(base, key, change)) for log, base, key, change in changes]
    if len(made) == 1:
        log, base, new = made[0]
        return [log.publish(base, new)]
    if not made:
        return []
    spark = made[0][0].spark
    record = f"{made[0][0].root}/txn/{uuid.uuid4().hex}"
    try:
        out = [log.publish(base, new, record) for log, base, new in made]
    except Exception:
        create_once(spark, record, "aborted")
        raise
    if not create_once(spark, record, "committed"):
        raise TransactionError("another writer has settled this transaction as aborted")
    return out
