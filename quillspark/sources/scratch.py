"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir. Where it is unset, local
    mode takes a temporary folder; on a cluster that would lose data, so it is an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_quill_root", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = context._quill_root = "file://" + tempfile.mkdtemp(prefix="quill-")
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


class Scratch:
    """A folder of written tables in the shared root: they cut lineage and survive lost executors.

    Results may read these tables lazily, so they are removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/quill/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.remove)

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")

    def remove(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # noqa: BLE001 - the session may be gone when the driver ends
            pass


def stash(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: computed once, with no lineage behind it."""
    return Scratch(df.sparkSession, name).stash(df, "rows")
