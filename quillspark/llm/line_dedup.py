"""Line dedup: levelled sorted runs of line hashes, compacted periodically. [native]

Documents come in batches. A run is a table of 128-bit line hashes with the number of documents that hold each, dealt
into buckets by hash and sorted in them, so runs merge and anti-join bucket by bucket without another shuffle. A new
batch is merge-anti-joined with the runs' keys that are over the limit already (counting them further tells nothing),
and what is left becomes a run of level 0; `fanout` runs of a level are compacted to one of the next.

Rules: a null or empty text is one empty line; a line's key is the line without white space at its ends and with A-Z
lower-cased; keys of `min_chars` code points or more found in `min_docs` documents or more lose all their lines
everywhere. Rows that are equal in doc_id and text count as one document and each get the same result; a null doc_id
is a document of its own per text. Very long texts are one row each: no line leaves its document in the last join.
Extra columns stay outside. An empty table gives an empty result. Two different keys are taken for one only if two
64-bit hashes of different seeds agree (2**-128 a pair). Documents are told by their id and 128 bits of it and the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, STRIP, Scratch, join_rows, lower_ascii, with_row_key

KEY = ["h1", "h2"]


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line):
    return lower_ascii(F.btrim(line, F.lit(STRIP)))


class LineRuns:
    """Levelled sorted runs in the shared folder; a run is a bucketed, sorted table."""

    def __init__(self, spark: SparkSession, scratch: Scratch, min_docs: int, buckets: int, fanout: int):
        self.spark, self.scratch, self.min_docs, self.buckets, self.fanout = spark, scratch, min_docs, buckets, fanout
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"quill_run_{uuid.uuid4().hex[:12]}"
        (counts.repartition(self.buckets, *KEY).write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", f"{self.scratch.path}/{name}").saveAsTable(name))
        self.tables.append(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._write(self._merged(names), level + 1)
            for old in names:
                self._drop(old)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        self.scratch.drop(name)
        self.tables.remove(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs are merged by full merge joins: bucketed and sorted alike, they need no exchange."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("n_docs", "n_other").hint("merge")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_other", F.lit(0))
            out = out.join(other, KEY, "full").select(*KEY, n.alias("n_docs"))
        return out

    def counts(self) -> DataFrame | None:
        names = [n for level in self.levels for n in level]
        return self._merged(names) if names else None

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, n_docs, a key once."""
        so_far = self.counts()
        if so_far is not None:
            full = so_far.filter(F.col("n_docs") >= self.min_docs).hint("merge")
            batch = batch.join(full.select(*KEY), KEY, "left_anti")
        self._write(batch, 0)


def dedup_lines(
    spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 3, fanout: int = 2,
    buckets: int | None = None,
) -> DataFrame:
    """doc_id, text in; doc_id, n_lines, n_dropped, kept (the text that stays) out, a row for each row."""
    scratch = Scratch(spark, "lines")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = with_row_key(docs.select("doc_id", "text"))
    key = line_key(F.col("line"))
    lines = (
        docs.select(*ROW, F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .withColumn("key", key).filter(F.length("key") >= min_chars)
        .select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    lines = scratch.stash(lines, "lines")
    runs = LineRuns(spark, scratch, min_docs, buckets, fanout)
    try:
        for b in range(batches):
            own = lines.filter(F.pmod(ROW[1], F.lit(batches)) == b)
            runs.add(own.select(*ROW, *KEY).distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs")))
        common = scratch.stash(runs.counts().filter(F.col("n_docs") >= min_docs), "common")
    finally:
        for name in list(runs.tables):
            runs._drop(name)

    # A key with a great share of all lines would go to one task of a join. Keys with at least 1/65536 of all
    # (document, key) pairs are 65536 at most, by counting: these are broadcast, the others joined by shuffle.
    total = common.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") >= max(min_docs, total / 65536)
    parts = [
        lines.join(F.broadcast(common.filter(hot).select(*KEY)), KEY, "left_semi"),
        lines.join(F.broadcast(common.filter(hot).select(*KEY)), KEY, "left_anti").join(
            common.filter(~hot).select(*KEY), KEY, "left_semi"
        ),
    ]
    drops = (
        parts[0].unionByName(parts[1]).select(*ROW, "pos").groupBy(*ROW)
        .agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    )
    n, d = F.size(lines_of(F.col("text"))), F.coalesce(F.col("drops"), F.array().cast("array<int>"))
    bounds = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), d).alias("a"), F.concat(d, F.array(n)).alias("b")
    )
    kept = F.flatten(
        F.transform("bounds", lambda x: F.slice(F.col("lines"), x["a"] + 2, x["b"] - x["a"] - 1))
    )
    return (
        join_rows(docs, drops, "left")
        .select("doc_id", lines_of(F.col("text")).alias("lines"), d.alias("drops"), bounds.alias("bounds"))
        .select(
            "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"),
            F.array_join(kept, "\n").alias("kept"),
        )
    )
