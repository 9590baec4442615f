"""Helpers that the operators of this subpackage share: inputs, scratch tables, words."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch  # noqa: F401 - the other modules take it from here

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of the alphanumeric rule `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, as a Java pattern.
GAP_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of the white-space rule, as a Java pattern.
WORD_SPACE = r"[^\x20\x09-\x0D]+"
STRIP = " \t\n\x0b\x0c\r"

#: Byte tables for `bytes.translate`: lower case A-Z, and every byte outside alphanumeric words to a space.
_ALNUM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: str | None) -> list[bytes]:
    """The words of the alphanumeric rule after lower-casing A-Z, in UTF-8."""
    return text.encode().translate(_ALNUM_BYTES).split() if text else []


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def alnum_array(text: Column) -> Column:
    """Array of the words of the alphanumeric rule; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP_ALNUM), "")


def space_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SPACE)), F.lit(0)).cast("long")


#: Columns that name a row: its id and 128 bits of its id and text.
ROW = ["__row_id", "__row_1", "__row_2"]


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds ROW; df: doc_id, text. Rows equal in both have one key and count as one document."""
    text = F.coalesce(F.col("text"), F.lit("\x00null"))
    return df.withColumns({
        ROW[0]: F.col("doc_id"), ROW[1]: F.xxhash64(F.lit("row"), "doc_id", text), ROW[2]: F.xxhash64(F.lit(17), text, "doc_id"),
    })


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit number of a row from its id and text, where a number is needed."""
    return F.xxhash64(F.lit("row"), doc_id, F.coalesce(text, F.lit("\x00null")))


def join_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins by ROW, null ids too; the right side's ROW goes."""
    other = right.withColumnsRenamed({c: f"{c}_r" for c in ROW})
    same = F.col(ROW[0]).eqNullSafe(F.col(f"{ROW[0]}_r")) & (F.col(ROW[1]) == F.col(f"{ROW[1]}_r")) & (F.col(ROW[2]) == F.col(f"{ROW[2]}_r"))
    return left.join(other, same, how).drop(*[f"{c}_r" for c in ROW])


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: their workers needn't have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_quill_shipped", False):
        package = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="quill-")) / "quill_package.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(out))
        context._quill_shipped = True


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of so many rows and bytes at most (or one row), so that long texts don't pile up in a Python worker.
    Plans read this when they run, so it stays set in the session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Other Arrow batches for what is run inside: large ones for narrow rows."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


#: What a Python worker keeps from one task to the next, by name: how it is dropped.
KEPT: dict[str, Callable[[], None]] = {}


def drop_kept(but: str = "") -> None:
    for name, drop in KEPT.items():
        if name != but:
            drop()


def give_back() -> None:
    """Returns free memory to the system. Workers live as long as their executor and serve all operators; the allocators
    of C and Arrow would keep what the largest task took in each of them, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], keep: str = "") -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's function that first drops what tasks of other kinds have kept, and gives memory back at its end."""

    @wraps(run)
    def tidied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_kept(keep)
        yield from run(batches)
        give_back()

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Hashes of all words of many texts at once: a word's length and its blocks of 8 bytes go one by one through a mixer that
# is a bijection, so words of 8 bytes or fewer and of one length never share a hash, and others do as random values
# would: with a probability of 2**-64 a pair. Words beyond LONG bytes take a hash of xxhash's.
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG = 64


def word_blocks(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as numbers; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))


def blocks_at(blocks: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Blocks of which only the first `left` bytes count."""
    return blocks[at] & _FIRST[np.minimum(left, 8)]


def word_bounds(data: bytes, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; gap: which of the 256 bytes stand between words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~gap[np.frombuffer(data, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_words(data: bytes, gap: np.ndarray, twice: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hash, first byte and end of each word of data (and a second hash)."""
    start, stop = word_bounds(data, gap)
    size, blocks = stop - start, word_blocks(data)
    hashes = [mix64(size.astype(np.uint64) + np.uint64(s)) for s in _SEEDS[: 1 + twice]]
    live = np.flatnonzero(size <= LONG)
    at, left = start[live], size[live]
    while len(live):
        block = blocks_at(blocks, at, left)
        for h in hashes:
            h[live] = mix64(h[live] ^ block)
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        word = data[start[i] : stop[i]]
        for h, s in zip(hashes, _SEEDS, strict=False):
            h[i] = xxhash.xxh3_64_intdigest(word, s)
    return (hashes[0], start, stop, *hashes[1:])


GAP_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
GAP_32 = np.arange(256) == 32


def joined(texts: list[str | None], table_: bytes | None = None) -> tuple[bytes, np.ndarray]:
    """Texts in UTF-8, each followed by a space, with A-Z lower-cased (or table_ applied), and where each begins."""
    raw = [(t or "").encode() + b" " for t in texts]
    begins = np.cumsum([0, *map(len, raw)])
    data = b"".join(raw)
    return data.translate(table_) if table_ else data.lower(), begins


ALNUM_BYTES = _ALNUM_BYTES


def slices(texts: list[str | None], most: int = 1 << 19) -> Iterator[slice]:
    """Consecutive texts of about `most` characters in all."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def xxhash_longs(*columns: np.ndarray) -> np.ndarray:
    """What F.xxhash64 gives for columns of longs."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = h + _P[4] + np.uint64(8)
        h = h ^ (turn(c.view(np.uint64) * _P[1], 31) * _P[0])
        h = turn(h, 27) * _P[0] + _P[3]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


class Bloom:
    """A filter over long hashes, of 16 bits a hash and 2**MOST at most (64 MB): beyond that it lets more pass, never less.
    Spark's bitmap functions build it, so what comes to the driver is its bits alone."""

    MOST, BUCKET = 29, 1 << 15

    def __init__(self, hashes: DataFrame, n: int):
        self.bits = min(self.MOST, max(16, (16 * n).bit_length()))
        h = F.col(hashes.columns[0])
        slots = F.array(*[F.shiftrightunsigned(F.shiftleft(h, k), 64 - self.bits) + 1 for k in (0, 32)])
        rows = hashes.select(F.explode(slots).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
        self.data = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in rows.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).toLocalIterator():
            at = (r["bucket"] - 1) * (self.BUCKET >> 3)
            self.data[at : at + (self.BUCKET >> 3)] = np.frombuffer(r["bits"], np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """False only for hashes that were not given."""
        out = np.ones(len(hashes), bool)
        for k in (0, 32):
            slot = ((hashes.view(np.uint64) << np.uint64(k)) >> np.uint64(64 - self.bits)).astype(np.int64)
            out &= (self.data[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        return out


def gathered(spark: SparkSession, df: DataFrame) -> tuple[np.ndarray, ...]:
    """Columns (long or double) of a table known to be small, in the order of the first."""
    names, kinds = df.columns, [np.int64 if k == "bigint" else np.float64 for _, k in df.dtypes]

    @tidy
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({c: [pdf[c].to_numpy(k).tobytes()] for c, k in zip(names, kinds, strict=True)})

    with batch_rows(spark, 100_000):
        got = df.mapInPandas(packed, ", ".join(f"`{c}` binary" for c in names)).collect()
    out = [np.frombuffer(b"".join(bytes(r[i]) for r in got), k) for i, k in enumerate(kinds)]
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


# Tables of counts of fixed size, gathered over all tasks: each task sends its table in compressed chunks, and these are
# added in two steps, so no task holds more than its chunks, however many tasks there were.
CHUNK = 1 << 12
COUNT_SCHEMA = "tbl int, chunk int, salt int, counts binary"


def count_rows(counts: np.ndarray) -> pd.DataFrame:
    """counts: tables x buckets, of the task that calls."""
    salt, rows = TaskContext.get().partitionId() % 16, []
    for t in range(len(counts)):
        for c in range(0, counts.shape[1], CHUNK):
            part = counts[t, c : c + CHUNK]
            if part.any():
                rows.append((t, c // CHUNK, salt, pack_counts(part)))
    return pd.DataFrame(rows, columns=["tbl", "chunk", "salt", "counts"])


def pack_counts(part: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold the largest, with runs and Huffman codes (no search for matches)."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(part.max(initial=0)) < 1 << (8 * w))
    coder = zlib.compressobj(9, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    return bytes((width,)) + coder.compress(part.astype(f"<u{width}").tobytes()) + coder.flush()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(raw)[1:]), f"<u{raw[0]}").astype(np.int64)


def _adder(salted: bool):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for t, c, s, raw in zip(pdf["tbl"].tolist(), pdf["chunk"].tolist(), pdf["salt"].tolist(), pdf["counts"], strict=True):
                part = unpack_counts(raw)
                key = (t, c, s if salted else 0)
                sums[key] = sums[key] + part if key in sums else part
        yield pd.DataFrame([(*k, pack_counts(v)) for k, v in sums.items()], columns=["tbl", "chunk", "salt", "counts"])

    return run


def sum_counts(spark: SparkSession, parts: DataFrame, tables: int, buckets: int) -> np.ndarray:
    """The sum of the tables that all tasks sent; buckets: a multiple of CHUNK."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(n, "tbl", "chunk", "salt").mapInPandas(_adder(True), COUNT_SCHEMA)
    parts = parts.repartition(n, "tbl", "chunk").mapInPandas(_adder(False), COUNT_SCHEMA)
    out = np.zeros((tables, buckets), np.int64)
    for r in parts.collect():  # as many counts as the table has
        out[r["tbl"], r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = unpack_counts(bytes(r["counts"]))
    return out
