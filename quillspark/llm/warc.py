"""WARC files and their boundary-chain verification.

Writing: records are built as columns; a task joins them to files of about `file_bytes`, which Spark's own text writer
writes with the record end (two line breaks) as its line separator. So files are plain WARC/1.0, in any store Spark can
write, and a lost task leaves no half files. Of records with equal payloads of `min_bytes` or more, that of the largest
page_id is a response, the others are revisits of it without the payload; smaller ones are all responses.

Reading: every place where a version line stands after a record end (or at a file's start) is a candidate record; its header gives the place of its
successor. Candidates are a table (file, offset, successor, fields). Pointer jumping from the start of each file keeps
those that can be reached: places inside payloads that look like records are never anyone's successor from there. Files of
any name are read, WARC/1.0 and 1.1, plain or gzipped (members of records or whole), and records of any kind.

A null html is an empty payload. A null page_id is written as "null" and read back as null; it is the smallest id. Rows
equal in page_id and payload are all responses when they are the largest. Null urls become empty. Extra columns stay
outside. An empty table gives none. A file is read by one task, whole: own ones are of `file_bytes` or one record, others must
be below 2 GB, as Spark reads no larger ones.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Fixed values of the format.
MAGIC, BREAK, RECORD_END = b"WARC/1.0\r\n", "\r\n", "\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Payloads with copies, of about 60 bytes each, that may be broadcast.
MAX_BROADCAST = 500_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hexadecimal string: 40 bits (8 digits of base 32) at a time."""
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One column, record: each page's WARC record without its end."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(
        "page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("hex"),
        F.octet_length(payload).cast("long").alias("n"),
    )
    # Copies of one payload may be a third of all rows. What answers for a payload is found by a partial aggregate; only
    # payloads with copies go on. If they are MAX_BROADCAST at most they are broadcast, and no page is shuffled. Else those
    # with at least 1/65536 of all pages, which are 65536 at most, are broadcast, and the others are joined by shuffle.
    slim = own.select("page_id", "hex").filter(F.col("n") >= min_bytes)
    groups = slim.groupBy("hex").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    groups = groups.filter("copies > 1")
    few = groups.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    hot = F.lit(True) if few else F.col("copies") * 65536 >= pages.count()
    a = own.join(F.broadcast(groups.filter(hot).select("hex", F.col("first").alias("hot_first"))), "hex", "left")
    b = groups.filter(~hot).select("hex", F.col("first").alias("cold_first"))
    own = a.withColumn("cold_first", F.lit(None).cast("long")) if few else a.join(b, "hex", "left")
    first = F.coalesce("hot_first", "cold_first")
    again = first.isNotNull() & ~first.eqNullSafe(F.col("page_id"))
    # A null id never answers for others unless all are null.
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(RECORD_END))
    body = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("hex")),
        F.when(again, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(first))
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(RECORD_END),
    )
    return own.select(F.concat(head, body).alias("record"))


def _files(file_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        size = 0
        for pdf in batches:
            for record in pdf["record"].tolist():
                n = len(record.encode())
                if held and size + n > file_bytes:
                    yield pd.DataFrame({"value": [RECORD_END.join(held)]})
                    held, size = [], 0
                held.append(record)
                size += n
        if held:
            yield pd.DataFrame({"value": [RECORD_END.join(held)]})

    return run


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = 16 << 20) -> None:
    small_batches(pages.sparkSession)
    files = records(pages, min_bytes).mapInPandas(_files(file_bytes), "value string")
    files.write.mode("overwrite").option("lineSep", RECORD_END).option("maxRecordsPerFile", 1).text(path)


def _header(data: bytes, at: int, stop: int, what: bytes) -> tuple[dict[bytes, bytes], int]:
    """Fields by lower-case name, and where the body begins; -1 if there is no header here that ends before `stop`."""
    if not data.startswith(what, at):
        return {}, -1
    # Candidates stand after such a break, so this looks no further than the next of them.
    end = data.find(b"\r\n\r\n", at, stop)
    if end < 0 or VERSION.search(data, at + 1, end + 2):  # a version line is no field
        return {}, -1
    lines = data[at:end].split(b"\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}, end + 4


def _page(urn: bytes) -> str | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", urn)
    return m[1].decode() if m else None


def candidates(data: bytes) -> Iterator[tuple]:
    """Of whatever looks like a record: offset, successor, page_id, payload_bytes, payload_digest, record_type, refers_to,
    record_id, target_uri, and where its payload is (from, to)."""
    text = lambda b: b.decode("utf-8", "replace")
    for found in VERSION.finditer(data):
        at = found.start()
        if at and data[max(at - 4, 0) : at] != b"\r\n\r\n":
            continue
        fields, body = _header(data, at, len(data), b"WARC/1.")
        size = fields.get(b"content-length", b"")
        if body < 0 or not size.isdigit() or body + int(size) > len(data):
            continue
        stop = body + int(size)
        http, payload = _header(data, body, stop, b"HTTP/1")
        kind = text(fields.get(b"warc-type", b""))
        payload = stop if kind == "revisit" else payload if payload >= 0 else body
        if kind == "revisit":
            digest = text(fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:"))
            n = int(x) if (x := http.get(b"content-length", b"")).isdigit() else 0
        else:
            n, digest = stop - payload, base64.b32encode(hashlib.sha1(data[payload:stop]).digest()).decode()
        name, uri = fields.get(b"warc-record-id", b""), fields.get(b"warc-target-uri", b"")
        yield at, stop + 4, _page(name), n, digest, kind, _page(fields.get(b"warc-refers-to", b"")), text(name), text(uri), payload, stop


FIELDS = ["offset", "successor", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri"]
SCHEMA = (
    "file string, offset long, successor long, page_id string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to string, record_id string, target_uri string, payload binary"
)
SIZED = f"{SCHEMA}, size long"


def _candidates(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = list(candidates(data))
                if data and not rows:
                    raise ValueError(f"{name} holds no record")
                out = pd.DataFrame([r[: len(FIELDS)] for r in rows], columns=FIELDS)
                out["payload"] = [data[r[-2] : r[-1]] for r in rows] if with_payload else None
                yield out.assign(file=name, size=len(data))

    return run


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which records (offsets ascending) the chain from offset 0 meets, by pointer jumping: the pointers double their
    length each round, and the records met are joined by what they point to."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    at = np.where((at < n) & (offsets[np.minimum(at, max(n - 1, 0))] == successors), at, n) if n else at
    jump = np.append(at, n)  # n: no record
    met = np.zeros(n + 1, bool)
    if n and offsets[0] == 0:
        met[0] = True
    while True:
        grown = met.copy()
        grown[jump[met]] = True
        grown[n] = False
        if (jump == n).all() or (grown == met).all():
            return grown[:n]
        met, jump = grown, jump[jump]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("offset", ignore_index=True)
    met = pdf[reachable(pdf["offset"].to_numpy(), pdf["successor"].to_numpy())]
    end, size = int(met["successor"].max()) if len(met) else 0, int(pdf["size"].iloc[0])
    if end not in (size, size + len(RECORD_END)):  # a last record may lack its end
        raise ValueError(f"the records of {pdf['file'].iloc[0]} end at byte {end} of {size}")
    return met.drop(columns="size")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record that the chain from its file's start reaches; an error if a chain doesn't end with its file.
    Page ids are those of records written here; payloads are null unless asked for."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select("path", "content").mapInPandas(_candidates(with_payload), SIZED)
    return found.groupBy("file").applyInPandas(_chain, SCHEMA)


def archive(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = dict(pages.dtypes)["page_id"]
    path = path or f"{Scratch(spark, 'warc').path}/files"
    write_warc(pages.select("page_id", "url", "html"), path, min_bytes)
    out = read_warc(spark, path)
    return out.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
