"""Media columns: GIF. LZW code streams are decoded, palettes, disposal and transparency applied, and frames stored
with their times and colour histograms.

`decode` reads any GIF87a or GIF89a: global and local palettes, interlacing, all disposal methods, transparent colours,
clear codes anywhere or late. `gif_frames` does so for a column of files. `encode` stores bytes as the palette indices of
frames WIDTH samples wide and MAX_ROWS high at most, over a grey palette, with a full LZW dictionary, and is exact.

A null text is empty; an empty payload is padded to one row. Equal texts give equal bytes. Each row is handled alone, so
repeated rows, nulls in doc_id and very long texts (more frames) need no rule; an empty table gives none. Of a file that is
cut off or broken, the frames before that come with an error; a null or foreign file has no frames and an error; a file
without palettes is grey. A canvas or frame of more than `max_pixels` is such an error too: it bounds a task's memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches

WIDTH, MAX_ROWS, DELAY = 192, 64, 4
MAX_PIXELS = 1 << 26
#: Fixed values of the format: disposal methods.
KEEP, RESTORE = 1, 3
GREY = bytes(v for i in range(256) for v in (i, i, i))
BINS = 8


@dataclass
class Frame:
    """One composed frame: the canvas after it was drawn, and where it was drawn."""

    at_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]  # left, top, width, height
    rgb: np.ndarray  # height, width, 3

    def histogram(self, bins: int = BINS) -> np.ndarray:
        """Counts by channel and bin."""
        return np.stack([np.bincount(self.rgb[..., c].ravel() // (256 // bins), minlength=bins) for c in range(3)])


def code_widths(n: int, min_code: int) -> np.ndarray:
    """Bits of each of the first n codes after a clear code: as many as the dictionary's next place needs, 12 at most."""
    known = (1 << min_code) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.floor(np.log2(known)).astype(np.int64) + 1, 12)


def lzw_encode(samples: bytes, min_code: int = 8) -> bytes:
    """An LZW stream: the longest known run each time, and a clear code when the dictionary is full."""
    clear = 1 << min_code
    codes, clears = [clear], [0]
    known: dict[int, int] = {}
    n = clear + 2
    run = -1
    for b in samples:
        if run < 0:
            run = b
            continue
        key = run << 8 | b
        longer = known.get(key)
        if longer is not None:
            run = longer
            continue
        codes.append(run)
        known[key] = n
        n += 1
        run = b
        if n == 4096:
            clears.append(len(codes))
            codes.append(clear)
            known = {}
            n = clear + 2
    if run >= 0:
        codes.append(run)
    codes.append(clear + 1)
    sizes = np.diff([*clears, len(codes)])
    widths = np.concatenate([code_widths(1, min_code), *(code_widths(m, min_code) for m in sizes.tolist())])[: len(codes)]
    bits = np.array(codes)[:, None] >> np.arange(12) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(part),)) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes) -> bytes:
    """payload: a positive multiple of WIDTH bytes. A frame but the last is drawn where it differs from the canvas alone; if
    more than half of a box is as the canvas has it, this is transparent, if a colour is free for it. A frame whose
    successor is more like the canvas before it goes back to that one."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    free = 255 not in payload
    chunks = [samples[i : i + MAX_ROWS] for i in range(0, len(samples), MAX_ROWS)]
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(chunks[0]), 0xF7, 0, 0), GREY]
    canvas = np.zeros_like(chunks[0])
    for k, chunk in enumerate(chunks):
        high = len(chunk)
        same = chunk == canvas[:high]
        top, stop = 0, high
        if k and k + 1 < len(chunks):
            rows = np.flatnonzero(~same.all(1))
            top, stop = (int(rows[0]), int(rows[-1]) + 1) if len(rows) else (0, 1)
        drawn, clear = chunk[top:stop], 0
        if k and free and 2 * same[top:stop].sum() > drawn.size:
            drawn, clear = np.where(same[top:stop], 255, drawn).astype(np.uint8), 1
        now, disposal = canvas.copy(), KEEP
        now[:high] = chunk
        if k + 1 < len(chunks):
            following = chunks[k + 1]
            if (following == canvas[: len(following)]).sum() > (following == now[: len(following)]).sum():
                now, disposal = canvas, RESTORE
        parts += [
            b"\x21\xf9\x04", struct.pack("<BHBB", disposal << 2 | clear, DELAY, 255 * clear, 0), b"\x2c", struct.pack("<HHHHB", 0, top, WIDTH, stop - top, 0),
            b"\x08", sub_blocks(lzw_encode(drawn.tobytes())),
        ]
        canvas = now
    return b"".join([*parts, b"\x3b"])


def _runs_of_codes(stream: bytes, min_code: int) -> Iterator[np.ndarray]:
    """The codes between clear codes, up to the end code or the end of the stream. Their widths depend on their number alone,
    so they are read many at once."""
    clear, end = 1 << min_code, (1 << min_code) + 1
    data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    words = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16)
    total, at = len(stream) * 8, 0
    widths = code_widths(4096, min_code)
    upto = np.concatenate(([0], np.cumsum(widths)))
    while at + min_code < total:
        run, last = [], False
        here, starts = widths, upto
        while True:
            n = min(len(here), int(np.searchsorted(starts, total - at, side="right")) - 1)
            bit = at + starts[:n]
            codes = (words[bit >> 3] >> (bit & 7).astype(np.uint32)) & ((np.uint32(1) << here[:n].astype(np.uint32)) - np.uint32(1))
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop):
                run.append(codes[: stop[0]])
                last, at = bool(codes[stop[0]] == end), int(bit[stop[0]] + here[stop[0]])
                break
            run.append(codes)
            if n < len(here):
                last = True
                break
            at, here, starts = at + int(starts[n]), np.full(4096, 12), np.arange(4097) * 12  # no clear code yet: 12 bits on
        yield np.concatenate(run)
        if last:
            return


def lzw_decode(stream: bytes, min_code: int, n: int) -> np.ndarray:
    """n samples of an LZW stream; a stream that ends early leaves the rest 0.

    The dictionary's entry made after code t is what code t stands for and the sample after it: a stretch of the output. So
    a code points to an earlier stretch, and each sample to an earlier one; pointers are followed for all at once."""
    if not 1 < min_code < 9:
        raise ValueError(f"LZW codes of {min_code} bits")
    clear = 1 << min_code
    out, size = [np.empty(0, np.uint8)], 0
    for codes in _runs_of_codes(stream, min_code):
        codes, place = codes.astype(np.int64), np.arange(len(codes))
        literal, entry = codes < clear, codes - (clear + 2)
        bad = np.flatnonzero(~literal & ((entry < 0) | (entry >= place)))
        if len(bad):
            raise ValueError(f"LZW code {codes[bad[0]]} of {clear + 2 + max(0, bad[0] - 1)}")
        entry = np.where(literal, place, entry)
        length, at = (~literal).astype(np.int64), entry
        while (step := length[at]).any():
            length, at = length + step, at[at]
        length += 1
        start = np.cumsum(length) - length
        owner = np.repeat(place, length)
        source = np.arange(len(owner)) - start[owner] + start[entry][owner]
        while True:
            further = source[source]
            if (further == source).all():
                break
            source = further
        out.append(codes[owner[source]].astype(np.uint8))
        size += len(owner)
        if size >= n:
            break
    got = np.concatenate(out)[:n]
    return np.concatenate((got, np.zeros(n - len(got), np.uint8)))


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """Composed frames, one at a time. ValueError: no GIF, cut off, or broken; frames before that come."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")

    def read(form: str, at: int) -> tuple:
        if at + struct.calcsize(form) > len(data):
            raise ValueError(f"cut off at byte {len(data)}")
        return struct.unpack_from(form, data, at)

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        size = 3 << ((flags & 7) + 1)
        return np.frombuffer(read(f"{size}s", at)[0], np.uint8).reshape(-1, 3), at + size

    wide, high, flags, _, _ = read("<HHBBB", 6)
    if wide * high > max_pixels:
        raise ValueError(f"a canvas of {wide} by {high}")
    at = 13
    shared = np.frombuffer(GREY, np.uint8).reshape(-1, 3)  # a file without palettes is grey
    if flags & 0x80:
        shared, at = colours(flags, at)
    canvas = np.zeros((high, wide, 3), np.uint8)
    disposal, delay, clear_color, time = 0, 0, None, 0
    while True:
        (kind,) = read("<B", at)
        if kind == 0x3B:
            return
        if kind == 0x21:
            if read("<B", at + 1)[0] == 0xF9:
                bits, delay, clear_color = read("<BHB", at + 3)
                disposal = bits >> 2 & 7
                clear_color = clear_color if bits & 1 else None
            _, at = _read_blocks(data, at + 2)
            continue
        if kind != 0x2C:
            raise ValueError(f"byte {kind} where a block begins")
        left, top, w, h, flags = read("<HHHHB", at + 1)
        if w * h > max_pixels:
            raise ValueError(f"a frame of {w} by {h}")
        at += 10
        palette = shared
        if flags & 0x80:
            palette, at = colours(flags, at)
        (min_code,) = read("<B", at)
        stream, at = _read_blocks(data, at + 1)
        index = lzw_decode(stream, min_code, w * h).reshape(h, w)
        if flags & 0x40:  # interlaced: rows come in four passes
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            index = index[np.argsort(order)]
        drawn = palette[np.minimum(index, len(palette) - 1)]
        before = canvas.copy() if disposal == RESTORE else None
        part = canvas[top : top + h, left : left + w]
        if clear_color is None:
            part[...] = drawn[: part.shape[0], : part.shape[1]]
        else:
            seen = (index != clear_color)[: part.shape[0], : part.shape[1]]
            part[seen] = drawn[: part.shape[0], : part.shape[1]][seen]
        yield Frame(time, delay * 10, (left, top, w, h), canvas.copy())
        time += delay * 10
        if disposal == 2:
            part[...] = 0
        elif disposal == RESTORE:
            canvas = before
        disposal, delay, clear_color = 0, 0, None


FRAME = "struct<at_ms: long, delay_ms: long, left: int, top: int, width: int, height: int, histogram: array<long>>"


def timed(f: Frame) -> dict:
    left, top, w, h = f.box
    return {"at_ms": f.at_ms, "delay_ms": f.delay_ms, "left": left, "top": top, "width": w, "height": h, "histogram": f.histogram().ravel().tolist()}


def gif_frames(df: DataFrame, column: str = "gif", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Replaces a column of GIF bytes by a struct of the same name: frames (FRAME: times, box and the colour histogram of the
    canvas once the frame is drawn: red, green, blue, BINS counts each) and error, null for whole files. A null is no GIF."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in parts:
            frames, errors = [], []
            for data in files:
                own: list[dict] = []
                error = None
                try:
                    for f in decode(bytes(data or b""), max_pixels):
                        own.append(timed(f))
                except ValueError as e:
                    error = str(e)
                frames.append(own)
                errors.append(error)
            yield pd.DataFrame({"frames": frames, "error": pd.Series(errors, dtype=object)})

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    small_batches(df.sparkSession)
    return df.withColumn(column, F.pandas_udf(run, f"frames array<{FRAME}>, error string")(column))


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [payload_of(t) for t in pdf["text"].tolist()]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [n for _, n in made], "gif": [encode(p) for p, _ in made]})


def read_payload(data: bytes) -> tuple[bytes, list[dict]]:
    """What encode stored, and the frames: each shows the whole canvas, but the last, whose box ends the payload."""
    parts: list[bytes] = []
    frames: list[dict] = []
    rows = 0
    for f in decode(data):
        parts.append(np.ascontiguousarray(f.rgb[..., 0]).tobytes())
        frames.append(timed(f))
        rows = f.box[3]
    parts[-1] = parts[-1][: rows * WIDTH]
    return b"".join(parts), frames


def _media(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for stored in pdf["gif"].tolist():
            read, frames = read_payload(stored)
            levels = np.frombuffer(read, np.uint8)
            hist = np.bincount(levels // (256 // BINS), minlength=BINS).tolist()
            feature = f"frames={len(frames)};ms={frames[-1]['at_ms'] + frames[-1]['delay_ms']};luma={levels.mean():.3f};hist={','.join(map(str, hist))}"
            rows.append((len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, frames))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
        yield pd.concat((pdf[["doc_id", "n_bytes"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)), axis=1)


def media_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text in. Each text is stored as a GIF in the shared folder and read back; a row for each row: what the contract
    lists, and frames (FRAME)."""
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    files = docs.selectExpr("cast(doc_id as string) as doc_id", "text").mapInPandas(_stored, "doc_id string, n_bytes long, gif binary")
    schema = (
        "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        f"media_sha256 string, feature string, frames array<{FRAME}>"
    )
    out = Scratch(spark, "media").stash(files, "gif").mapInPandas(_media, schema)
    return out.withColumn("doc_id", out["doc_id"].cast(kind))
