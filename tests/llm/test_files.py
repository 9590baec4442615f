"""Token files, WARC and GIF: exact round trips and brute force."""

import base64
import gzip
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import gif, token_files, warc
from quillspark.llm.common import GAP_SPACE, word_blocks, word_bounds
from quillspark.llm.token_files import SEGMENT, WordEncoder, pack, read_token_files, token_index, unpack, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=70), min_size=1, max_size=6))
def test_simple8b(docs):
    ids = np.array([i for d in docs for i in d], np.uint64)
    counts = np.array([len(d) for d in docs])
    words, first = pack(ids, counts)
    assert unpack(words, first.astype(np.int64), counts).tolist() == ids.tolist()


def test_simple8b_segments():
    ids = np.random.default_rng(1).integers(0, 50_000, 5 * SEGMENT + 7).astype(np.uint64)
    counts = np.array([0, 3 * SEGMENT, 1, 2 * SEGMENT + 6])
    words, first = pack(ids, counts)
    assert len(first) == 7 and (unpack(words, first.astype(np.int64), counts) == ids).all()
    assert len(pack(np.zeros(600, np.uint64), np.array([600]))[0]) == 10  # 60 to a word


TEXTS = ["It's the dog's... bone. CAN'T! <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "Éa, É. über-naïve 3,14 a1b2 ﬁ Ǆ İ ſ", "a.b.c. (x), \"y.\" word; ###", " a b　c \x1c d \x00", "é ́ x", "", None, "日本語。テキスト, ok", "'s 't 'Re n't ''s"]


def test_word_encoder_is_exact():
    model, r = Tokenizer.from_file(PATH), random.Random(1)
    parts = [p for t in TEXTS if t for p in t.split(" ")] + ["the", "of", "The.", "dog", "xyzzyq"]
    texts = TEXTS + ["".join(r.choice(parts) + r.choice([" ", "\n", "\t ", ""]) for _ in range(60)) for _ in range(60)]
    enc = WordEncoder(PATH, 2, bits=8)  # a table that fills often
    for k in range(0, len(texts), 7):
        part = texts[k : k + 7]
        ids, counts = enc.encode([None if t is None else t.encode() for t in part])
        want = [[*model.encode(t or "", add_special_tokens=False).ids, 2] for t in part]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def same_ids(enc, model, texts):
    ids, counts = enc.encode([None if t is None else t.encode() for t in texts])
    want = [[*e.ids, 2] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_word_encoder_of_all_scripts():
    """Letters with marks, composed and not, of many scripts; words whose polynomial hashes agree; words beyond the table."""
    model, r, enc = Tokenizer.from_file(PATH), random.Random(3), WordEncoder(PATH, 2, bits=10)
    assert enc.by_piece
    spans = ((32, 127), (0xA0, 0x530), (0x5D0, 0x6FF), (0x900, 0x97F), (0x1100, 0x1200), (0x1E00, 0x2070), (0x3040, 0x30FF), (0xAC00, 0xAC80), (0x1F600, 0x1F650), (0x1C, 0x21))
    pool = [chr(c) for a, b in spans for c in range(a, b)] + ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c", "I\u0307\u0339", "'s", "'LL", " ", "\n", " \t", "<|endoftext|>", "<|", "the "] * 20
    thue = ["".join("AB"[i.bit_count() % 2] for i in range(1024)), "".join("BA"[i.bit_count() % 2] for i in range(1024))]
    for _ in range(400):
        same_ids(enc, model, ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(50)])
    same_ids(enc, model, [*thue, " ".join(thue), "x" * 70 + " " + "y" * 64 + " z" * 3, "\x00 \x00\x00 a\x00", "no" * 5000 + "日本語" * 2000, None, "", " "])
    small = WordEncoder(PATH, 2, bits=10)
    small.table.room = 500  # full by ids before it is full by words
    for k in range(20):
        same_ids(small, model, [" ".join(f"word{r.randrange(3000)}" for _ in range(80))] * 2)


def test_word_table_compares_bytes():
    """Words of one hash keep their own ids."""
    table = token_files.WordTable(np.dtype("<u2"), b"\2\0", 6)
    data = b"first second a-word-of-more-than-eight first- "
    start, stop = word_bounds(data, GAP_SPACE)
    blocks, length, h = word_blocks(data), stop - start, np.full(4, 7, np.uint64)
    for k in range(3):
        n = -(-length[k] // 8)
        table.append(h[:1], length[k : k + 1], np.array([int.from_bytes(data[start[k] + 8 * i : min(stop[k], start[k] + 8 * i + 8)], "little") for i in range(n)], np.uint64), [bytes((k, 0))])
        table.place(table.n - 1)
    assert table.find(h, start, length, blocks).tolist() == [1, 2, 3, -1]


def test_token_files(spark, tmp_path):
    pairs = [(i * 3 % 50, t) for i, t in enumerate(TEXTS * 4)] + [(None, "null id"), (None, None), (7, "the " * 30_000), (-5, "minus"), (10**15, "far")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in pairs], "doc_id long, text string, start int, shard int")
    got = token_index(spark, docs, PATH).collect()
    model = Tokenizer.from_file(PATH)
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, (p[1] or "").encode()))
    start, want = 0, []
    for i, t in order:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    write_token_files(spark, docs, str(tmp_path / "t"), PATH, block_ids=40)
    back = read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("shard", "block", "place").collect()
    assert [(x.doc_id, x.n_tokens) for x in back] == [(w[0], w[2]) for w in want]
    assert back[0].ids[-1] == 2
    assert token_index(spark, docs.limit(0), PATH).count() == 0


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc(spark):
    trap = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nno length\r\n\r\n"
    pages = [(1, "u", "same"), (9, "u\r\nX: y", "same"), (4, None, "same"), (2, "u", trap), (3, "u", None), (5, "u", ""), (None, "u", "same"), (None, "u", "alone"), (6, "u", "é" * 30_000), (9, "u", "same"), (8, "u", "WARC/1.0\r\n")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, hex string, n int")
    for least in (0, 5):
        best = {}
        for i, _, h in pages:
            b = (h or "").encode()
            if len(b) >= least:
                best[b] = max(best.get(b, -1), -1 if i is None else i)
        want = []
        for i, _, h in pages:
            b = (h or "").encode()
            first = best.get(b, -1)
            again = first >= 0 and first != i
            want.append((i, len(b), digest(b), "revisit" if again else "response", first if again else None))
        assert rows(warc.archive(spark, df, least)) == sorted(want, key=repr)
    assert warc.archive(spark, df.limit(0)).count() == 0


def test_warc_shuffled_copies(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)
    df = spark.createDataFrame([(i, "u", f"p{i % 3}") for i in range(9)], "page_id long, url string, html string")
    assert {x.page_id: x.refers_to for x in warc.archive(spark, df).collect()} == {i: None if i > 5 else 6 + i % 3 for i in range(9)}


def test_warc_long_urls(spark, tmp_path):
    urls = {i: "http://x/" + ("a" * 100_000 if i in (3, 7) else str(i)) for i in range(12)}
    df = spark.createDataFrame([(i, u, f"page {i} WARC/1.0\r\nWARC/1.0\r\n") for i, u in urls.items()], "page_id long, url string, html string").coalesce(1)
    out = str(tmp_path / "files")
    assert sorted(x.page_id for x in warc.archive(spark, df, path=out).collect()) == list(urls)
    file = next((tmp_path / "files").glob("part-*"))
    (tmp_path / "cut").mkdir()
    for data in (file.read_bytes()[:-300], b"no record", b"x" + file.read_bytes()):
        (tmp_path / "cut" / "part-0").write_bytes(data)
        with pytest.raises(Exception, match="records of|no record"):
            warc.read_warc(spark, str(tmp_path / "cut")).collect()


def test_warc_files_roll_by_bytes(spark, tmp_path):
    big = "p" * 3_000_000
    df = spark.createDataFrame([(i, "u", big if i in (2, 5) else f"page {i}") for i in range(9)], "page_id long, url string, html string").coalesce(1)
    out = str(tmp_path / "files")
    warc.write_warc(df, out, file_bytes=1000)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "files").glob("part-*"))
    assert len(sizes) >= 5 and sum(x > 2000 for x in sizes) == 1  # the copy is a revisit
    assert {x.page_id: len(x.payload) for x in warc.read_warc(spark, out, with_payload=True).collect()} == {str(i): 3_000_000 if i == 5 else 0 if i == 2 else 6 for i in range(9)}


def foreign(gzipped):
    """An archive as others write it: a warcinfo record, 1.1, field names in other case, a request, a response, a resource."""
    def record(kind, name, body, uri=b"", more=b""):
        head = b"WARC/1.1\r\nwarc-type: " + kind + b"\r\nWarc-Record-Id: <urn:uuid:" + name + b">\r\nWARC-Target-URI: " + uri + b"\r\n" + more
        out = head + b"content-length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
        return gzip.compress(out) if gzipped else out

    trap = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    return record(b"warcinfo", b"1", b"software: other\r\n") + record(b"request", b"2", b"GET / HTTP/1.1\r\n\r\n", b"http://a/") + record(b"response", b"3", trap, b"http://a/") + record(
        b"resource", b"4", b"\x00\xff bytes", b"http://b/\xc3\xa9")


def test_warc_foreign(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(foreign(False))
    (tmp_path / "b.warc.gz").write_bytes(foreign(True))
    (tmp_path / "c.warc").write_bytes(foreign(False)[:-4])  # its last record lacks the end
    got = warc.read_warc(spark, str(tmp_path), with_payload=True).collect()
    assert len(got) == 12
    for end in ("a.warc", "b.warc.gz", "c.warc"):
        own = {x.record_id: x for x in got if x.file.endswith(end)}
        assert [own[f"<urn:uuid:{i}>"].record_type for i in (1, 2, 3, 4)] == ["warcinfo", "request", "response", "resource"]
        assert bytes(own["<urn:uuid:3>"].payload).startswith(b"<p>") and own["<urn:uuid:3>"].payload_digest == digest(bytes(own["<urn:uuid:3>"].payload))
        assert bytes(own["<urn:uuid:4>"].payload) == b"\x00\xff bytes" and own["<urn:uuid:4>"].target_uri == "http://b/é"
        assert all(x.page_id is None for x in own.values())


def test_reachable():
    r = random.Random(2)
    for _ in range(200):
        offsets = sorted(r.sample(range(1, 60), r.randint(0, 20)))
        offsets = np.array(([0] if r.random() < 0.8 else []) + offsets, np.int64)
        nexts = np.array([r.choice([*(o for o in offsets if o > x), x + 1]) for x in offsets], np.int64)
        met, at, after = set(), 0, dict(zip(offsets.tolist(), nexts.tolist(), strict=True))
        while at in after:
            met.add(at)
            at = after[at]
        assert [o for o, k in zip(offsets.tolist(), warc.reachable(offsets, nexts), strict=True) if k] == sorted(met)


def lzw(samples, min_code):
    """A plain dictionary encoder."""
    clear, end = 1 << min_code, (1 << min_code) + 1
    out, bits, have = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, have
        bits |= code << have
        have += width
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    table, width = {bytes((i,)): i for i in range(clear)}, min_code + 1
    put(clear, width)
    now, size = b"", end + 1
    for s in samples:
        more = now + bytes((s,))
        if more in table:
            now = more
            continue
        put(table[now], width)
        if size < 4096:
            table[more] = size
            size += 1
            if size - 1 == 1 << width and width < 12:
                width += 1
        else:
            put(clear, width)
            table, width, size = {bytes((i,)): i for i in range(clear)}, min_code + 1, end + 1
        now = bytes((s,))
    if now:
        put(table[now], width)
    put(end, width)
    if have:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("n", [1, 3, 254, 255, 1000, 30_000])
@pytest.mark.parametrize("kind", [1, 3, 200])
def test_lzw(n, kind):
    samples = np.random.default_rng(n).integers(0, kind, n).astype(np.uint8)
    assert (gif.lzw_decode(lzw(samples.tolist(), 8), 8, n) == samples).all()
    stream = gif.lzw_encode(samples.tobytes())
    assert (plain_lzw(stream, 8)[:n] == samples).all() and (gif.lzw_decode(stream, 8, n) == samples).all()
    assert kind > 3 or n < 1000 or len(stream) < n / 3  # runs are found


def plain_lzw(stream, min_code):
    """A plain dictionary decoder, bit by bit."""
    clear, out, at, width, table, before = 1 << min_code, [], 0, min_code + 1, {}, None
    bits = [byte >> k & 1 for byte in stream for k in range(8)]
    while at + width <= len(bits):
        code = sum(b << k for k, b in enumerate(bits[at : at + width]))
        at += width
        if code == clear:
            table, width, before = {i: [i] for i in range(clear)}, min_code + 1, None
            size = clear + 2
            continue
        if code == clear + 1:
            break
        now = table[code] if code in table else before + before[:1]
        out += now
        if before is not None and size < 4096:
            table[size] = before + now[:1]
            size += 1
            if size == 1 << width and width < 12:
                width += 1
        before = now
    return np.array(out)


def plain_gif(data):
    """Payload of a stored GIF by a second decoder: grey canvases, and whether frames are transparent, cropped or restored."""
    wide, high = struct.unpack_from("<HH", data, 6)
    at, canvas, out, seen = 13 + 768, np.zeros((high, wide), int), [], set()
    while data[at] != 0x3B:
        bits, _, clear = struct.unpack_from("<BHB", data, at + 3)
        left, top, w, h, _ = struct.unpack_from("<HHHHB", data, at + 9)
        at, stream = at + 19, b""
        while n := data[at]:
            stream += data[at + 1 : at + 1 + n]
            at += n + 1
        at += 1
        before, index = canvas.copy(), plain_lzw(stream, 8).reshape(h, w)
        mask = index != clear if bits & 1 else np.ones_like(index, bool)
        canvas[top : top + h, left : left + w][mask] = index[mask]
        out.append(canvas.astype(np.uint8).tobytes())
        seen |= {"clear"} if bits & 1 else set()
        seen |= {"cropped"} if h < high else set()
        if bits >> 2 & 7 == 3:
            canvas = before
            seen.add("restored")
    out[-1] = out[-1][: h * wide]
    return b"".join(out), seen


def test_stored_frames():
    r, kinds = np.random.default_rng(4), set()
    block = lambda: r.integers(32, 127, 64 * 192).astype(np.uint8)
    a, b, c = block(), block(), block()
    part = a.copy()
    part[5 * 192 : 9 * 192] = 65
    for chunks in ([a], [a, a, b], [a, part, a[: 192 * 7]], [a, b, a, b[:192]], [a, part, c], [np.arange(256).astype(np.uint8).repeat(48)] * 3):
        payload = b"".join(x.tobytes() for x in chunks)
        stored = gif.encode(payload)
        back, seen = plain_gif(stored)
        kinds |= seen
        assert back == payload == gif.read_payload(stored)[0]
    assert kinds == {"clear", "cropped", "restored"}


def picture(parts, wide, high, palette):
    head = b"GIF89a" + struct.pack("<HHBBB", wide, high, 0x81, 0, 0) + palette
    body = b""
    for box, index, disposal, clear, flags, local in parts:
        body += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), 7, clear or 0, 0)
        body += b"\x21\xfe\x03abc\0" + b"\x2c" + struct.pack("<HHHHB", *box, flags) + local + b"\x02" + gif.sub_blocks(lzw(index, 2))
    return head + body + b"\x3b"


def test_gif_frames():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    black, red, green, blue = ([0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255])
    parts = [
        ((0, 0, 2, 2), [1, 1, 1, 1], 1, None, 0, b""),
        ((0, 0, 2, 1), [0, 2], 3, 0, 0, b""),  # transparent first; restored after
        ((1, 1, 1, 1), [3], 2, None, 0, b""),  # cleared after
        ((0, 0, 1, 2), [1, 2], 0, None, 0x81, palette[3:] + b"\x09\x09\x09"),  # its own palette
    ]
    frames = list(gif.decode(picture(parts, 2, 2, palette)))
    assert [f.rgb.tolist() for f in frames] == [[[red, red], [red, red]], [[red, green], [red, red]], [[red, red], [red, blue]], [[green, red], [blue, black]]]
    assert [(f.at_ms, f.delay_ms) for f in frames] == [(0, 70), (70, 70), (140, 70), (210, 70)]
    assert frames[1].histogram(2).tolist() == [[1, 3], [3, 1], [4, 0]]
    rows_ = list(range(9))
    stored = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, 9, step)]
    laced = next(gif.decode(picture([((0, 0, 1, 9), [r % 3 for r in stored], 0, None, 0x40, b"")], 1, 9, palette)))
    assert [x[0] for x in laced.rgb.tolist()] == [[black, red, green][r % 3] for r in rows_]


def test_gif_column(spark):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    good = picture([((0, 0, 2, 1), [1, 2], 1, None, 0, b""), ((0, 0, 1, 1), [3], 2, None, 0, b"")], 2, 1, palette)
    bare = good[:10] + b"\1\0\0" + good[25:]  # no palette: grey
    files = [good, None, b"", b"PNG", bare, *(good[:n] for n in range(6, len(good))), good[:25] + b"\x99" + good[25:], gif.encode(b"a" * 192)[:-1], good[:6] + b"\xff\xff\xff\xff" + good[10:]]
    df = spark.createDataFrame([(i, f, "x") for i, f in enumerate(files)], "n int, gif binary, frames string")
    got = {x.n: x.gif for x in gif.gif_frames(df).collect()}
    assert got[0].error is None and [(f.at_ms, f.delay_ms, f.left, f.top, f.width, f.height) for f in got[0].frames] == [(0, 70, 0, 0, 2, 1), (70, 70, 0, 0, 1, 1)]
    assert got[0].frames[0].histogram == [1, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 1, 2, 0, 0, 0, 0, 0, 0, 0]
    assert got[1].error == got[2].error == got[3].error == "no GIF" and got[1].frames == []
    assert got[4].error is None and len(got[4].frames) == 2
    assert all(got[n].error for n in range(5, len(files))) and {len(got[n].frames) for n in range(5, len(files))} == {0, 1, 2}
    assert gif.gif_frames(df.limit(0)).count() == 0


def test_media(spark):
    pairs = [(1, None), (2, ""), (3, "é" * 96), (3, "é" * 96), (None, "x"), (5, "long \U0001f600 " * 20_000)]
    docs = spark.createDataFrame([(*p, 1) for p in pairs], "doc_id long, text string, feature int")
    got = gif.media_columns(spark, docs).collect()
    for (i, t), x in zip(sorted(pairs, key=repr), sorted(got, key=lambda x: repr((x.doc_id, next(t for j, t in pairs if j == x.doc_id)))), strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        assert (x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = gif.encode(payload)
        assert (x.media_bytes, x.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and plain_gif(stored)[0] == payload
        n, bins = -(-len(payload) // (64 * 192)), [sum(1 for b in payload if b // 32 == k) for k in range(8)]
        assert x.feature == f"frames={n};ms={40 * n};luma={sum(payload) / len(payload):.3f};hist={','.join(map(str, bins))}"
        assert [f.at_ms for f in x.frames] == [40 * k for k in range(n)] and all(sum(f.histogram) == 3 * 192 * min(64, len(payload) // 192) for f in x.frames)
    assert gif.media_columns(spark, docs.limit(0)).count() == 0
