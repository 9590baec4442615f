"""Token-ID binary output: Simple-8b blocks in files in ascending doc_id order, and their reader.

Texts are dealt by ranges of doc_id and sorted in them (nulls first, then by text), tokenised, and packed into blocks
of about `block_ids` ids. A word of 64 bits has a selector in its top 4 bits and as many ids as fit in the other 60; a
selector of 0 is an escape, whose id is the whole next word. Every document, and every SEGMENT ids of one, begin
with a new word. A block has the word offsets of these segments, so any can be decoded alone and all of them at once,
selector by selector.

Blocks go to files through Spark's own writer, so a lost task leaves no half files and any store Spark can write will do. A file is a sequence of blocks, each followed by TERMINATOR:
    magic 4s, shard u32, block u32, documents u32, ids u64, words u32, segments u32,
    doc_ids i64[documents], null flags u8[documents], id counts u32[documents], word offsets u32[segments], words u64[words]
Shards ascend with doc_id, blocks in a shard too.

Ids are the tokenizer's own. Pieces between white space are asked for one by one where its normalizer and pre-tokenizer
allow it, and kept in a table of bounded size (WordEncoder); tests hold this against the library.

A null text is empty: it has the end id alone. Null ids are kept by their flag; repeated ids are ordered by text. A long
text makes a long block, never a split one. An empty table makes no blocks and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP_SPACE, KEPT, LONG, Scratch, blocks_at, hash_words, slices, small_batches, tidy, word_blocks, word_bounds

MAGIC, TERMINATOR = b"QS8B", b"\n"
HEAD = "<4sIIIQII"
SEGMENT = 1024
#: Text that a task encodes, on average.
SHARD_BYTES = 16 << 20
#: Ids in a word and bits of each, by selector. Selector 0 is the escape.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}


@lru_cache(maxsize=1)
def _short_lengths() -> np.ndarray:
    return np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(len(ids), np.uint8), ids
    for shift in range(0, 64, 16):
        part = _short_lengths()[rest & np.uint64(0xFFFF)]
        out = np.where(part, part + np.uint8(shift), out)
        rest = rest >> np.uint64(16)
        if not rest.any():
            break
    return out


def segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the segments of documents with these id counts begin, and how many ids each has."""
    n = -(-counts // SEGMENT)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(np.cumsum(counts) - counts, n) + within * SEGMENT
    return starts, np.minimum(np.repeat(counts, n) - within * SEGMENT, SEGMENT)


def pack(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids: uint64 of all documents of a block; counts: ids of each. The words, and each segment's first word."""
    n = len(ids)
    starts, sizes = segments(counts)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, "<u4")
    width = bit_lengths(ids)
    # The most ids that a word starting at each place can hold.
    choice = np.zeros(n, np.uint8)
    widest, reach = width.copy(), 1
    for sel in sorted(SELECTORS, reverse=True):
        count, bits = SELECTORS[sel]
        while reach < count:
            step = min(reach, count - reach)
            grown = np.zeros(n, np.uint8)
            grown[: n - step] = widest[step:] if step < n else 0
            widest, reach = np.maximum(widest, grown), reach + step
        choice[widest <= bits] = sel
    held = np.array([1] + [SELECTORS[s][0] for s in range(1, 15)])
    jump = np.arange(n) + held[choice]
    # All segments are walked at once, a word a step.
    at, here, stop = [], starts, starts + sizes
    while len(here):
        at.append(here)
        here = jump[here]
        on = here < stop
        here, stop = here[on], stop[on]
    at = np.sort(np.concatenate(at))
    ends = (starts + sizes)[np.searchsorted(starts, at, side="right") - 1]
    sel = choice[at]
    slot = np.cumsum(1 + (sel == 0)) - 1 - (sel == 0)  # an escape takes two words
    words = np.zeros(len(at) + int((sel == 0).sum()), "<u8")
    for s, (count, bits) in SELECTORS.items():
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        word = np.full(len(own), np.uint64(s) << np.uint64(60))
        first, end = at[own], ends[own]
        for k in range(count):
            inside = first + k < end
            if not inside.any():
                break
            word |= np.where(inside, ids[np.minimum(first + k, n - 1)] << np.uint64(k * bits), np.uint64(0))
        words[slot[own]] = word
    escaped = np.flatnonzero(sel == 0)
    words[slot[escaped] + 1] = ids[at[escaped]]
    return words, slot[np.searchsorted(at, starts)].astype("<u4")


def unpack(words: np.ndarray, first_word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of all documents of a block, one after the other."""
    starts, sizes = segments(counts)
    out = np.zeros(int(counts.sum()), np.uint64)
    if not len(out):
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0):  # what follows an escape is no word, unless the escape is none itself
        if not raw[i]:
            raw[i + 1] = True
    held = np.array([1] + [SELECTORS[s][0] for s in range(1, 15)] + [0])
    holds = np.where(raw, 0, held[sel])
    begin = np.cumsum(holds) - holds
    own = np.searchsorted(first_word, np.arange(len(words)), side="right") - 1
    at = begin - begin[first_word[own]] + starts[own]
    end = starts[own] + sizes[own]
    for s, (count, bits) in SELECTORS.items():
        mine = np.flatnonzero((sel == s) & ~raw)
        for k in range(count):
            mine = mine[at[mine] + k < end[mine]]
            if not len(mine):
                break
            out[at[mine] + k] = (words[mine] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    escaped = np.flatnonzero((sel == 0) & ~raw)
    out[at[escaped]] = words[escaped + 1]
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start[i] .. start[i] + size[i] - 1, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class WordTable:
    """Ids of words of LONG bytes at most, in arrays: an open hash table in which many words are looked up at once. A hash
    only says where to look; words are compared byte by byte. Entry 0 is the end id. It is full when it holds `most` words,
    or `room` ids or blocks of 8 bytes."""

    def __init__(self, kind: np.dtype, end: bytes, bits: int, room: int = 1 << 23):
        self.kind, self.bits, self.most, self.room = kind, bits, (1 << bits) // 2, room
        self.slots = np.full(1 << bits, -1, np.int32)
        self.arrays = {"h": np.zeros(1024, np.uint64), "length": np.zeros(1024, np.int64), "block": np.zeros(1024, np.int64), "begin": np.zeros(1024, np.int64), "size": np.zeros(1024, np.int64)}
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.blocks, self.held, self.n = np.zeros(1 << 16, np.uint64), 0, 0
        self.append(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint64), [end])

    def full(self, words: int) -> bool:
        return self.n + words > self.most or max(self.used, self.held) > self.room

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))

    def append(self, h: np.ndarray, length: np.ndarray, blocks: np.ndarray, ids: list[bytes]) -> None:
        """Entries that no slot leads to yet; blocks: those of all the words, one word after the other."""
        n, new = self.n, len(h)
        size = np.array([len(i) for i in ids], np.int64) // self.kind.itemsize
        count = -(-length // 8)
        values = {"h": h, "length": length, "block": self.held + np.cumsum(count) - count, "begin": self.used + np.cumsum(size) - size, "size": size}
        for name, v in values.items():
            self.arrays[name] = self._grown(self.arrays[name], n + new)
            self.arrays[name][n : n + new] = v
        used, held = self.used + int(size.sum()), self.held + len(blocks)
        self.flat, self.blocks = self._grown(self.flat, used), self._grown(self.blocks, held)
        self.flat[self.used : used] = np.frombuffer(b"".join(ids), self.kind)
        self.blocks[self.held : held] = blocks
        self.used, self.held, self.n = used, held, n + new

    def _same(self, entry: np.ndarray, h: np.ndarray, start: np.ndarray, length: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Which entries hold the words at these places of a text's blocks."""
        own = self.arrays
        same = (own["h"][entry] == h) & (own["length"][entry] == length)
        live = np.flatnonzero(same & (length > 0))
        at, left, mine = start[live], length[live], own["block"][entry[live]]
        while len(live):
            equal = self.blocks[mine] == blocks_at(blocks, at, left)
            same[live[~equal]] = False
            on = equal & (left > 8)
            live, at, left, mine = live[on], at[on] + 8, left[on] - 8, mine[on] + 1
        return same

    def find(self, h: np.ndarray, start: np.ndarray, length: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Entry of each word; -1: none."""
        mask = (1 << self.bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        entry = self.slots[slot].astype(np.int64)
        open_ = np.flatnonzero(entry >= 0)
        while len(open_):
            e = entry[open_]
            open_ = open_[~self._same(e, h[open_], start[open_], length[open_], blocks)]
            slot[open_] = (slot[open_] + 1) & mask
            entry[open_] = self.slots[slot[open_]]
            open_ = open_[entry[open_] >= 0]
        return entry

    def place(self, first: int) -> None:
        """Slots for the entries from the first one on, which are new words, each once."""
        mask = (1 << self.bits) - 1
        left = np.arange(first, self.n)
        slot = (self.arrays["h"][left] & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of words that meet in a free slot, one gets it and the others walk on
            on = self.slots[slot] != left
            left, slot = left[on], (slot[on] + 1) & mask

    def cut(self, n: int, used: int, held: int) -> None:
        """Forgets entries that got no slot."""
        self.n, self.used, self.held = n, used, held

    def ids(self, entries: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.arrays["begin"][entries], self.arrays["size"][entries])]


class WordEncoder:
    """Ids of texts by pieces between ASCII white space, remembered.

    A tokenizer may be asked piece by piece if its normalizer and its pre-tokenizer don't look over white space. That holds
    for the steps named in LOCAL, which is checked; others get whole texts. Pieces are encoded by the tokenizer as they
    are; only ASCII ones are lower-cased first if the normalizer does so, as their table is then smaller. Texts in which an
    added token is written, in whatever case, go to the tokenizer whole.
    """

    #: Steps of normalizers that act within a piece.
    LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "Replace"}

    def __init__(self, path: str, end_id: int, bits: int = 22):
        self.model = _tokenizer(path)
        size = max(self.model.get_vocab_size(), end_id + 1)
        self.kind = np.dtype("<u2" if size <= 65536 else "<u4")
        self.end, self.bits = np.array([end_id], self.kind).tobytes(), bits
        self.table = WordTable(self.kind, self.end, bits)
        made = json.loads(self.model.to_str())
        steps = lambda x, inner: [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
        normal, split = steps(made["normalizer"], "normalizers"), steps(made["pre_tokenizer"], "pretokenizers")
        spaces = [n for n in normal if n["type"] == "Replace"]
        cuts = bool(split) and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed" and split[0]["invert"] and self._drops_space()
        self.by_piece = cuts and {n["type"] for n in normal} <= self.LOCAL and all(n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in spaces)
        self.lower = any(n["type"] == "Lowercase" for n in normal)
        # Tokens that end a word, if the vocabulary marks them; signs that end a piece of letters and are none of it.
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for token, i in self.model.get_vocab().items() if token.endswith(suffix)]] = True
        pieces = lambda t: [p for p, _ in self.model.pre_tokenizer.pre_tokenize_str(t)]
        apart = [c for c in ".,;:!?" if pieces(f"ab{c}") == [*pieces("ab"), *pieces(c)]] if self.by_piece else []
        self.signs = dict(zip([c.encode() for c in apart], self._each([c.encode() for c in apart]), strict=True))
        self.added = [t["content"].encode().lower() for t in made["added_tokens"]]

    def _drops_space(self) -> bool:
        """Whether a piece of the pre-tokenizer ends at each ASCII white space."""
        probe = [a + s + b for s in " \t\n\x0b\x0c\r" for a in ("a", "1", ".", "'", "é") for b in ("a", "1", ".", "'s", "é")]
        return all([p for p, _ in self.model.pre_tokenizer.pre_tokenize_str(t)] == [p for x in t.split() for p, _ in self.model.pre_tokenizer.pre_tokenize_str(x)] for t in probe)

    def _each(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 2000):
            out += [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast([t.decode() for t in texts[i : i + 2000]], add_special_tokens=False)]
        return out

    def _learned(self, words: list[bytes]) -> list[bytes]:
        """Ids of pieces. Those of letters alone, but for a sign at the end that makes a piece of its own, go many to a text."""
        bare: dict[bytes, bytes] = {}
        other: dict[bytes, bytes] = {}
        cut = []
        for w in words:
            sign = w[-1:] if w[-1:] in self.signs else b""
            stem = w[:-1] if sign else w
            if stem.isalpha() if stem.isascii() else stem.decode().isalpha():
                bare[stem] = b""
                cut.append((stem, sign))
            else:
                other[w] = b""
                cut.append((w, b""))
        other.update(zip(other, self._each(list(other)), strict=True))
        stems = list(bare)
        groups = [stems[i : i + 500] for i in range(0, len(stems), 500)]
        for own, e in zip(groups, self.model.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
            if len(ends) == len(own):  # each word has one at least, so one each
                raw, ends = ids.tobytes(), [0, *ends.tolist()]
                bare.update((w, raw[x:y]) for w, x, y in zip(own, ends, ends[1:]))
            else:
                bare.update(zip(own, self._each(own), strict=True))
        return [(bare[w] + self.signs.get(sign, b"")) if w in bare else other[w] for w, sign in cut]

    def _whole(self, text: bytes) -> bool:
        low = text.lower()
        return not self.by_piece or any(t in low for t in self.added)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (in UTF-8), each with the end id behind it, and the number of ids of each."""
        raw = [t or b"" for t in texts]
        whole = [i for i, t in enumerate(raw) if t and self._whole(t)]
        if not whole:
            return self._by_piece(raw)
        parts = dict(zip(whole, self._each([raw[i] for i in whole]), strict=True))
        ids, counts = self._by_piece([b"" if i in parts else t for i, t in enumerate(raw)])
        cut = np.split(ids, np.cumsum(counts)[:-1])
        cut = [np.frombuffer(parts[i] + self.end, self.kind) if i in parts else c for i, c in enumerate(cut)]
        return np.concatenate(cut), np.array([len(c) for c in cut])

    def _by_piece(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        begins = np.cumsum([0, *(len(t) + 1 for t in raw)])
        data = b" ".join([*raw, b""])
        if self.lower:
            data = self._lowered(data)
        h, start, stop = hash_words(data, GAP_SPACE)
        length, blocks, table = stop - start, word_blocks(data), self.table
        entry = np.where(length <= LONG, table.find(h, start, length, blocks), -1)
        miss = np.flatnonzero(entry < 0)
        if len(miss) and table.full(len(miss)):
            table = self.table = WordTable(self.kind, self.end, max(self.bits, (4 * len(h)).bit_length()))
            entry[:] = -1
            miss = np.arange(len(h))
        if len(miss):
            numbers: dict[bytes, int] = {}
            which = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(start[miss].tolist(), stop[miss].tolist(), strict=True)], np.int64)
            first = miss[np.unique(which, return_index=True)[1]]
            ids = self._learned(list(numbers))
            short, long = np.flatnonzero(length[first] <= LONG), np.flatnonzero(length[first] > LONG)
            place, n = np.empty(len(first), np.int64), table.n
            place[short], place[long] = n + np.arange(len(short)), n + len(short) + np.arange(len(long))
            at, size = first[short], length[first[short]]
            count = -(-size // 8)
            offset = 8 * ranges(np.zeros(len(at), np.int64), count)
            own = blocks_at(blocks, np.repeat(start[at], count) + offset, np.repeat(size, count) - offset)
            table.append(h[at], size, own, [ids[i] for i in short.tolist()])
            table.place(n)
        mark = table.n, table.used, table.held
        if len(miss):
            table.append(h[first[long]], np.zeros(len(long), np.int64), own[:0], [ids[i] for i in long.tolist()])
            entry[miss] = place[which]
        after = np.searchsorted(start, begins[1:])  # each text's end comes before the first word of the next
        entry = np.insert(entry, after, 0)
        upto = np.concatenate(([0], np.cumsum(table.arrays["size"][entry])))
        bounds = upto[after + np.arange(1, len(after) + 1)]
        out = table.ids(entry)
        table.cut(*mark)
        return out, np.diff(np.concatenate(([0], bounds)))

    @staticmethod
    def _lowered(data: bytes) -> bytes:
        """data with its ASCII words in lower case."""
        b = np.frombuffer(data, np.uint8)
        if data.isascii():
            return data.lower()
        start, stop = word_bounds(data, GAP_SPACE)
        upto = np.concatenate(([0], np.cumsum(b >= 128)))
        other = np.flatnonzero(upto[stop] > upto[start])
        out = np.frombuffer(data.lower(), np.uint8).copy()
        at = ranges(start[other], stop[other] - start[other])
        out[at] = b[at]
        return out.tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> WordEncoder:
    """One for all tasks of a Python worker that encode."""
    return WordEncoder(path, end_id)


def _drop_encoder() -> None:
    _encoder.cache_clear()
    _tokenizer.cache_clear()


KEPT["encoder"] = _drop_encoder


def _encoded(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path, end_id)
        shard, block = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ids: list = []

        def flush():
            nonlocal block, parts, counts, ids
            n = np.concatenate(counts)
            words, offsets = pack(np.concatenate(parts).astype(np.uint64), n)
            null = pd.isna(pd.Series(ids, dtype=object)).to_numpy()
            body = struct.pack(HEAD, MAGIC, shard, block, len(n), int(n.sum()), len(words), len(offsets))
            body += np.array([0 if z else int(i) for i, z in zip(ids, null, strict=True)], "<i8").tobytes() + null.astype(np.uint8).tobytes()
            body += n.astype("<u4").tobytes() + offsets.tobytes() + words.tobytes()
            block, parts, counts, ids = block + 1, [], [], []
            return pd.DataFrame({"block": [body]})

        for pdf in batches:
            texts, names = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for own in slices(texts):
                e, n = enc.encode(texts[own])
                parts.append(e)
                counts.append(n)
                ids += names[own]
                if sum(map(len, parts)) >= block_ids:
                    yield flush()
        if parts:
            yield flush()

    return tidy(run, keep="encoder")


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 500_000) -> None:
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    keys = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    # the ids go to pandas as objects: a column with nulls would become floats
    blocks = keys.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(_encoded(tokenizer, end_id, block_ids), "block binary")
    (blocks.select(F.col("block").cast("string").alias("value")).write.mode("overwrite")
     .option("lineSep", TERMINATOR.decode()).option("maxRecordsPerFile", 16).text(path))


def blocks_of(data: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """shard, block, doc_ids, id counts and ids of each block of a file."""
    at = 0
    while at < len(data):
        magic, shard, block, docs, n, words, parts = struct.unpack_from(HEAD, data, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += struct.calcsize(HEAD)
        arrays = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", parts), ("<u8", words)):
            arrays.append(np.frombuffer(data, kind, count, at))
            at += arrays[-1].nbytes
        doc_ids, null, counts, offsets, packed = arrays
        ids = unpack(packed, offsets.astype(np.int64), counts.astype(np.int64))
        if len(ids) != n or data[at : at + 1] != TERMINATOR:
            raise ValueError(f"broken block before byte {at}")
        at += 1
        yield shard, block, [None if z else int(i) for i, z in zip(doc_ids, null, strict=True)], counts.astype(np.int64), ids


def _decoded(with_ids: bool):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                for shard, block, doc_ids, counts, ids in blocks_of(data):
                    raw = ids.astype("<u4").tobytes()
                    ends = np.cumsum(counts) * 4
                    cut = [raw[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                    out = pd.DataFrame({
                        "shard": shard, "block": block, "place": range(len(counts)), "doc_id": pd.array(doc_ids, dtype="Int64"),
                        "n_tokens": counts, "ids_crc32": [zlib.crc32(c) for c in cut],
                    })
                    if with_ids:
                        out["ids"] = [np.frombuffer(c, "<u4").astype(np.int64).tolist() for c in cut]
                    yield out

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document: shard, block, place, doc_id, n_tokens, ids_crc32, and its ids if asked for."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("content")
    schema = "shard long, block long, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.mapInPandas(_decoded(with_ids), schema)


def token_index(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files and reads them back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    scratch = Scratch(spark, "tokens")
    path = path or f"{scratch.path}/files"
    write_token_files(spark, docs, path, tokenizer, end_id)
    rows = scratch.stash(read_token_files(spark, path), "index")
    # Starts by prefix sums in three levels, so no task sums more than a few thousand rows at any size: within a
    # shard, over the shards of a span of 2048, over spans.
    span = F.floor(F.col("shard") / 2048)
    upto = lambda part, order: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("span", span)
    spans = shards.groupBy("span").agg(F.sum("n").alias("n"))
    spans = spans.select("span", zero(F.sum("n").over(upto([F.lit(0)], ["span"]))).alias("before_span"))
    shards = shards.select("shard", "span", zero(F.sum("n").over(upto(["span"], ["shard"]))).alias("before_shard")).join(spans, "span")
    within = rows.withColumn("before", zero(F.sum("n_tokens").over(upto(["shard"], ["block", "place"]))))
    return within.join(shards, "shard").select(
        "doc_id", (F.col("before") + F.col("before_shard") + F.col("before_span")).cast("long").alias("start"), "n_tokens", "ids_crc32",
    )
