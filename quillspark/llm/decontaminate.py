"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of documents of about `shard_words` words in one task. Its words become symbols: those of the benchmark
their number, all others (and the ends of documents) 0. A 0 occurs in no phrase, so each counts as a terminator of its
own, ordered by place; suffixes are sorted completely up to their terminator. The last column is kept in a wavelet
matrix of bit words with counts every 64 bits; phrases are searched backwards, all at once, two ranks a step; places
are found by walking to sampled suffix positions (every `SAMPLE`-th place and those after a terminator). Spans of
occurrences are merged for each document.

The phrases (windows of `window` consecutive words of an item, or the whole of a shorter item) are read from the
benchmark in blocks of about `block_words` words, which bounds what the driver holds and what is broadcast: two blocks at a
time. With more than one block each goes over all documents, and spans are merged by document afterwards.

Null or empty texts have no words, null or empty items no windows. A null item_id reads "null". Items that repeat, or
share windows, each count. Rows of documents are handled alone: repeated rows and null ids stay as they are. A text
longer than a shard is a shard. Extra columns stay outside. An empty benchmark or table is searched without result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, ROW, Scratch, alnum_array, alnum_words, drop_kept, give_back, join_rows, small_batches, tidy, with_row_key

SAMPLE = 8
SCHEMA = "doc_id string, text string, n_words long, spans array<array<long>>, items array<string>"


class BitRank:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(np.concatenate((bits, np.zeros(64 - len(bits) % 64, bool))), bitorder="little")
        self.words = raw.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)))[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks and access over symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            zeros = int(len(bits) - bits.sum())
            self.levels.append((level, BitRank(bits), zeros))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        # where the block of each symbol begins after the last level
        self.begin = np.full(1 << levels, len(symbols), np.int64)
        first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1]))) if len(symbols) else []
        self.begin[symbols[first]] = first

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        for level, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(symbols >> level & 1, zeros + ones, i - ones)
        return i - self.begin[symbols]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for level, bits, zeros in self.levels:
            set_, ones = bits.at(i), bits.ones(i)
            symbol |= set_.astype(np.int64) << level
            i = np.where(set_, zeros + ones, i - ones)
        return symbol, i - self.begin[symbol]


def sorted_suffixes(text: np.ndarray, levels: int) -> np.ndarray:
    """Suffix array of symbols in which every 0 is a terminator of its own, smaller than all else, ordered by place."""
    n, depth = len(text), max(1, min(len(text), 62 // levels))
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for k in range(depth):
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = text[k:]
        alive &= ahead > 0
        key = key << levels | np.where(alive, ahead, 0)
    order = np.argsort(key, kind="stable")
    # Equal keys that meet a terminator are in place order, and so final; the others are refined by doubling.
    open_ = np.zeros(n, bool)
    same = (key[order][1:] == key[order][:-1]) & alive[order][1:]
    open_[1:] |= same
    open_[:-1] |= same
    rank = np.empty(n, np.int64)
    head = np.concatenate(([True], ~same)) if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    places, h = np.flatnonzero(open_), depth
    while len(places):
        rows = order[places]
        second = rank[np.minimum(rows + h, n - 1)]
        by = np.lexsort((rows, second, rank[rows]))
        rows = rows[by]
        order[places] = rows
        first, second = rank[rows], second[by]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        head = np.concatenate(([True], ~same))
        rank[rows] = np.maximum.accumulate(np.where(head, places, 0))
        tied = np.zeros(len(places), bool)
        tied[1:] |= same
        tied[:-1] |= same
        places, h = places[tied], 2 * h
    return order


class ShardIndex:
    """FM-index of a shard; text must end with a 0."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        levels = max(1, int(n_symbols).bit_length())
        order = sorted_suffixes(text, levels)
        last = text[order - 1]  # the first suffix wraps to the final terminator
        self.wavelet = WaveletMatrix(last, levels)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))
        marked = (order % SAMPLE == 0) | (last == 0)
        self.marked, self.sampled = BitRank(marked), order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: right-aligned rows of symbols. The range of suffixes of each; empty where from >= to."""
        lo, hi = self.starts[phrases[:, -1]], self.starts[phrases[:, -1] + 1]
        lo, hi = lo.copy(), hi.copy()
        for k in range(2, phrases.shape[1] + 1):
            live = np.flatnonzero((lo < hi) & (lengths >= k))
            if not len(live):
                break
            c = phrases[live, -k]
            both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((lo[live], hi[live])))
            lo[live], hi[live] = self.starts[c] + both[: len(live)], self.starts[c] + both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walking, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(walking):
            done = self.marked.at(rows)
            out[walking[done]] = self.sampled[self.marked.ones(rows[done])] + steps
            walking, rows = walking[~done], rows[~done]
            symbol, rank = self.wavelet.access_rank(rows)
            rows, steps = self.starts[symbol] + rank, steps + 1
        return out


class Phrases:
    """Distinct windows of a block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.rows = np.zeros((len(windows), window), np.int64)
        for i, w in enumerate(windows):
            self.rows[i, window - len(w) :] = w
        self.names = sorted({x for s in windows.values() for x in s})
        at = {x: i for i, x in enumerate(self.names)}
        self.owners = np.array([at[x] for s in windows.values() for x in s], np.int64)
        self.first_owner = np.concatenate(([0], np.cumsum([len(s) for s in windows.values()]))).astype(np.int64)


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All of start[i] .. stop[i] - 1, one after the other."""
    n = stop - start
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch, merged."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(stop[by])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))]


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[list[int]], list[str]]]:
    """n_words, merged spans of words and items (sorted) of each text."""
    known = phrases.vocabulary.get
    symbols, counts = [], []
    for t in texts:
        words = alnum_words(t)
        symbols.append(np.fromiter(map(known, words, repeat(0)), np.int64, len(words)))
        symbols.append(np.zeros(1, np.int64))  # ends the document
        counts.append(len(words))
    out = [(n, [], []) for n in counts]
    if not len(phrases.rows) or not sum(counts):
        return out
    text = np.concatenate(symbols)
    begins = np.cumsum(np.array(counts) + 1) - np.array(counts) - 1
    index = ShardIndex(text, len(phrases.vocabulary))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    hit = np.flatnonzero(lo < hi)
    if not len(hit):
        return out
    places = index.locate(ranges(lo[hit], hi[hit]))
    window = np.repeat(hit, hi[hit] - lo[hit])
    starts, stops = merged(places, places + phrases.lengths[window])
    doc = np.searchsorted(begins, starts, side="right") - 1
    for d, a, b in zip(doc.tolist(), (starts - begins[doc]).tolist(), (stops - begins[doc]).tolist(), strict=True):
        out[d][1].append([a, b])
    doc = np.searchsorted(begins, places, side="right") - 1
    pair = np.unique(doc * len(phrases.lengths) + window)
    doc, window = np.divmod(pair, len(phrases.lengths))
    first, stop = phrases.first_owner[window], phrases.first_owner[window + 1]
    owner = np.unique(np.repeat(doc, stop - first) * len(phrases.names) + phrases.owners[ranges(first, stop)])
    for d, o in zip(*(x.tolist() for x in np.divmod(owner, len(phrases.names))), strict=True):
        out[d][2].append(phrases.names[o])
    return out


def _searcher(broadcast, shard_words: int, keep_text: bool):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = broadcast.value
        held: list[pd.DataFrame] = []
        size = 0

        def flush():
            pdf = pd.concat(held, ignore_index=True)
            found = search_shard(pdf["text"].tolist(), phrases)
            return pd.DataFrame({
                "doc_id": pdf["doc_id"], "text": pdf["text"] if keep_text else None, "n_words": [f[0] for f in found],
                "spans": [f[1] for f in found], "items": [f[2] for f in found],
            })

        for pdf in batches:
            held.append(pdf)
            size += int(pdf["text"].str.len().fillna(0).sum()) // 6
            if size >= shard_words:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _merge_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    spans = [s for row in pdf["spans"] for s in row]
    if spans:
        a, b = merged(*np.array([list(s) for s in spans], np.int64).T)
        spans = np.stack((a, b), 1).tolist()
    items = sorted({x for row in pdf["items"] for x in row})
    return pd.concat((pdf[ROW].iloc[:1].reset_index(drop=True), pd.DataFrame({"spans": [spans], "items": [items]})), axis=1)


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append(("null" if r["item_id"] is None else str(r["item_id"]), r["text"]))
        size += len(r["text"] or "") // 6
        if size >= block_words:
            yield Phrases(rows, window)
            rows, size = [], 0
    if rows:
        yield Phrases(rows, window)


def two_at_most(made: Iterator[Phrases]) -> tuple[Phrases, Iterator[Phrases]]:
    """The first block, and the first again with the others if there are any."""
    first = next(made, None)
    if first is None:
        return Phrases([], 1), iter(())
    second = next(made, None)
    return first, iter(()) if second is None else chain([first, second], made)


def find_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 600_000, block_words: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_words, spans (merged; first word, and the one after the last) and items (sorted as strings) for each row
    of docs."""
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    first, others = two_at_most(blocks(benchmark, window, block_words))
    search = lambda p, keep: docs.mapInPandas(_searcher(spark.sparkContext.broadcast(p), shard_words, keep), SCHEMA)
    out, scratch, hits = None, Scratch(spark, "leaks"), None
    for i, phrases in enumerate(others):
        # One block after the other: only rows with hits are written, a few spans and items each.
        shared = spark.sparkContext.broadcast(phrases)
        found = with_row_key(docs.mapInPandas(_searcher(shared, shard_words, True), SCHEMA))
        own = scratch.stash(found.filter(F.size("spans") > 0).select(*ROW, "spans", "items"), f"block-{i}")
        hits = own if hits is None else hits.unionByName(own)
        shared.destroy()
    if hits is None:
        out = search(first, False)
    else:
        hits = hits.groupBy(*ROW).applyInPandas(_merge_blocks, f"{ROW[0]} string, {ROW[1]} long, {ROW[2]} long, spans array<array<long>>, items array<string>")
        words = with_row_key(docs).select("doc_id", *ROW, F.size(alnum_array(F.col("text"))).cast("long").alias("n_words"))
        out = join_rows(words, hits, "left").withColumns({
            "spans": F.coalesce("spans", F.array().cast("array<array<long>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "spans", "items")


def leak_report(found: DataFrame) -> DataFrame:
    """Counts and digest of what find_leaks returns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window; an index for each Arrow batch."""
    small_batches(spark)
    first, others = two_at_most(blocks(benchmark, window, block_words))
    scratch, i = Scratch(spark, "clean"), -1
    for i, phrases in enumerate(others):  # what a block leaves is written before the next one
        shared = spark.sparkContext.broadcast(phrases)
        docs = scratch.stash(docs.filter(~_holds(shared)("text")), f"block-{i}")
        shared.destroy()
        if i:
            scratch.drop(f"block-{i - 1}")
    return docs if i >= 0 else docs.filter(~_holds(spark.sparkContext.broadcast(first))("text"))


def _holds(shared):
    def search(parts):
        drop_kept()
        for texts in parts:
            yield pd.Series([bool(spans) for _, spans, _ in search_shard(texts.tolist(), shared.value)], dtype=bool)
        give_back()

    search.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(search, "boolean")


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them; the rest is as it was."""
    raw = text.encode()
    b = np.frombuffer(raw.translate(ALNUM_BYTES), np.uint8) != 32
    step = np.diff(np.concatenate(([0], b.view(np.int8), [0])))
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out, at = [], 0
    for a, z in spans:
        out.append(raw[at : start[a]])
        at = int(stop[z - 1])
    return b"".join([*out, raw[at:]]).decode()
