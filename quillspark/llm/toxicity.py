"""Toxicity by class-conditional Kneser-Ney models: word pairs, backed off to words, backed off to shared counts.

For each class c (toxic or not), over its labelled documents:
    P_c(w | v) = (n_c(v w) - D + d_c(v) P_c(w)) / c_c(v)        n_c: documents that hold the pair; c_c: their sum over w
    P_c(w) = (k_c(w) - D' + e_c P(w)) / K_c                     k_c: distinct words before w (continuation count), K_c: their sum
    P(w) = (n(w) + 1/2) / (N + V / 2)                           n: documents of the whole corpus that hold w, labelled or not
D and D' are the discounts below, by count, d_c(v) and e_c what they leave over: so each is a distribution. A rare
expression leans on its words, and a rare word on counts that the classes share and that favour neither.
A document's length-normalised log-likelihoods under both classes are compared at both orders: the difference a word. As a
document is mostly ordinary prose around a few expressions, the largest difference of a place and the logarithm of the sum
of differences beyond LARGE are compared too. A logistic fit over these six numbers and the logarithm of the length gives the score.

Counting: a task counts words, contexts and pairs of its documents and sends merged rows; pairs are summed by a shuffle,
which gives continuation counts and the pairs that go on. Places where the models can differ from their back-off need few
entries: pairs of n_c of 3 or more and their contexts (smaller counts are discounted whole), their words and those with
k_c of 2 or more. The
tables grow with the corpus. Their most frequent entries, as many as MAX_HOT says, are broadcast; what is beyond them is
looked up by shuffle: documents send the places where a filter says that other entries may be, and get sums and maxima back
by the hash of their text. The result is that of one table.

Labels are read from rows whose crc32(doc_id as text) mod 4 is not 2. All labelled rows of remainders 0 and 1 are counted;
their ids are broadcast if they are MAX_LABELS at most, else joined by shuffle (ids that are no integers by 64-bit hash).
The logistic function, of eight parameters, is fitted on remainder 3, of each class on at most `max_rows` rows picked by a
seeded hash; each row weighs as many as it was picked from, so the ratio of the classes is that of all labels.

A null or empty text has score 0. Rows with null doc_id are scored and counted but can't be labelled; several labels of
a document count as toxic if one does; null labels are none. With no toxic or no other label to learn from, every score
is 0. Equal texts get equal scores. Very long texts are counted whole. Extra columns stay as they are; one that has the
name of a result gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import ALNUM_BYTES, GAP_32, Bloom, Scratch, batch_rows, drop_kept, gathered, give_back, hash_words, joined, slices, small_batches, tidy, xxhash_longs

#: Discounts of counts of 1, 2, and 3 or more.
WORD_DISCOUNTS, PAIR_DISCOUNTS = (1.0, 1.3, 1.5), (1.0, 2.0, 1.5)
#: What is larger than this, as the logarithm of a ratio, counts as large.
LARGE = 2.0
#: Entries that may be broadcast: words of 24 bytes, contexts of 24, pairs of 16.
MAX_HOT = {"word": 1_000_000, "context": 1_000_000, "pair": 2_000_000}
#: Labelled ids of 9 bytes that may be broadcast.
MAX_LABELS = 4_000_000
#: Rows of counts that a task holds before it merges or sends them.
MAX_HELD = 1_000_000
WORD, PAIR, CONTINUED = 0, 1, 2
COUNTS = "kind int, left long, word long, n long, n0 long, n1 long"
#: The context of a text's first word.
BEGIN = 0x5DEECE66D
#: Sums of what is looked up by shuffle are exact, so their order doesn't matter.
UNIT = float(1 << 32)
FEATURES = 7


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the one before it, and the text that it stands in."""
    data, begins = joined(texts, ALNUM_BYTES)
    h, start, _ = hash_words(data, GAP_32)
    word, doc = h.view(np.int64), np.searchsorted(begins, start, side="right") - 1
    left = np.roll(word, 1)
    left[np.concatenate(([True], doc[1:] != doc[:-1]))[: len(doc)]] = BEGIN
    return word, left, doc


def _summed(kind: int, left: np.ndarray, word: np.ndarray, **counts: np.ndarray) -> pd.DataFrame:
    """Rows of COUNTS, equal keys added up."""
    order = np.lexsort((word, left))
    left, word = left[order], word[order]
    first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (word[1:] != word[:-1])))) if len(word) else np.empty(0, np.int64)
    out = pd.DataFrame({"kind": np.full(len(first), kind, np.int32), "left": left[first], "word": word[first]})
    for c in ("n", "n0", "n1"):
        out[c] = np.add.reduceat(counts[c][order].astype(np.int64), first) if c in counts and len(first) else np.zeros(len(first), np.int64)
    return out


def _distinct(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The first place of each key in each document."""
    order = np.lexsort((*keys, doc))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (doc, *keys):
        new[1:] |= x[order][1:] != x[order][:-1]
    return order[new]


def _tally(word: np.ndarray, left: np.ndarray, doc: np.ndarray, label: np.ndarray) -> list[pd.DataFrame]:
    """Of some texts: documents by word; by context and class, how many pairs documents hold; documents by pair and class."""
    one = _distinct(doc, word)
    zero = np.zeros(len(one), np.int64)
    mine = np.flatnonzero(label[doc] >= 0)
    pair = mine[_distinct(doc[mine], left[mine], word[mine])]
    own = label[doc[pair]]
    n0, n1, none = (own == 0).astype(np.int64), (own == 1).astype(np.int64), np.zeros(len(pair), np.int64)
    words = _summed(
        WORD, np.zeros(len(one) + len(pair), np.int64), np.concatenate((word[one], left[pair])),
        n=np.concatenate((zero + 1, none)), n0=np.concatenate((zero, n0)), n1=np.concatenate((zero, n1)))
    return [words, _summed(PAIR, left[pair], word[pair], n0=n0, n1=n1)]


def _merge(parts: list[pd.DataFrame]) -> list[pd.DataFrame]:
    """Frames of one kind each."""
    out = []
    for kind in {int(p["kind"].iloc[0]) for p in parts if len(p)}:
        own = pd.concat([p for p in parts if len(p) and p["kind"].iloc[0] == kind])
        out.append(_summed(kind, *(own[c].to_numpy() for c in ("left", "word")), **{c: own[c].to_numpy() for c in ("n", "n0", "n1")}))
    return out


class _Held:
    """Rows of COUNTS held by a task: merged when there are too many, sent if that doesn't halve them."""

    def __init__(self, most: int):
        self.parts: list[pd.DataFrame] = []
        self.size, self.most = 0, most

    def add(self, new: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        self.parts += new
        self.size += sum(map(len, new))
        if self.size > self.most:
            self.parts = _merge(self.parts)
            self.size = sum(map(len, self.parts))
            if 2 * self.size > self.most:
                yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        yield from _merge(self.parts)
        self.parts, self.size = [], 0


def _counter(broadcast):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, toxic = broadcast.value
        held = _Held(MAX_HELD)
        for pdf in batches:
            texts = pdf["text"].tolist()
            label = pdf["label"].to_numpy(np.int64).copy()
            if len(ids):
                own = pdf["id"].to_numpy(np.int64)
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                found = (ids[at] == own) & pdf["known"].to_numpy(bool)
                label[found] = toxic[at[found]]
            for part in slices(texts):
                yield from held.add(_tally(*words_of(texts[part]), label[part]))
        yield from held.rest()

    return run


@tidy
def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summed rows: words go on; of pairs, those counted 3 times or more in a class do, and all are counted for their word."""
    held = _Held(MAX_HELD)
    for pdf in batches:
        pairs = pdf[pdf["kind"] == PAIR]
        n0, n1 = pairs["n0"].to_numpy(), pairs["n1"].to_numpy()
        yield pd.concat((pdf[pdf["kind"] == WORD], pairs[(n0 > 2) | (n1 > 2)]))
        yield from held.add([_summed(CONTINUED, np.zeros(len(pairs), np.int64), pairs["word"].to_numpy(), n0=n0 > 0, n1=n1 > 0)])
    yield from held.rest()


def id_key(docs: DataFrame) -> Column:
    """doc_id as a long: itself, or its hash if it is no integer."""
    c = F.col("doc_id")
    return c.cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.when(c.isNotNull(), F.xxhash64(c.cast("string")))


def corpus_counts(spark: SparkSession, docs: DataFrame, labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of COUNTS as _reduced leaves them; labelled: id, toxic."""
    own = id_key(docs)  # without nulls, which pandas would turn to floats
    known = docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNotNull().alias("known"), "text")
    if labelled.limit(MAX_LABELS + 1).count() <= MAX_LABELS:
        ids = gathered(spark, labelled.select("id", F.col("toxic").cast("long")))
        ids, known = (ids[0], ids[1].astype(np.int8)), known.withColumn("label", F.lit(-1))
    else:
        toxic = labelled.select("id", F.lit(True).alias("known"), F.col("toxic").alias("label"))
        ids, known = (np.zeros(0, np.int64),) * 2, known.join(toxic, ["id", "known"], "left").fillna(-1, ["label"])
    parts = known.mapInPandas(_counter(spark.sparkContext.broadcast(ids)), COUNTS)
    sums = parts.groupBy("kind", "left", "word").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")])
    with batch_rows(spark, 50_000):
        return scratch.stash(sums.mapInPandas(_reduced, COUNTS), "counts")


def discounted(n: Column, discounts: tuple[float, float, float]) -> Column:
    return F.when(n >= 3, n - discounts[2]).when(n == 2, n - discounts[1]).when(n == 1, n - discounts[0]).otherwise(0.0)


def tables(counts: DataFrame, scratch: Scratch) -> tuple[dict[str, DataFrame], float] | None:
    """By name: key, n (how frequent) and values of words (P_0, P_1), contexts (c_0, c_1 and the shares that the discounts
    leave) and pairs (what the discounts leave of n_0, n_1); and e_1 / K_1 over e_0 / K_0, as a logarithm."""
    only = lambda kind, c: F.when(F.col("kind") == kind, F.col(c)).otherwise(0)
    words = scratch.stash(
        counts.filter(F.col("kind") != PAIR).groupBy(F.col("word").alias("key")).agg(
            F.sum("n").alias("n"), *[F.sum(only(WORD, f"n{c}")).alias(f"c{c}") for c in "01"], *[F.sum(only(CONTINUED, f"n{c}")).alias(f"k{c}") for c in "01"]),
        "words")
    kept = lambda c: discounted(F.col(f"k{c}"), WORD_DISCOUNTS)
    of = words.agg(
        F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v"), *[F.sum(f"k{c}").alias(f"k{c}") for c in "01"],
        *[F.sum(F.col(f"k{c}") - kept(c)).alias(f"e{c}") for c in "01"]).first()
    if not of["k0"] or not of["k1"]:
        return None
    shared = (F.col("n") + 0.5) / F.lit(of["n"] + 0.5 * of["v"])
    p = [((kept(c) + F.lit(of[f"e{c}"]) * shared) / F.lit(float(of[f"k{c}"]))).alias(f"p{c}") for c in "01"]
    pairs = counts.filter(F.col("kind") == PAIR)
    top = [F.when(F.col(f"n{c}") >= 3, F.col(f"n{c}") - PAIR_DISCOUNTS[2]).otherwise(0.0).alias(f"t{c}") for c in "01"]
    paired = pairs.select(F.col("word").alias("key"), F.lit(True).alias("paired")).distinct()
    gone = pairs.select(F.col("left").alias("key"), *top).groupBy("key").agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))
    share = [F.when(F.col(f"c{c}") > 0, 1 - F.col(f"t{c}") / F.col(f"c{c}")).otherwise(1.0).alias(f"d{c}") for c in "01"]
    out = {
        "word": words.join(paired, "key", "left").filter("k0 > 1 OR k1 > 1 OR paired").select("key", (F.col("k0") + F.col("k1")).alias("n"), *p),
        "context": gone.join(words, "key").select("key", (F.col("c0") + F.col("c1")).alias("n"), F.col("c0").cast("double"), F.col("c1").cast("double"), *share),
        "pair": pairs.select(F.xxhash64("left", "word").alias("key"), (F.col("n0") + F.col("n1")).alias("n"), *top),
    }
    return {k: scratch.stash(v, f"table-{k}") for k, v in out.items()}, math.log(of["e1"] / of["k1"]) - math.log(of["e0"] / of["k0"])


@dataclass
class Table:
    """Entries that are broadcast, a filter for the others, and these."""

    keys: np.ndarray  # hashes, ascending
    values: np.ndarray
    others: Bloom | None
    cold: DataFrame | None = field(default=None, repr=False)
    starts: np.ndarray | None = None  # where the keys of each leading bits begin, about one of each

    def __post_init__(self):
        ends = np.bincount(self._leading(self.keys), minlength=1 << self.bits)
        self.starts = np.concatenate(([0], np.cumsum(ends))).astype(np.int32)

    @property
    def bits(self) -> int:
        return max(1, len(self.keys).bit_length())

    def _leading(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getstate__(self):
        return self.__dict__ | {"cold": None}

    @classmethod
    def of(cls, spark: SparkSession, table: DataFrame, most: int) -> Table:
        """Entries whose counts have so many bits that they are `most` at most are hot."""
        bits = F.length(F.bin("n"))
        least, total = 64, 0
        levels = sorted(((r["bits"], r["count"]) for r in table.groupBy(bits.alias("bits")).count().collect()), reverse=True)
        for b, n in levels:
            total += n
            if total > most:
                break
            least = b
        keys, *values = gathered(spark, table.filter(bits >= least).drop("n"))
        cold = table.filter(bits < least).drop("n")
        n = sum(n for b, n in levels if b < least)
        values = np.column_stack(values).astype(np.float64 if len(values) == 2 and "p0" in table.columns else np.float32)
        return cls(keys, values, Bloom(cold.select("key"), n) if n else None, cold if n else None)

    def find(self, key: np.ndarray, default: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Values of each key, and whether a colder entry may have others."""
        out = np.tile(np.array(default), (len(key), 1))
        found = np.zeros(len(key), bool)
        first = self._leading(key)
        at, stop = self.starts[first].astype(np.int64), self.starts[first + 1]
        live = np.flatnonzero(at < stop)
        while len(live):
            same = self.keys[at[live]] == key[live]
            found[live[same]] = True
            live = live[~same]
            at[live] += 1
            live = live[at[live] < stop[live]]
        out[found] = self.values[at[found]]
        return out, ~found & self.others.holds(key) if self.others else np.zeros(len(key), bool)


#: Values of entries that no table has: a word's are in proportion to e_c / K_c and set by the model.
NO_CONTEXT, NO_PAIR = (0.0, 0.0, 1.0, 1.0), (0.0, 0.0)


def differences(p: np.ndarray, context: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of the toxic class less that of the other, of words alone and of words after their context."""
    seen = np.maximum(context[:, :2], 1)
    both = pair / seen + context[:, 2:] * p
    return np.log(p[:, 1]) - np.log(p[:, 0]), np.log(both[:, 1]) - np.log(both[:, 0])


ASKED = "text_key long, word long, left long, pair long, times long, ask_word boolean, ask_context boolean, ask_pair boolean, p0 double, p1 double, c0 double, c1 double, d0 double, d1 double, t0 double, t1 double"
GOT = ["total_u", "large_u", "max_u", "total_b", "large_b", "max_b"]


@tidy
def _answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Differences of asked places."""
    for pdf in batches:
        values = [pdf[c].to_numpy(np.float64) for c in ("p0", "p1", "c0", "c1", "d0", "d1", "t0", "t1")]
        u, b = differences(np.column_stack(values[:2]), np.column_stack(values[2:6]), np.column_stack(values[6:]))
        yield pd.DataFrame({"text_key": pdf["text_key"], "word": pdf["word"], "left": pdf["left"], "times": pdf["times"], "u": u, "b": b})


@dataclass
class Model:
    word: Table
    context: Table
    pair: Table
    rest: float
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None

    @property
    def complete(self) -> bool:
        """Whether all entries are broadcast."""
        return not (self.word.others or self.context.others or self.pair.others)

    def look_up(self, texts: list[str | None]) -> tuple:
        """Of each place: word, left, text; values as far as the broadcast entries tell; whether others must be asked."""
        word, left, doc = words_of(texts)
        pair = xxhash_longs(left, word)
        found = [t.find(k, d) for t, k, d in ((self.word, word, (1.0, math.exp(self.rest))), (self.context, left, NO_CONTEXT), (self.pair, pair, NO_PAIR))]
        return word, left, pair, doc, [v for v, _ in found], [a for _, a in found]

    def asked(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates("text_key")
            texts, keys = pdf["text"].tolist(), pdf["text_key"].to_numpy(np.int64)
            for part in slices(texts):
                word, left, pair, doc, values, ask = self.look_up(texts[part])
                at = np.flatnonzero(ask[0] | ask[1] | ask[2])
                first = at[_distinct(doc[at], left[at], word[at])]
                order = np.lexsort((word[at], left[at], doc[at]))
                new = np.isin(at[order], first)  # the places of a pair in a text stand together
                times = np.diff(np.append(np.flatnonzero(new), len(at)))
                own = at[order][new]
                columns = dict(zip(("p0", "p1", "c0", "c1", "d0", "d1", "t0", "t1"), np.column_stack(values)[own].T, strict=True))
                yield pd.DataFrame({
                    "text_key": keys[part][doc[own]], "word": word[own], "left": left[own], "pair": pair[own], "times": times,
                    "ask_word": ask[0][own], "ask_context": ask[1][own], "ask_pair": ask[2][own], **columns})

    def answers(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """Of docs' text_key and text, by text_key: GOT of the places that are asked."""
        rows = scratch.stash(docs.mapInPandas(tidy(self.asked), ASKED), "asked")
        for table, by, ask in ((self.word, "word", "ask_word"), (self.context, "left", "ask_context"), (self.pair, "pair", "ask_pair")):
            if table.cold is None:
                continue
            names = table.cold.columns[1:]
            cold = table.cold.withColumnsRenamed({"key": "cold_key", **{c: f"cold_{c}" for c in names}})
            got = rows.filter(ask).join(cold, F.col(by) == F.col("cold_key"), "left").drop("cold_key")
            got = got.withColumns({c: F.coalesce(f"cold_{c}", c) for c in names}).drop(*[f"cold_{c}" for c in names])
            rows = rows.filter(f"NOT {ask}").unionByName(got)  # rows that needn't ask don't meet in one task
        rows = rows.mapInPandas(_answered, "text_key long, word long, left long, times long, u double, b double")
        rows = rows.groupBy("text_key", "word", "left").agg(F.max("times").alias("times"), F.max("u").alias("u"), F.max("b").alias("b"))  # rows may share a text
        unit = lambda c: F.sum(F.round(c * F.lit(UNIT)).cast("long") * F.col("times"))
        return rows.groupBy("text_key").agg(*[
            f.alias(f"{name}_{c}") for c in "ub" for name, f in (
                ("total", unit(F.col(c))), ("large", unit(F.greatest(F.col(c) - LARGE, F.lit(0.0)))), ("max", F.max(c)))])

    def completed(self, docs: DataFrame, name: str, scratch: Scratch) -> DataFrame:
        """Adds a column: struct of the text and what the shuffle answers for it."""
        if self.complete:
            return docs.withColumn(name, F.struct("text", *[F.lit(None).cast("double" if c.startswith("max") else "long").alias(c) for c in GOT]))
        key = F.xxhash64("text")
        found = self.answers(docs.select(key.alias("text_key"), "text"), scratch)
        found = found.select(F.col("text_key").alias(f"{name}_key"), F.struct(*GOT).alias(f"{name}_found"))
        both = docs.withColumn(name, key).join(found, F.col(name) == F.col(f"{name}_key"), "left")
        return both.withColumn(name, F.struct("text", *[F.col(f"{name}_found.{c}").alias(c) for c in GOT])).drop(f"{name}_key", f"{name}_found")

    def features(self, pdf: pd.DataFrame) -> np.ndarray:
        """pdf: text and GOT. At both orders: difference a word, the largest, the logarithm of the sum of large ones; length."""
        texts = pdf["text"].tolist()
        out = np.zeros((len(texts), FEATURES))
        for part in slices(texts):
            _, _, _, doc, values, ask = self.look_up(texts[part])
            rows = len(texts[part])
            n = np.bincount(doc, minlength=rows)
            own = out[part]
            told = ~(ask[0] | ask[1] | ask[2])
            both = differences(*(v[told] for v in values))
            at = doc[told]
            has = np.flatnonzero(np.bincount(at, minlength=rows))
            first = np.searchsorted(at, has)
            for k, (c, diff) in enumerate(zip("ub", both, strict=True)):
                total, large, top = (pdf[f"{x}_{c}"].iloc[part].to_numpy(float) for x in ("total", "large", "max"))
                total, large = np.nan_to_num(total) / UNIT, np.nan_to_num(large) / UNIT
                largest = np.full(rows, -np.inf)
                if len(has):
                    largest[has] = np.maximum.reduceat(diff, first)
                largest = np.fmax(largest, top)
                total = total + np.bincount(at, weights=diff, minlength=rows)
                large = large + np.bincount(at, weights=np.maximum(diff - LARGE, 0), minlength=rows)
                own[:, 3 * k] = total / np.maximum(n, 1)
                own[:, 3 * k + 1] = np.where(n > 0, largest, 0.0)
                own[:, 3 * k + 2] = np.log1p(large)
            own[:, 6] = np.log1p(n)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton's method with a small ridge; weight: labelled rows that each row stands for."""
        self.center = np.average(x, 0, weight)
        self.scale = np.sqrt(np.average((x - self.center) ** 2, 0, weight)) + 1e-9
        z = np.column_stack((np.ones(len(x)), (x - self.center) / self.scale))
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * 0.5
            w += np.linalg.solve(hessian, z.T @ (weight * (y - p)) - 0.5 * w)
        self.weights = w

    def score(self, pdf: pd.DataFrame) -> np.ndarray:
        x = self.features(pdf)
        z = self.weights[0] + ((x - self.center) / self.scale) @ self.weights[1:]
        return np.where(x[:, 6] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = 60_000, seed: int = 5) -> Model | None:
    """The fitted model, or None if there is nothing to learn from."""
    small_batches(spark)
    rows = (
        labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    rows = scratch.stash(rows.select(id_key(rows).alias("id"), "toxic", fold(F.col("doc_id")).alias("fold")), "labels")
    counts = corpus_counts(spark, docs, rows.filter("fold < 2"), scratch)
    found = tables(counts, scratch)
    if found is None:
        return None
    for name in ("counts", "words"):
        scratch.drop(name)
    model = Model(*[Table.of(spark, found[0][k], MAX_HOT[k]) for k in ("word", "context", "pair")], found[1])
    rows = rows.filter("fold = 3")
    # Of a class beyond the bound, the rows whose hash is below the share that the bound is of it: no sort, and within one
    # in 50 of the bound (the chance to exceed it is below 1e-6 from 60,000 on).
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 32))
    shares = {r["toxic"]: 1.0 if r["count"] <= max_rows else 0.98 * max_rows / r["count"] for r in rows.groupBy("toxic").count().collect()}
    below = F.lit(False)
    for toxic, share in shares.items():
        below = below | ((F.col("toxic") == toxic) & (part < F.lit(int(share * (1 << 32)))))
    rest = rows.filter(below).select(F.col("id").alias("l_id"), F.col("toxic").alias("l_toxic"))
    shared = spark.sparkContext.broadcast(model)
    names = [f"x{i}" for i in range(FEATURES)] + ["y"]

    @tidy
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(np.column_stack((shared.value.features(pdf), pdf["l_toxic"])), columns=names)

    # 2 * max_rows rows at most on either side of this join's broadcast and in the result.
    seen = docs.select(id_key(docs).alias("id"), "text").join(F.broadcast(rest), F.col("id") == F.col("l_id"))
    seen = model.completed(seen.select("text", "l_toxic"), "x", scratch).select("x.*", "l_toxic")
    xy = seen.mapInPandas(run, ", ".join(f"{c} double" for c in names)).toPandas().to_numpy()
    if not len(xy):
        return None
    xy = xy[np.lexsort(xy.T)]  # the same order, and so the same sums, in every run
    y = xy[:, -1].astype(int)
    model.fit(xy[:, :-1], y, np.array([1 / shares.get(c, 1.0) for c in (0, 1)])[y])
    return model


def with_toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 60_000,
    score_column: str = "toxic_score", predicted_column: str = "toxic_predicted",
) -> DataFrame:
    """The columns of docs, with a score and a prediction."""
    scratch = Scratch(spark, "toxicity")
    model = train(spark, docs, labels, scratch, max_rows)
    docs = docs.drop(score_column, predicted_column)
    if model is None:
        scored = docs.withColumn(score_column, F.lit(0.0))
    else:
        shared = spark.sparkContext.broadcast(model)

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            drop_kept()
            for pdf in parts:
                yield pd.Series(shared.value.score(pdf), dtype=float)
            give_back()

        score.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
        # The struct takes the score column's name until the score does.
        scored = model.completed(docs, score_column, scratch).withColumn(score_column, F.pandas_udf(score, "double")(score_column))
    return scored.withColumn(predicted_column, (F.col(score_column) >= threshold).cast("int"))
