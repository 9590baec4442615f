"""Chat formatting, line dedup, license scan, decontamination, toxicity: against brute force, with hard inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillspark.llm import toxicity
from quillspark.llm.chat import format_preferences
from quillspark.llm.decontaminate import Phrases, clean_documents, cut_spans, find_leaks, leak_report, search_shard, sorted_suffixes
from quillspark.llm.license_scan import scan_licenses
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.toxicity import fold, train, with_toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: WORD.findall((t or "").translate(LOWER))
DOCS = "doc_id long, text string, lang string, _row string, line string, size long"


def docs_of(spark, pairs):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 7) for i, t in pairs], DOCS)


HARD = [
    (1, None), (2, ""), (3, " \t\n\x0b \r\n"), (None, "Some Text\nhere"), (None, None), (5, "É über\nabc  \n  ABC\n\n"), (5, "É über\nabc  \n  ABC\n\n"),
    (6, "x\r\ny\x00z w\n\U0001f600 end"),
]


def render(turns):
    return "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in turns)


def mask(turns):
    at, out = 0, []
    for r, t in turns:
        head, body = f"<|{r or 'unknown'}|>\n", f"{t or ''}<|end|>\n"
        if r == "assistant":
            out.append(f"{at + len(head)}-{at + len(head) + len(body)}")
        at += len(head) + len(body)
    return ",".join(out)


def test_chat(spark):
    r = random.Random(1)
    data = []
    for pair in [*range(40), None]:
        shared = [(r.choice(["user", "assistant", None]), r.choice(["a", "é\U0001f600", "", None, "long " * 50])) for _ in range(r.randint(0, 3))]
        for side in ("chosen", "rejected"):
            own = shared + [(r.choice(["user", "assistant"]), r.choice("xyz")) for _ in range(r.randint(0, 3))]
            data += [(pair, side, i, *t, "extra") for i, t in enumerate(own)]
    data += [(99, "chosen", 0, "assistant", "only one side", "e"), (99, "other", 0, "user", "no side", "e")]
    got = {x.pair_id: x for x in format_preferences(spark.createDataFrame(data, "pair_id long, side string, turn long, role string, text string, p string")).collect()}
    assert set(got) == {d[0] for d in data if d[1] != "other"}
    for pair, x in got.items():
        side = {s: [d[3:5] for d in data if d[0] == pair and d[1] == s] for s in ("chosen", "rejected")}
        k = 0
        while k < min(map(len, side.values())) and side["chosen"][k] == side["rejected"][k]:
            k += 1
        c, j = side["chosen"], side["rejected"]
        assert tuple(x) == (pair, k, render(c[:k]), render(c[k:]), mask(c[k:]), render(j[k:]), mask(j[k:]))
    assert format_preferences(spark.createDataFrame([], "pair_id long, side string, turn long, role string, text string")).count() == 0


def test_line_dedup(spark):
    r = random.Random(2)
    stock = ["Common Line", "  common line\t", "rare", "", "É", "é", "x" * 300]
    pairs = [(i, "\n".join(r.choice([*stock, f"own {i}"]) for _ in range(r.randint(0, 6)))) for i in range(10, 60)]
    pairs += HARD + [(100, "Common line\n" * 3000 + "tail")]
    for least, chars in ((10, 1), (2, 5), (1, 1)):
        key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
        seen = {}
        for n, (i, t) in enumerate(pairs):
            for line in (t or "").split("\n"):
                if len(key(line)) >= chars:
                    seen.setdefault(key(line), set()).add((i, t) if i is not None or t is not None else n)
        common = {k for k, d in seen.items() if len(d) >= least}
        want = []
        for i, t in pairs:
            lines = (t or "").split("\n")
            kept = [x for x in lines if key(x) not in common]
            want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
        assert rows(dedup_lines(spark, docs_of(spark, pairs), least, chars)) == sorted(want, key=repr)
    assert dedup_lines(spark, docs_of(spark, [])).count() == 0


def test_license_scan(spark):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    r = random.Random(3)
    stock = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0", "under the", "mit", "license", "cc", "by", "nc", "apache", "Under The MIT-License!"]
    pairs = [(i, " ".join(r.choice(stock) for _ in range(r.randint(0, 12)))) for i in range(1000, 1040)] + HARD
    gpl = "This work is licensed under the GNU General Public License, version 3."
    pairs += [(200, "word " * 5000 + gpl), (201, "This work here is licensed under the GNU General Public License version 3"), (202, "The GNU is a general animal of the public")]
    got = {}
    for x in scan_licenses(spark, docs_of(spark, pairs)).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, got.values())) == len(pairs)
    for i, t in pairs:
        if i is None:
            continue
        w = words(t)
        places = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = got[i][0]
        at = [k for k, _ in places]
        base = ",".join(sorted({n for _, n in places}))
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(places), min(at, default=None), max(at, default=None), base)
        assert set(base.split(",")) - {""} <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert got[200][0].labels == got[201][0].labels == "gpl-3" and got[202][0].labels == ""
    assert got[200][0].spans[0].first == 5000 and got[200][0].score == 1
    assert scan_licenses(spark, docs_of(spark, [])).count() == 0


def brute_leaks(texts, items, window):
    found = {}
    for name, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(str(name) if name is not None else "null")
    out = []
    for t in texts:
        w = words(t)
        hit, names = set(), set()
        for size in {len(f) for f in found}:
            for k in range(len(w) - size + 1):
                if own := found.get(tuple(w[k : k + size])):
                    names |= own
                    hit |= set(range(k, k + size))
        out.append((len(w), len(hit), sorted(names)))
    return out


def test_leaks_brute_force():
    r = random.Random(4)
    for _ in range(150):
        vocabulary = ["a", "B", "c", "dd", "é", "q"][: r.randint(2, 6)]
        text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))  # noqa: E731, B023
        texts = [None if r.random() < 0.1 else text(r.randint(0, 50)) for _ in range(r.randint(1, 6))] + ["other words a b"]
        texts.append(texts[0])
        items = [(i, text(r.randint(0, 12))) for i in range(r.randint(0, 6))]
        window = r.randint(1, 6)
        got = [(n, sum(b - a for a, b in s), i) for n, s, i in search_shard(texts, Phrases([(str(n), t) for n, t in items], window))]
        assert got == brute_leaks(texts, items, window)


def test_suffixes():
    r = np.random.default_rng(1)
    for _ in range(100):
        text = np.append(r.integers(0, 4, r.integers(0, 60)), 0)
        ends = np.flatnonzero(text == 0)
        key = lambda i: [*text[i : ends[np.searchsorted(ends, i)]].tolist(), 0, int(ends[np.searchsorted(ends, i)])]  # noqa: E731, B023
        assert sorted_suffixes(text, 2).tolist() == sorted(range(len(text)), key=key)


def test_leaks_spark(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    items = [(i, text(r.randint(0, 9))) for i in range(12)] + [(None, "a b c d"), (3, None), (3, "h h h")]
    pairs = [(i, text(r.randint(0, 80))) for i in range(30)] + HARD + [(900, text(20_000))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, lang int")
    want = sorted(((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for (i, _), (n, h, x) in zip(pairs, brute_leaks([t for _, t in pairs], items, 4), strict=True)), key=repr)
    docs = docs_of(spark, pairs)
    assert rows(leak_report(find_leaks(spark, docs, bench, window=4, shard_words=500))) == want
    assert rows(leak_report(find_leaks(spark, docs, bench, window=4, block_words=6))) == want  # several blocks of phrases
    for words in (10**6, 6):
        assert rows(clean_documents(spark, docs, bench, 4, words).select("doc_id")) == sorted(((w[0],) for w in want if not w[5]), key=repr)
    assert leak_report(find_leaks(spark, docs, bench.limit(0))).filter("contaminated").count() == 0
    assert find_leaks(spark, docs_of(spark, []), bench).count() == 0


def test_cut_spans():
    assert cut_spans("One, two three. Four!", [[1, 3]]) == "One, . Four!"
    assert cut_spans("é a b", [[0, 1], [2, 3]]) == " a "


def test_toxicity(spark):
    r = random.Random(6)
    plain, bad = [f"w{i}" for i in range(300)], ["vilest", "vileness", "vilely", "scum"]
    pairs, labels = [], []
    for i in range(1200):
        t = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                t[r.randrange(len(t))] = r.choice(bad)
        pairs.append((i, " ".join(t)))
        labels.append((i, 1 if toxic else 0, 0))
    pairs += [(9000, None), (9001, ""), (None, "scum scum"), (9002, "w1 " * 20_000), (9003, "\x00 ...")]
    labels += [(9000, 1, 0), (None, 1, 0), (3, None, 0), (4, 0, 1)]
    docs, marks = docs_of(spark, pairs), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    out = with_toxicity(spark, docs, marks).withColumn("held", fold(F.col("doc_id")) == 2).collect()
    assert len(out) == len(pairs) and all(0 <= x.toxic_score <= 1 for x in out)
    held = [x for x in out if x.held and x.doc_id < 9000]
    assert sum(x.toxic_predicted == (x.doc_id % 8 == 0) for x in held) >= 0.97 * len(held) > 200
    assert {x.doc_id: x.toxic_score for x in out}[9001] == 0
    # labels of the held-out rows are never read
    flipped = marks.withColumn("toxic", F.when(fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x.doc_id: x.toxic_score for x in with_toxicity(spark, docs, flipped).collect()}
    assert all(again[x.doc_id] == pytest.approx(x.toxic_score) for x in out)
    assert train(spark, docs, marks.filter("toxic = 0"), toxicity.Scratch(spark, "test")) is None
    assert with_toxicity(spark, docs, marks.limit(0)).filter("toxic_score > 0").count() == 0
    assert with_toxicity(spark, docs_of(spark, []), marks).count() == 0


def test_toxicity_counts_each_word(spark):
    """No two words share counts, also where there are more than 2**20."""
    texts = [" ".join(f"x{i}y{k}" for i in range(11_000)) for k in range(100)]
    docs = docs_of(spark, list(enumerate(texts)))
    none = spark.createDataFrame([], "id long, toxic int")
    counts = toxicity.corpus_counts(spark, docs, none, toxicity.Scratch(spark, "test")).filter(F.col("kind") == toxicity.WORD)
    assert counts.agg(F.count("*"), F.max("n"), F.sum("n")).first() == (1_100_000, 1, 1_100_000)


def kneser_ney(pairs, marks):
    """Features of texts by the formulas of the docstring, in plain Python."""
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    n, held, pair = Counter(), [Counter(), Counter()], [Counter(), Counter()]
    for i, t in pairs:
        w = words(t)
        n.update(set(w))
        if i is not None and zlib.crc32(str(i).encode()) % 4 < 2 and i in marks:
            pair[marks[i]].update(set(zip([None, *w], w)))
    less = lambda x, d: d[min(x, 3) - 1] if x else 0
    k = [Counter(w for _, w in pair[c]) for c in (0, 1)]
    total = sum(n.values()) + len(n) / 2
    for c in (0, 1):
        for (v, _), x in pair[c].items():
            held[c][v] += x

    def p(c, v, w):
        e = sum(less(x, (1, 1.3, 1.5)) for x in k[c].values())
        own = (k[c][w] - less(k[c][w], (1, 1.3, 1.5)) + e * (n[w] + 0.5) / total) / sum(k[c].values())
        if not held[c][v]:
            return own, own
        d = sum(less(x, (1, 2, 1.5)) for (a, _), x in pair[c].items() if a == v)
        x = pair[c][v, w]
        return own, (x - less(x, (1, 2, 1.5)) + d * own) / held[c][v]

    out = []
    for _, t in pairs:
        w = words(t)
        both = [[math.log(b / a) for a, b in zip(p(0, v, x), p(1, v, x))] for v, x in zip([None, *w], w)]
        f = []
        for order in (0, 1):
            d = [x[order] for x in both]
            f += [sum(d) / len(d), max(d), math.log1p(sum(max(x - 2, 0) for x in d))] if d else [0, 0, 0]
        out.append([*f, math.log1p(len(w))])
    return out


def test_toxicity_brute_force(spark, monkeypatch):
    r = random.Random(12)
    pairs = []
    for i in range(300):
        w = [f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randint(0, 25))]
        if i % 4 == 0 and w:
            w[r.randrange(len(w))] = r.choice(["scum", "new york", "go away now"])
        pairs.append((i, " ".join(w)))
    pairs += [(None, "scum w1"), (500, None), (501, "new york new york scum of new york")]
    marks = {i: int(i % 4 == 0) for i in range(0, 300)}
    docs, labels = docs_of(spark, pairs), spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    want = np.array(kneser_ney(pairs, marks))
    assert want[-1, 4] > want[-1, 1] or want[-1, 5] > 0
    for most in (10**6, 7, 0):  # with entries that are looked up by shuffle, the answers come as columns
        monkeypatch.setattr(toxicity, "MAX_HOT", dict.fromkeys(toxicity.MAX_HOT, most))
        scratch = toxicity.Scratch(spark, "test")
        model = toxicity.train(spark, docs, labels, scratch)
        assert model.complete == (most == 10**6)
        got = model.completed(docs, "x", scratch).select("doc_id", "x.*").toPandas()
        key = lambda i, t: (-1 if i is None or i != i else int(i), t or "")
        at = {key(i, t): f for (i, t), f in zip(pairs, want)}
        assert np.allclose(model.features(got), [at[key(i, t)] for i, t in zip(got["doc_id"], got["text"])], atol=1e-6)


def test_toxicity_expressions(spark):
    """An expression whose words are ordinary one by one is told from them."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    pairs = []
    for i in range(1500):
        t = [r.choice(words) for _ in range(40)]
        for k, w in enumerate(t[:-1]):
            if w == "w1" and t[k + 1] == "w2":
                t[k] = "w3"
        if i % 6 == 0:
            k = r.randrange(39)
            t[k : k + 2] = ["w1", "w2"]
        pairs.append((i, " ".join(t)))
    marks = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(1500)], "doc_id long, toxic int")
    out = [x for x in with_toxicity(spark, docs_of(spark, pairs), marks).filter(fold(F.col("doc_id")) == 2).collect()]
    assert sum(x.toxic_predicted == (x.doc_id % 6 == 0) for x in out) >= 0.95 * len(out) > 200


def test_toxicity_by_shuffle(spark, monkeypatch):
    """Entries and labels beyond what may be broadcast give the same scores; so do ids that are strings."""
    r = random.Random(8)
    pairs = [(i, " ".join(r.choice(["scum", "vile", "so"] if i % 5 == 0 else ["so", "fine"]) + str(r.randrange(60)) for _ in range(r.randint(1, 30)))) for i in range(600)]
    pairs += [(700, pairs[5][1]), (None, pairs[5][1]), (701, None), (702, ""), (703, "new words")]
    docs, marks = docs_of(spark, pairs), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    text = F.col("doc_id").cast("string")
    got = []
    for hot, ids, named in ((10**6, 10**6, False), (20, 0, False), (0, 0, True), (10**6, 10**6, True)):
        monkeypatch.setattr(toxicity, "MAX_HOT", dict.fromkeys(toxicity.MAX_HOT, hot))
        monkeypatch.setattr(toxicity, "MAX_LABELS", ids)
        out = with_toxicity(spark, docs.withColumn("doc_id", text), marks.withColumn("doc_id", text)) if named else with_toxicity(spark, docs, marks)
        got.append(sorted((-1 if x.doc_id is None else int(x.doc_id), x.text or "", x.toxic_score) for x in out.collect()))
    for other in got[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in got[0]] and [x[2] for x in other] == pytest.approx([x[2] for x in got[0]], abs=1e-5)
    assert len({x[2] for x in got[0]}) > 100


def test_toxicity_clash(spark):
    """Columns with the names of results give way to them; others stay."""
    docs = docs_of(spark, [(i, "w scum" if i % 2 else "w fine") for i in range(80)]).withColumns({"toxic_score": F.lit("x"), "word": F.lit(1), "p0": F.lit(2)})
    out = with_toxicity(spark, docs, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    assert dict(out.dtypes)["toxic_score"] == "double" and out.columns.count("toxic_score") == 1
    assert all(x.word == 1 and x.p0 == 2 and x.toxic_predicted == x.doc_id % 2 for x in out.collect())


def test_toxicity_bound_keeps_class_ratio(spark):
    """A bound on the rows of each class leaves the scores at the ratio of all labels."""
    r = random.Random(9)
    toxic = [i % 8 == 0 for i in range(4000)]
    pairs = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(12)) + (" doubtful" if r.random() < (0.6 if t else 0.2) else "")) for i, t in enumerate(toxic)]
    docs, marks = docs_of(spark, pairs), spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    whole, bounded = (np.array([x.toxic_score for x in with_toxicity(spark, docs, marks, max_rows=n).collect()]).mean() for n in (60_000, 100))
    assert whole == pytest.approx(0.125, abs=0.03) and bounded == pytest.approx(whole, abs=0.06)
