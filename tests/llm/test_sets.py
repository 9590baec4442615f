"""N-gram join, mixing, pipeline and the registered queries."""

import collections
import os
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillspark.llm import queries
from quillspark.llm.mixing import expand, mix, route, targets
from quillspark.llm.ngram_join import RTree, Similarity, coarse, jaccard_components, point

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(pairs, num=75, den=100):
    sets = {i: shingles(t) for i, t in pairs if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(6, 150))] for _ in range(8)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.2:
            w = [r.choice(vocabulary) for _ in range(40)] + passage
        if r.random() < 0.1:
            w = w[: r.randint(0, 8)]
        out.append((i * 7 % 1009, " ".join(w)))
    return out


@pytest.mark.parametrize(("limit", "large"), [(4_000_000, 512), (0, 512), (4_000_000, 10), (0, 10)])
def test_ngram_join(spark, limit, large):
    pairs = near_copies(1) + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "A b"), (2004, "a  B"), (2005, "w1 " * 9000)]
    data = [(i, t, 1, "k") for i, t in [*pairs, (None, pairs[0][1]), pairs[3]]]
    got = rows(jaccard_components(spark, spark.createDataFrame(data, "doc_id long, text string, n int, key string"), Similarity(), limit, large=large))
    want = brute_components(pairs)
    assert got == sorted([(i, *want[i]) for i, _ in [*pairs, pairs[3]]] + [(None, len(shingles(pairs[0][1])), None)], key=repr)


def test_ngram_join_of_near_group(spark):
    """One group whose members are all alike, larger than any block."""
    r = random.Random(3)
    base = [f"v{r.randrange(500)}" for _ in range(120)]
    pairs = []
    for i in range(150):
        w = list(base)
        for _ in range(2):
            w[r.randrange(len(w))] = f"x{i}"
        pairs.append((i, " ".join(w)))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    want = brute_components(pairs)
    for limit in (4_000_000, 0):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(spark, df, Similarity(), limit).collect()} == want
    assert jaccard_components(spark, df.limit(0)).count() == 0


def test_ngram_join_of_large_ids(spark):
    pairs = [(2**60 + i, "a b c d e f g h i j " * 3 + "x" * (i % 2) + f" tail{i // 2}") for i in range(6)]
    df = spark.createDataFrame([*pairs, (None, pairs[0][1])], "doc_id long, text string").coalesce(1)
    want = brute_components(pairs)
    for limit in (4_000_000, 0):
        assert {x.doc_id: x.component_id for x in jaccard_components(spark, df, Similarity(), limit).collect() if x.doc_id} == {i: c for i, (_, c) in want.items()}


def test_blocks_too_large_to_hold():
    import pandas as pd

    from quillspark.llm.ngram_join import _blocks

    keys = [1] * 2 + [5] * 40 + [6] * 3 + [9] * 25
    data = pd.DataFrame({"key": keys, "doc": range(100, 100 + len(keys)), "n": 10})
    for step in (1, 7, 100):
        parts = [data.iloc[i : i + step] for i in range(0, len(data), step)]
        out = pd.concat(_blocks(Similarity(), 20, 22)(iter(parts)))
        assert len(out[out.kind == 0]) == 1 + 3
        assert sorted(out[out.kind == 2].b) == [*range(102, 142), *range(145, 170)]
        assert sorted(out[out.kind == 3].b) == [*range(103, 142), *range(146, 170)] and set(out[out.kind == 3].a) == {102, 145}


def test_rtree_loses_no_pair():
    r, sim = np.random.default_rng(4), Similarity()
    for _ in range(20):
        stock = r.integers(0, 1 << 63, 80, dtype=np.uint64)
        sets = [np.unique(r.choice(stock, r.integers(20, 60), replace=False)) for _ in range(70)]
        at = [point(s) for s in sets]
        groups = min(map(len, at))
        sizes = np.array([len(s) for s in sets])
        component = r.integers(0, 60, 70)
        tree = RTree(np.stack([coarse(p, groups) for p in at]), sizes, component)
        got = {tuple(sorted(p)) for x, y, _ in tree.join(sim) for p in zip(x.tolist(), y.tolist(), strict=True)}
        for a in range(70):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if sim.links(both, len(sets[a]), len(sets[b])) and component[a] != component[b]:
                    assert (b, a) in got


def test_targets():
    assert targets([10, 10, 10], [3, 1, 2], Fraction(3, 2), 2) == [20, Fraction(25, 3), Fraction(50, 3)]
    assert targets([0, 0], [3, 1], Fraction(3, 2), 2) == [0, 0]
    assert targets([], [], Fraction(3, 2), 2) == []
    r = random.Random(5)
    for _ in range(100):
        sizes = [r.randint(0, 50) for _ in range(r.randint(1, 9))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        t = targets(sizes, weights, Fraction(3, 2), 2)
        assert sum(t) == Fraction(3, 2) * sum(sizes) and all(0 <= x <= 2 * s for x, s in zip(t, sizes, strict=True))
        free = [x / w for x, w, s in zip(t, weights, sizes, strict=True) if x < 2 * s]
        assert len(set(free)) <= 1  # shares by weight where the cap doesn't hold


def cheapest(patterns, quotas, passes):
    """Brute force: the least cost for the largest flow, words one by one over small numbers."""
    best = {}

    def go(p, left, cost, flow):
        if p == len(patterns):
            key = -flow
            if key not in best or cost < best[key]:
                best[key] = cost
            return
        members, size = patterns[p]

        def split(k, left, used):
            if k == len(members):
                over = max(0, used - size)
                go(p + 1, left, cost + over, flow + used)
                return
            for x in range(min(left[members[k]], passes * size - used) + 1):
                split(k + 1, [*left[: members[k]], left[members[k]] - x, *left[members[k] + 1 :]], used + x)

        split(0, left, 0)

    go(0, quotas, 0, 0)
    return min(best), best[min(best)]


def test_route():
    r = random.Random(6)
    for _ in range(60):
        quotas = [r.randint(0, 4) for _ in range(3)]
        patterns = [(tuple(sorted(r.sample(range(3), r.randint(1, 3)))), r.randint(0, 3)) for _ in range(r.randint(1, 3))]
        flow = route(patterns, quotas, 2)
        total = sum(sum(f.values()) for f in flow)
        cost = sum(max(0, sum(f.values()) - size) for f, (_, size) in zip(flow, patterns, strict=True))
        assert all(set(f) <= set(m) and sum(f.values()) <= 2 * s for f, (m, s) in zip(flow, patterns, strict=True))
        assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quotas))
        assert (-total, cost) == cheapest(patterns, quotas, 2)


def test_mix(spark):
    r = random.Random(7)
    pairs = [(i, " ".join(["w"] * r.randint(0, 30)) + r.choice(["", "\n", " "]), r.choice(["b", "a", "é", None, "z"])) for i in range(200)]
    pairs += [(500, None, "a"), (501, "", "only empty"), (None, "x y", "a"), (502, "w " * 4000, "b"), pairs[0], pairs[0]]
    df = spark.createDataFrame([(*p, 3, 4) for p in pairs], "doc_id long, text string, source string, size int, rest int")
    got = mix(spark, df.select("doc_id", "text", "source", "size", "rest"), keep_columns=True)
    out = got.select("doc.source", "doc_id", "size", "source_size", "target", "taken").collect()
    names = sorted({p[2] for p in pairs}, key=lambda s: (s is None, s or ""))
    sizes = collections.Counter({n: 0 for n in names})
    for _, t, s in pairs:
        sizes[s] += len((t or "").split())
    want = targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], Fraction(3, 2), 2)
    taken = collections.Counter()
    assert len(out) == len(pairs)
    for x in out:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(float(want[names.index(x.source)])) and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[n] - w) < 1 for n, w in zip(names, want, strict=True))
    assert rows(mix(spark, df).select("doc_id", "taken")) == rows(got.select("doc_id", "taken"))
    copies = expand(got)
    assert copies.columns == df.columns
    words = collections.Counter()
    text_of = {i: t for i, t, _ in pairs}
    for x in copies.collect():
        words[x.source] += len((x.text or "").split())
        assert (text_of[x.doc_id] or "").startswith(x.text or "")
    assert words == +taken
    assert mix(spark, df.limit(0)).count() == 0


def test_mix_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), ["a"] if i % 3 else ["a", "b"]) for i in range(60)], "doc_id long, text string, names array<string>")
    out = mix(spark, df, "names", (1, 1)).collect()
    total = sum(x.size for x in out)
    assert all(x.taken <= 2 * x.size for x in out) and sum(x.taken for x in out) <= 1.5 * sum(len(x.sources) * x.size for x in out) + 2 and total


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(8)
    pairs = near_copies(2, 90)
    docs, labels = [], []
    for i, t in pairs:
        toxic = r.random() < 0.15
        docs.append((i, t + (" scum idiots" if toxic else ""), "en", r.choice(["s1", "s2", None]), len(t)))
        labels.append((i, 1, int(toxic)))
    leak = "one two three four five six seven eight nine ten eleven"
    docs += [(3000, f"Begin. {leak} end " + "z " * 5, "en", "s1", 1), (3001, None, None, None, None), (None, "no id", "en", "s1", 5), docs[0]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak.upper())], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "ngram_join", "decontamination", "mixing", "token_files"]
    start = spark.read.parquet(f"{folder}/documents.parquet")
    a = stage["toxicity"](spark, start, folder)
    assert a.columns == start.columns and 0 < a.count() <= len(docs)
    b = stage["ngram_join"](spark, start, folder)
    want = brute_components([(d[0], d[1]) for d in docs])
    assert sorted((x.doc_id for x in b.collect()), key=repr) == sorted([None] + [i for i, (_, c) in want.items() if i == c], key=repr)
    c = stage["decontamination"](spark, b, folder)
    assert {x.doc_id for x in b.collect()} - {x.doc_id for x in c.collect()} == {3000} and c.columns == start.columns
    d = stage["mixing"](spark, c, folder)
    assert d.columns == start.columns
    words = lambda df: df.select(F.sum(F.size(F.filter(F.split("text", " "), lambda x: x != "")))).first()[0]
    assert abs(words(d) - 1.5 * words(c)) <= 2
    e = stage["token_files"](spark, d, folder)
    assert e.count() == d.count()
    full = corpus_pipeline.run(spark, folder)
    assert full.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and full.count() > 0
    assert full.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == full.agg(F.sum("n_tokens")).first()[0]


def test_pipeline_repeated_ids(spark):
    """Of two texts of one id, the one that links to a smaller id goes and the other stays."""
    copy, own = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    docs = spark.createDataFrame([(1, copy), (2, copy), (2, own), (2, own), (5, own + " end"), (6, "x y z"), (None, copy)], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, copy), (2, own), (6, "x y z"), (None, copy)], key=repr)


CONTRACT = {
    2: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], 3: ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    4: ["doc_id", "start", "n_tokens", "ids_crc32"], 5: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    6: ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    7: ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    8: ["doc_id", "held_out", "score", "predicted"], 9: ["doc_id", "n_shingles", "component_id"], 10: ["doc_id", "size", "source_size", "target", "taken"],
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", [n for n in queries.queries()])
def test_queries(spark, name):
    assert name in __spark_entry__.queries()
    df = __spark_entry__.queries()[name](spark, FOLDER)
    n = int(name[2:].split("_")[0])
    assert n not in CONTRACT or df.columns == CONTRACT[n]
    got = df.collect()
    if sql := queries.oracle_sql().get(name):
        import duckdb

        c = duckdb.connect()
        for f in os.listdir(FOLDER):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
        want = c.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        at = [want.columns.index(x) for x in names]
        assert sorted(([x[k] for k in names] for x in got), key=repr) == sorted(([x[i] for i in at] for x in want.fetchall()), key=repr)
    elif n not in (1, 5):
        assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
