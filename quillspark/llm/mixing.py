"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

Documents are aggregated by membership pattern (the set of sources they belong to). The flow runs from patterns,
whose capacity is their size once at cost 0, once more at cost 1, and so on up to `max_passes` (convex repetition
costs), over the sources of the pattern to the sources' targets. Its size depends on the number of patterns and
sources alone, which is checked. Each pattern then gets the words that the flow routes through it: so many whole passes,
and a rest that goes to its documents in seeded order. The place in that order where the rest is used up is found by
histograms of the seeded hash, refined twice by 4096, so no group of documents is collected or sorted whole; the
document at that place is taken in part, to the word.

A null text has size 0; a null source is a source of its own, last in order. Rows equal in all of doc_id, source and
text are ordered arbitrarily among themselves, which changes nothing in the rows returned. An empty table gives none.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, space_count

MAX_PATTERNS = 100_000
LEVELS, BITS = 2, 12


def targets(sizes: list[int], weights: list[int], share: Fraction, cap: int) -> list[Fraction]:
    """Shares of `share` times all sizes by weight; none over cap times its size, the excess shared out again."""
    left, out, open_ = share * sum(sizes), [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes)]
    while open_ and left > 0:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w >= cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = Fraction(cap * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], max_passes: int) -> list[dict[int, int]]:
    """Min-cost flow. patterns: (their sources, size). Words by source for each pattern.

    Successive cheapest augmentation: with unit costs for passes, all flow at cost c is exhausted before cost c + 1, and
    within a cost the augmenting paths may reroute earlier flow through sources that patterns share.
    """
    flow: list[dict[int, int]] = [{} for _ in patterns]
    need = list(quotas)
    of: list[list[int]] = [[] for _ in quotas]
    for p, (members, _) in enumerate(patterns):
        for s in members:
            of[s].append(p)
    for _ in range(max_passes):
        spare = [size for _, size in patterns]
        for p, (members, _) in enumerate(patterns):
            if len(members) == 1:  # no choice to make
                s = members[0]
                if x := min(spare[p], need[s]):
                    flow[p][s] = flow[p].get(s, 0) + x
                    spare[p], need[s] = spare[p] - x, need[s] - x
        for start in range(len(patterns)):
            while spare[start]:
                # breadth-first over sources: pattern -> source with need, or source that another pattern can leave
                back: dict[int, tuple[int, int | None]] = {}
                queue, goal = [], None
                for s in patterns[start][0]:
                    back[s] = (start, None)
                    queue.append(s)
                while queue:
                    s = queue.pop(0)
                    if need[s]:
                        goal = s
                        break
                    for p in of[s]:
                        if flow[p].get(s):
                            for t in patterns[p][0]:
                                if t not in back:
                                    back[t] = (p, s)
                                    queue.append(t)
                if goal is None:
                    break
                path, s = [], goal
                while s is not None:
                    p, before = back[s]
                    path.append((p, before, s))
                    s = before
                x = min([spare[start], need[goal], *(flow[p][b] for p, b, _ in path if b is not None)])
                for p, before, s in path:
                    flow[p][s] = flow[p].get(s, 0) + x
                    if before is not None:
                        flow[p][before] -= x
                spare[start] -= x
                need[goal] -= x
    return flow


def mix(
    spark: SparkSession, docs: DataFrame, sources: str = "array(source)", weight_cycle: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2), max_passes: int = 2, seed: int = 11, keep_columns: bool = False,
) -> DataFrame:
    """docs: doc_id, text and what `sources` (SQL for an array of source names) reads. A row for each row: doc_id, size,
    sources (sorted), source_size and target (of the first source), taken (words, repeats counted), passes (whole ones).
    With keep_columns the columns of docs come as one struct, doc; what is broadcast places each row where it is, so
    texts aren't shuffled."""
    scratch = Scratch(spark, "mix")
    mask = (1 << BITS) - 1
    derived = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id"),
        F.array_sort(F.array_distinct(F.expr(sources).cast("array<string>"))).alias("members"), space_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("u"), F.xxhash64(F.lit(seed + 1), F.col("text"), F.col("doc_id")).alias("u2"),
    )
    own = scratch.stash(derived.drop("doc"), "sizes")
    seen = own.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(seen) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    last = lambda s: (s is None, "" if s is None else s.encode())  # noqa: E731 - code points sort as UTF-8 bytes do
    names = sorted({s for r in seen for s in r["members"]}, key=last)
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in seen:
        for s in r["members"]:
            sizes[at[s]] += r["size"]
    goal = targets(sizes, [weight_cycle[i % len(weight_cycle)] for i in range(len(names))], share, max_passes)
    patterns = [(tuple(at[s] for s in r["members"]), r["size"]) for r in seen]
    flow = route(patterns, [round(g) for g in goal], max_passes)
    quota = []
    for r, (members, size), f in zip(seen, patterns, flow, strict=True):
        words = sum(f.values())
        passes, rest = divmod(words, size) if size else (0, 0)
        first = members[0] if members else None
        quota.append((r["members"], None if first is None else sizes[first], None if first is None else float(goal[first]), passes, rest))
    plan = spark.createDataFrame(
        quota, "q_members array<string>, source_size long, target double, passes long, rest long"
    ).coalesce(1)
    # At most MAX_PATTERNS rows, so it may be broadcast.
    planned = lambda df: df.join(F.broadcast(plan), F.col("members").eqNullSafe(F.col("q_members")), "left").drop("q_members")
    rows = planned(own)

    # Refine the bucket of the hash in which the rest runs out. Each level reads counts of at most 4096 buckets a pattern.
    slot = lambda level: F.shiftrightunsigned("u", 64 - BITS * (level + 1)).bitwiseAND(F.lit(mask))
    edge = plan.select(F.col("q_members").alias("e_members"), F.col("rest").alias("e_rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        inside = rows.join(F.broadcast(edge), F.col("members").eqNullSafe(F.col("e_members")) & (
            F.shiftrightunsigned("u", 64 - BITS * level) == F.col("prefix") if level else F.lit(True)))
        hist = inside.groupBy("members", "e_rest", "prefix", slot(level).alias("slot")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("members").orderBy("slot")
        cut = (
            hist.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .filter((F.col("upto") - F.col("words") < F.col("e_rest")) & (F.col("upto") >= F.col("e_rest")))
            .select("members", (F.col("prefix") * (1 << BITS) + F.col("slot")).alias("prefix"), (F.col("e_rest") - F.col("upto") + F.col("words")).alias("left"))
        ).collect()  # a row a pattern at most
        edge = spark.createDataFrame([(r["members"], r["left"], r["prefix"]) for r in cut], "e_members array<string>, e_rest long, prefix long").coalesce(1)
    head = F.shiftrightunsigned("u", 64 - BITS * LEVELS)
    with_edge = lambda df: df.join(F.broadcast(edge), F.col("members").eqNullSafe(F.col("e_members")), "left")
    at_edge = F.coalesce((head == F.col("prefix")) & (F.col("rest") > 0), F.lit(False))
    order = Window.partitionBy("members").orderBy("u", "u2", "doc_id", "size")
    # Only documents of the edge's bucket, one in 16.7 million of a pattern and a few at least, are ordered.
    edge_rows = scratch.stash(
        with_edge(rows).filter(at_edge)
        .withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .select("u", "u2", F.greatest(F.lit(0), F.least(F.col("size"), F.col("e_rest") - F.col("before"))).cast("long").alias("edge_extra")),
        "edge")
    # Rows that repeat are alike in u and u2; where they meet the edge, each takes one of the shares found for them.
    repeats = edge_rows.groupBy("u", "u2").agg(F.max("edge_extra").alias("edge_extra"), F.count("*").alias("alike")).filter("alike = 1")
    final = with_edge(planned(derived if keep_columns else own))
    if repeats.count() == edge_rows.count():
        final = final.join(F.broadcast(repeats.select(F.col("u").alias("r_u"), F.col("u2").alias("r_u2"), "edge_extra")), at_edge & (F.col("u") == F.col("r_u")) & (F.col("u2") == F.col("r_u2")), "left")
    else:
        nth = Window.partitionBy("u", "u2").orderBy(F.lit(0))
        numbered = edge_rows.withColumn("nth", F.row_number().over(Window.partitionBy("u", "u2").orderBy(F.desc("edge_extra"))))
        inside = final.filter(at_edge).withColumn("n_th", F.row_number().over(nth)).join(
            numbered.select(F.col("u").alias("r_u"), F.col("u2").alias("r_u2"), "nth", "edge_extra"),
            (F.col("u") == F.col("r_u")) & (F.col("u2") == F.col("r_u2")) & (F.col("n_th") == F.col("nth")), "left").drop("nth", "n_th")
        final = final.filter(~at_edge).withColumns({"r_u": F.lit(0).cast("long"), "r_u2": F.lit(0).cast("long"), "edge_extra": F.lit(0).cast("long")}).unionByName(inside)
    whole = F.when((F.col("rest") > 0) & (F.col("prefix").isNull() | (head < F.col("prefix"))), F.col("size")).otherwise(F.lit(0))
    extra = F.when(at_edge, F.coalesce("edge_extra", F.lit(0))).otherwise(whole)
    passes = F.coalesce("passes", F.lit(0)).cast("long")
    return final.select(
        *(["doc"] if keep_columns else []), "doc_id", F.col("members").alias("sources"), "size",
        F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        (passes * F.col("size") + extra).cast("long").alias("taken"), passes.alias("passes"),
    )


def expand(mixed: DataFrame) -> DataFrame:
    """The documents of a mix with keep_columns, as often as it takes them; one taken in part is cut after its last word.
    A document without words comes as often as its source has whole passes."""
    text = F.col("doc.text")
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(F.col("passes")).cast("int")
    rows = mixed.select("doc", "size", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))).alias("copy"), "taken")
    left = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    cut = (left < F.col("size")) & (F.col("size") > 0)
    # pieces end where a word does, so the first ones joined are the text up to a word's end, white space as it was
    part = F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.greatest(left, F.lit(1))), "")
    names = [f.name for f in mixed.schema["doc"].dataType]
    out = {c: F.col(f"doc.`{c}`") for c in names}
    out["text"] = F.when(cut, part).otherwise(text)
    if "n_chars" in names:
        out["n_chars"] = F.when(cut, F.length(part)).otherwise(F.col("doc.n_chars")).cast(mixed.schema["doc"].dataType["n_chars"].dataType)
    return rows.select(*[out[c].alias(c) for c in names])
