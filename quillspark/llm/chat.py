"""Chat formatting of preference pairs. [native]

The longest common prefix of turns (equal in role and text, nulls equal to nulls) of the chosen and the rejected
conversation is rendered once as the prompt. What follows on each side is rendered as its completion, with a mask:
the spans of code points, end exclusive, that count in the loss. These are the texts of the assistant's turns and the
end mark after each; headers and the other roles' turns are masked.

Turns are ordered by turn, then role, then text; turns that are equal in all three are all kept. A null role is
rendered as "unknown", a null text as empty. A side without a conversation has no turns: the prompt is then empty and
the other side is a completion whole. An empty table gives none. A conversation is one row of the result, and so is the
unit that a task must hold; no other group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the chat format.
HEAD_OPEN, HEAD_CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _turns(side: str) -> Column:
    picked = F.collect_list(F.when(F.col("side") == side, F.struct("turn", "role", "text")))
    return F.transform(F.sort_array(picked), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD_OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit(HEAD_CLOSE))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_mask(turns: Column) -> Column:
    """"start-end" of what the assistant says, comma-joined."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("mask"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        span = F.concat(F.when(a["mask"] == "", "").otherwise(","), start.cast("string"), F.lit("-"), end.cast("string"))
        own = F.when(t["role"].eqNullSafe("assistant"), F.concat(a["mask"], span)).otherwise(a["mask"])
        return F.struct(end.alias("at"), own.alias("mask"))

    return F.aggregate(turns, zero, step, lambda a: a["mask"])


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side ('chosen' or 'rejected'), turn, role, text. A row for each pair_id, null too."""
    pairs = turns.filter(F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(
        _turns("chosen").alias("c"), _turns("rejected").alias("r")
    )
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, shorter), F.slice("r", 1, shorter), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    cut = pairs.withColumn("k", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    rest = lambda c: F.slice(c, F.col("k") + 1, F.greatest(F.lit(0), F.size(c) - F.col("k")))
    parts = cut.select("pair_id", "k", F.slice("c", 1, F.col("k")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select(
        "pair_id", F.col("k").cast("long").alias("n_prefix_turns"), render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"), loss_mask(F.col("c")).alias("chosen_mask"),
        render(F.col("r")).alias("rejected"), loss_mask(F.col("r")).alias("rejected_mask"),
    )
