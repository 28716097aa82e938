"""Preference formatting: one prompt, two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is its completion. A loss mask
gives the character ranges of prompt plus completion that belong to the
assistant's turns of the completion; all else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turn(t: Column) -> Column:
    return F.concat(
        F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE)
    )


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _mask(turns: Column, start: Column, role: str) -> Column:
    """Ranges [from, to) of the role's texts with their end marks."""
    state = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        stop = (acc["at"] + F.length(_turn(t))).cast("bigint")
        head = F.length(F.coalesce(t["role"], F.lit(""))) + len(OPEN) + len(MIDDLE)
        span = F.struct((acc["at"] + head).cast("bigint").alias("from"), stop.alias("to"))
        spans = F.when(t["role"] == role, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, state, add, lambda acc: acc["spans"])


def preference_pairs(
    pairs: DataFrame,
    key: str = "conv_id",
    chosen: str = "chosen",
    rejected: str = "rejected",
    role: str = "assistant",
) -> DataFrame:
    """``key, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    ``chosen`` and ``rejected`` are arrays of turns (role, text) in order; turns
    are equal if both are, nulls being equal. Null conversations count as
    empty, null roles and texts render as nothing. Equal conversations give
    empty completions. Repeated rows keep their rows; other columns are ignored.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")

    def turns(name: str) -> Column:
        plain = F.transform(name, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return F.coalesce(plain, none)

    a, b, n = F.col("a"), F.col("b"), F.col("n_common")
    shorter = F.least(F.size("a"), F.size("b"))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    differs = F.array_min(F.filter(places, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))))
    return (
        pairs.select(F.col(key).alias("key"), turns(chosen).alias("a"), turns(rejected).alias("b"))
        .withColumn("n_common", F.coalesce(differs, shorter))
        .withColumn("prompt", _rendered(F.slice(a, F.lit(1), n)))
        .withColumn("a", F.slice(a, n + 1, F.size(a)))
        .withColumn("b", F.slice(b, n + 1, F.size(b)))
        .select(
            F.col("key").alias(key),
            n.cast("bigint").alias("n_common"),
            "prompt",
            _rendered(a).alias("chosen"),
            _rendered(b).alias("rejected"),
            _mask(a, F.length("prompt"), role).alias("chosen_mask"),
            _mask(b, F.length("prompt"), role).alias("rejected_mask"),
        )
    )


def swapped_pairs(turns: DataFrame, key: str = "conv_id", role: str = "assistant") -> DataFrame:
    """Preference pairs from plain conversations: ``key, chosen, rejected``.

    The chosen one is the conversation; the rejected one has the role's last two
    turns exchanged, or with one such turn stops before it. Conversations
    without a turn of the role, and rows without a key, give no pair. Turns are
    ordered by number, then role and text; repeated rows stay. A conversation is
    one row, as it is rendered whole.
    """
    listed = (
        turns.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    own = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == role, i)), lambda i: i.isNotNull())
    last, before = F.get("own", F.size("own") - 1), F.get("own", F.size("own") - 2)

    def exchanged(t: Column, i: Column) -> Column:
        return F.when(i == last, F.get("turns", before)).when(i == before, F.get("turns", last)).otherwise(t)

    rejected = F.when(F.size("own") > 1, F.transform("turns", exchanged)).otherwise(F.slice("turns", F.lit(1), last))
    return (
        listed.withColumn("own", own)
        .where(F.size("own") > 0)
        .select(F.col("key").alias(key), F.col("turns").alias("chosen"), rejected.alias("rejected"))
    )
