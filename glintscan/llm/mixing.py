"""Mixing sources to target weights by pivotal dependent rounding.

A source that should give ``rate`` times its words takes every document
``floor(rate)`` times and once more with probability ``rate - floor(rate)``.
Pivotal rounding makes those fractional copies integral without losing words:
two documents pass words between them at random until one holds none or all of
its extra copy; the other goes on as residual. Leaves are hashed buckets of
documents; the residuals of the leaves meet in further levels until one per
source is left, which is rounded. So a source's words differ from its target by
half of one document at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glintscan.llm.common import WORD, numbered, row_hash, stored

# Weights of the sources by rank, repeating, and the most copies.
WEIGHTS = (5, 2, 1)
MOST = 3
LEAF = 4096
FAN_IN = 1024
BROADCAST_SOURCES = 200_000
BROADCAST_ROWS = 1_000_000

_STATE = "unit bigint, source_no bigint, size bigint, share double, draw bigint, bucket bigint"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, source_no, target`` from one row per source.

    Sources weigh by rank (code points, null last). A target stops at ``most``
    times the source's size; the excess goes to the others by weight until none
    is above. Sorted by size per weight the stopped sources come first: a
    source stops if its limit is below what it would get with all before it
    stopped. The windows run over one narrow row per source.
    """
    by_rank = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("source_no", F.row_number().over(by_rank).cast("bigint") - 1)
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn(
        "limit", most * F.col("source_size").cast("double")
    )
    rows = W.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before, after = rows.rowsBetween(W.unboundedPreceding, -1), rows.rowsBetween(0, W.unboundedFollowing)
    everywhere = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        F.sum(F.col("source_size")).over(everywhere) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    free = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level"))
    ranked = ranked.withColumn("final", F.first(free, ignorenulls=True).over(rows.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("limit"), F.col("final") * F.col("weight"))
    return ranked.select("source", "source_size", "source_no", F.coalesce(target, "limit").alias("target"))


def _uniform(draw: np.ndarray, level: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the draw and the level only."""
    x = draw.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(
    source: np.ndarray, size: np.ndarray, share: np.ndarray, draw: np.ndarray, level: int, last: bool
) -> np.ndarray:
    """Shares after pairing: all 0 or 1 but for one residual for each source at most.

    The open document meets the next one of its source; words pass between them
    at random, in the odds that keep each share as it is on average, until one
    share is 0 or 1; the other one stays open. The sum of share times size of a
    source does not change. Large documents come first, so the residual tends
    to be small. With ``last`` it goes to the nearer side, so that the source
    misses its target by half of that document at most.
    """
    chance = _uniform(draw, level).tolist()
    sources, sizes, shares = source.tolist(), size.tolist(), share.tolist()
    held = -1
    for i in [*np.lexsort((draw, -size, source)).tolist(), -1]:
        if held >= 0 and (i < 0 or sources[i] != sources[held]):
            if last:
                shares[held] = float(shares[held] >= 0.5)
            held = -1
        if i < 0 or not 0.0 < shares[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        p, q, v, w = shares[held], shares[i], sizes[held], sizes[i]
        rise, fall = min((1 - p) * v, q * w), min(p * v, (1 - q) * w)
        if chance[i] * (rise + fall) < fall:  # words pass to the open document
            full = (1 - p) * v <= q * w
            p, q = (1.0, q - (1 - p) * v / w) if full else (p + q * w / v, 0.0)
        else:
            empty = p * v <= (1 - q) * w
            p, q = (0.0, q + p * v / w) if empty else (p - (1 - q) * w / v, 1.0)
        shares[held], shares[i] = (float(round(x)) if abs(x - round(x)) < 1e-12 else x for x in (p, q))
        if 0.0 < shares[i] < 1.0:
            held = i
        elif not 0.0 < shares[held] < 1.0:
            held = -1
    return np.array(shares, np.float64)


def _settled(level: int, last: bool):
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        columns = [group[c].to_numpy() for c in ("source_no", "size", "share", "draw")]
        return group.assign(share=pivot(*columns, level, last))

    return settle


def _reduced(open_units: DataFrame, count: int, leaf: int, fan_in: int) -> DataFrame:
    """``unit, share`` with every share 0 or 1, through the levels of the tree."""
    buckets = max(1, math.ceil(count / leaf))
    rows = open_units.withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    done, level = None, 0
    while True:
        last = buckets == 1
        # A leaf has rows of all sources; above, a node has one residual of a leaf each.
        keys = ["source_no", "bucket"] if level else ["bucket"]
        rows = stored(rows.groupBy(*keys).applyInPandas(_settled(level, last), _STATE), "mix-level")
        whole = rows.where("share IN (0D, 1D)").select("unit", "share")
        done = done.union(whole) if done else whole
        if last:
            return done
        buckets, level = math.ceil(buckets / fan_in), level + 1
        rows = rows.where("share NOT IN (0D, 1D)").withColumn("bucket", F.pmod("bucket", F.lit(buckets)))


def copies(
    rows: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    leaf: int = LEAF,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """How often the mix takes each distinct row of ``(row_key, source, size)``.

    Returns ``row_key, source, size, n`` (equal rows), ``source_size, target``
    and ``extra`` (fractional copies won by those rows together) and ``whole``
    (copies that each takes). All draws are hashes of the row, so reruns agree
    whatever the partitions.
    """
    units = stored(rows.groupBy("row_key", "source", "size").agg(F.count("*").alias("n")), "mix-units")
    totals = stored(
        units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "mix-sources"
    )
    targets = stored(source_targets(totals, weights, most), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = (
        units.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("whole", F.floor(rate))
        .withColumn("share", rate - F.floor(rate))
        .withColumn("unit", F.xxhash64("row_key", "source", "size"))
    )
    opened = (
        planned.where("share > 0 AND size > 0")
        .select("unit", "source_no", "size", "share", "n")
    )
    opened = numbered(opened, "1L", "n", "copy").select(
        "unit", "source_no", "size", "share", F.xxhash64("unit", "copy").alias("draw")
    )
    count = planned.where("share > 0 AND size > 0").agg(F.sum("n")).first()[0] or 0
    won = _reduced(opened, count, leaf, fan_in).where("share = 1D")
    won = won.groupBy(F.col("unit").alias("winner")).agg(F.count("*").alias("extra"))
    return planned.join(won, F.col("unit") == F.col("winner"), "left").select(
        "row_key", "source", "size", "n", "source_size", "target", "whole",
        F.coalesce("extra", F.lit(0)).alias("extra"),
    )


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """One row for each input row: ``doc_id, size, source_size, target, taken``.

    ``size`` counts words (null text: 0), ``target`` is the source's and
    ``taken`` the words that the mix takes from the row, repeats counted. A null
    source is a source of its own and comes last. Rows of size 0 take nothing.
    Equal rows share the extra copies they win, the first ones taking them. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.col(doc_id).alias("row_key"), F.col(source).alias("source"), words(F.col(text)).alias("size")
    )
    return numbered(copies(rows, weights, most), "1L", "n", "copy").select(
        F.col("row_key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("whole") + (F.col("copy") <= F.col("extra")).cast("bigint"))).alias("taken"),
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """The mixed table: every row as often as the mix takes it, with all its columns.

    Rows are told apart by a hash of all their columns. Only rows taken at
    least once are joined back; rows that are equal in every column go through
    one representative, so no group of copies meets in one task.
    """
    keyed = docs.withColumn("__row", row_hash(docs))
    rows = keyed.select(
        F.col("__row").alias("row_key"), F.col(source).alias("source"), words(F.col(text)).alias("size")
    )
    plan = copies(rows, weights, most).withColumn("times", F.col("n") * F.col("whole") + F.col("extra"))
    plan = stored(plan.where("times > 0").select("row_key", "n", "times"), "mix-plan")

    def taken(rows: DataFrame, which: str, how: str) -> DataFrame:
        part = plan.where(which).select(F.col("row_key").alias("__key"), F.col("times").alias("__times"))
        return rows.join(part.hint(how), F.col("__row") == F.col("__key"))

    # Most rows are taken: both sides are shuffled, at any size. Repeated rows are
    # few as a rule and then broadcast.
    many = "broadcast" if plan.where("n > 1").count() <= BROADCAST_ROWS else "merge"
    single = taken(keyed, "n = 1", "merge")
    repeated = taken(keyed, "n > 1", many).dropDuplicates(["__row"])
    out = single.union(repeated)
    return numbered(out, "1L", "__times", "__copy").select(*[F.col(c) for c in docs.columns])
