"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A key descends from region to rack to shard. At each level every child draws an
exponential number with its weight as rate, from a hash of the key and the
child's own name, and the smallest wins: a child is chosen in proportion to its
weight, and a change of weight or a new child moves keys only to or from that
child's subtree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glintscan.llm.common import numbered, stored

SHARDS = 8
SLICES = 256
SLICE_ROWS = 500_000

Leaf = tuple[str, str, int, float]  # region, rack, shard, weight


def topology(shards: int, racks: int = 2, per_rack: int = 2, whole: int = SHARDS) -> list[Leaf]:
    """A tree for a shard count: the first ``whole`` shards fill regions of racks.

    Every further shard is a region of its own, so a larger count adds one
    branch at the root and no other weight changes: rows move only into it.
    """
    out = []
    for s in range(shards):
        if s < whole:
            region = s // (racks * per_rack)
            out.append((f"region{region}", f"rack{s // per_rack}", s, 1.0))
        else:
            out.append((f"added{s}", f"rack-added{s}", s, 1.0))
    return out


def _draw(key: Sequence[Column], name: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1] from a hash of key and child."""
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(name)), 11)
    return -F.log((bits.cast("double") + 1) / float(1 << 53)) / F.lit(weight)


def _chosen(key: Sequence[Column], children: list[tuple[str, float, Column]]) -> Column:
    """The outcome of the child with the smallest draw; ties take the earlier child."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, n, w).alias("d"), F.lit(i).alias("i")) for i, (n, w, _) in enumerate(children)]
    winner = F.least(*draws).getField("i")
    return reduce(
        lambda when, c: when.when(winner == c[0], c[1][2]), list(enumerate(children))[1:],
        F.when(winner == 0, children[0][2]),
    )


def shard_of(key: Sequence[Column], leaves: list[Leaf]) -> Column:
    """The shard of a key: region, then rack, then shard. Weights of 0 take nothing."""
    tree: dict[str, dict[str, list[tuple[int, float]]]] = {}
    for region, rack, shard, weight in leaves:
        if weight > 0:
            tree.setdefault(region, {}).setdefault(rack, []).append((shard, weight))
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaf = [(f"{region}/{rack}/{s}", w, F.lit(s)) for s, w in shards]
            inner.append((f"{region}/{rack}", sum(w for _, w in shards), _chosen(key, leaf)))
        regions.append((region, sum(w for _, w, _ in inner), _chosen(key, inner)))
    return _chosen(key, regions)


def sharded(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    leaves: list[Leaf] | None = None,
    grown: list[Leaf] | None = None,
    slices: int = SLICES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row for each input row under the law ``key``: doc_id and shard count decide.

    ``doc_id, size`` (UTF-8 bytes plus 1; null text: 1), ``text_crc32`` (null
    text: that of no bytes), ``law, shard, slot`` (gapless from 0 within the
    shard) and ``grown_shard`` (with one more shard). Null ids are one key.
    Equal rows get slots next to each other. Slots follow a hash of the row:
    each shard has ``slices`` slices, or as many as keep them at about
    ``slice_rows`` distinct rows if that is more, numbered side by side, whose
    totals give the first slot of each. Equal rows are counted before any shuffle, so
    copies do not meet in one task. An empty table gives an empty result; other
    columns are ignored.
    """
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    leaves = leaves or topology(shards)
    grown = grown or topology(shards + 1)
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = [F.col("doc_id")]
    placed = rows.select(
        "*",
        shard_of(key, leaves).cast("int").alias("shard"),
        shard_of(key, grown).cast("int").alias("grown_shard"),
    )
    placed = stored(placed, "shard-rows")
    slices = max(slices, -(-placed.count() // (slice_rows * shards)))
    number = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slices))
    placed = placed.withColumn("slice", number)
    earlier = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        placed.groupBy("shard", "slice").agg(F.sum("n").alias("rows"))
        # one row for each shard and slice, whatever the number of documents
        .select("shard", "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    )
    inside = W.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32")
    first = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("n") + F.col("base")
    ranged = placed.join(F.broadcast(bases), ["shard", "slice"]).withColumn("first", first)
    return numbered(ranged, "first", "(first + n - 1)", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
