"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints
differ in three bits or fewer, one segment differs in one bit or none. Each
segment value is a table key; lookups take the key itself and the keys one bit
away, and every match is checked on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from glintscan.llm.common import LOWER_BYTES, row_hash, stored
from glintscan.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
# From this many fingerprints with one segment value on, going over the points
# around each (about 1,600 rows a fingerprint) is less work than going over pairs.
DENSE = 3_000
BROADCAST_IDS = 4_000_000


def fingerprint_of(text: bytes) -> int:
    """64-bit SimHash as a signed integer; zero without words."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts, stops = (ends - sizes).tolist(), ends[SHINGLE - 1 :].tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for long texts
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(
        (fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts),
        pa.int64(),
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; a null text counts as empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fp"))


def _segments(nodes: DataFrame) -> DataFrame:
    """Two rows for each fingerprint: table key (with the segment's number) and the rest."""
    high, low = "shiftrightunsigned(fp, 32)", "fp & 4294967295L"
    return nodes.selectExpr(
        "fp", f"inline(array(struct({high} AS key, {low} AS rest),"
        f" struct(({low}) | 4294967296L AS key, {high} AS rest)))"
    )


def _bits(name: str = "key") -> Column:
    """The powers of two that are set in a 32-bit segment."""
    set_bits = f"filter(sequence(0, 31), b -> ({name} & shiftleft(1L, b)) <> 0)"
    return F.expr(f"transform({set_bits}, b -> shiftleft(1L, b))")


def _pair_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Links from table matches: same key, or a lookup with one set bit cleared.

    Of two keys one bit apart exactly one has the bit set, so clearing set bits
    visits each such pair once.
    """
    table = keyed.select("key", F.col("fp").alias("b"))
    ball = F.concat(F.array("key"), F.transform(_bits(), lambda b: F.col("key") - b))
    probes = keyed.select(F.col("fp").alias("a"), F.col("key").alias("own"), F.explode(ball).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return (
        probes.join(table, "key")
        .where(near & (F.col("a") != F.col("b")) & ((F.col("own") != F.col("key")) | (F.col("a") < F.col("b"))))
        .select("a", "b")
    )


def _star_links(keyed: DataFrame, dense: DataFrame) -> DataFrame:
    """The links of radius 3, up to connection, around keys with very many fingerprints.

    Instead of pairs, go over points z of the other segment. Same key: two
    fingerprints differ in at most 3 further bits exactly if some z is within 1
    of one and within 2 of the other, so all fingerprints within 2 of a z that
    has one within 1 are linked through it. Keys one bit apart: at most 2
    further bits, so some z is within 1 of both, and all within 1 of z are
    linked. A point has at most 529 (or 66) fingerprints around it, so no group
    is large, and rows grow in proportion to the fingerprints.
    """
    ones = "transform(sequence(0, 31), i -> shiftleft(1L, i))"
    twos = (
        "flatten(transform(sequence(1, 31), i -> transform(sequence(0, i - 1),"
        " j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    )
    inside = keyed.join(dense, "key", "left_semi")
    around = inside.selectExpr(
        "key", "0L AS bit", "fp", "rest",
        f"explode(concat(array(0L), {ones}, {twos})) AS flip",
    ).selectExpr("key", "bit", "fp", "rest ^ flip AS z", "bit_count(flip) < 2 AS close")
    # (key without the bit, bit) names the two keys on both sides of the bit.
    edges = dense.selectExpr("key AS hot", f"explode({ones}) AS bit")
    sides = edges.selectExpr("hot & ~bit AS base", "bit").distinct()
    members = sides.selectExpr("base", "bit", "explode(array(base, base | bit)) AS key")
    across = (
        keyed.join(members, "key")
        .selectExpr("base AS key", "bit", "fp", "rest", f"explode(concat(array(0L), {ones})) AS flip")
        .selectExpr("key", "bit", "fp", "rest ^ flip AS z", "true AS close")
    )
    group = W.partitionBy("key", "bit", "z")
    return (
        around.union(across)
        .select("fp", F.min("fp").over(group).alias("hub"), F.max("close").over(group).alias("linked"))
        .where("linked AND fp <> hub")
        .selectExpr("hub AS a", "fp AS b")
        .distinct()
    )


def links(nodes: DataFrame, radius: int = RADIUS, dense_from: int = DENSE) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints ``fp`` within the radius (3 at most)."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with one-bit lookups reach three bits at most")
    keyed = stored(_segments(nodes), "simhash-keys")
    dense = keyed.groupBy("key").count().where(F.col("count") >= dense_from).select("key")
    if radius < 3 or not dense.take(1):
        return _pair_links(keyed, radius)
    dense = stored(dense, "simhash-dense")
    sparse = keyed.join(dense, "key", "left_anti")
    return _pair_links(sparse, radius).union(_star_links(keyed, dense)).distinct()


def _labelled(docs: DataFrame, doc_id: str, text: str, radius: int, dense_from: int) -> DataFrame:
    """``doc_id, fp``, the ``label`` of the component (a fingerprint) and its ``component_id`` for every row."""
    marked = stored(fingerprints(docs, doc_id, text), "simhash-docs")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    labels = components(links(nodes.select("fp"), radius, dense_from))
    joined = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = stored(
        joined.join(smallest, "label").select(F.col("fp").alias("node"), "label", "component_id"),
        "simhash-named",
    )
    return marked.join(named, F.col("fp") == F.col("node")).select("doc_id", "fp", "label", "component_id")


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    dense_from: int = DENSE,
) -> DataFrame:
    """One row for each input row: ``doc_id``, ``fingerprint``, ``component_id``.

    Documents with equal fingerprints are one node, so copies make no pairs.
    ``component_id`` is the smallest doc_id of the component (null only if all
    its ids are null). Null and blank texts have fingerprint zero and link like
    any other; repeated rows keep their rows; an empty table gives an empty
    result; other columns are ignored.
    """
    return _labelled(docs, doc_id, text, radius, dense_from).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    dense_from: int = DENSE,
) -> DataFrame:
    """The row with the smallest id of each group, with all its columns.

    Where ids repeat, their rows are placed by id and fingerprint, and of
    several first rows of a group the one with the smallest hash stays. Rows
    with a null id stay only in groups of null ids, one in each.
    """
    groups = stored(_labelled(docs, doc_id, text, radius, dense_from), "simhash-groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    same = F.col(doc_id).eqNullSafe(F.col("__id"))
    repeated = groups.groupBy("doc_id").count().where("count > 1")
    repeated = stored(repeated.select(F.col("doc_id").alias("__id")), "simhash-repeated")
    lost = groups.where(~first).select(F.col("doc_id").alias("__id"))
    if not repeated.take(1):
        # Texts stay where they are unless the ids to drop are very many.
        if lost.count() <= BROADCAST_IDS:
            lost = F.broadcast(lost)
        return docs.join(lost, same, "left_anti")
    single = docs.join(lost.union(repeated).distinct(), same, "left_anti")
    marked = docs.join(repeated, same, "left_semi").select(
        "*", _fingerprints(F.col(text)).alias("__fp"), row_hash(docs).alias("__row")
    )
    firsts = groups.where(first).select(
        F.col("doc_id").alias("__id"), F.col("fp").alias("__of"), F.col("label").alias("__label")
    ).distinct()
    here = marked.join(firsts, same & (F.col("__fp") == F.col("__of"))).drop("__id", "__of", "__fp")
    # Groups that share their smallest id (or have none) are told apart by the label.
    least = here.groupBy(F.col(doc_id).alias("__id"), F.col("__label").alias("__in")).agg(
        F.min("__row").alias("__least")
    )
    chosen = same & (F.col("__label") == F.col("__in")) & (F.col("__row") == F.col("__least"))
    one = here.join(least, chosen, "left_semi")
    return single.union(one.dropDuplicates([doc_id, "__label"]).drop("__label", "__row"))
