"""What filters remove, alone and after each other, in every order.

Texts are read once, byte by byte, by a transducer given as a table: from the
state (between words, or in one) and a byte to the next state and what is
counted. Word spans go into a hash table whose matches are confirmed on their
bytes. The audit then needs only counts of documents by the filters they fail.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glintscan.llm.common import portions

FILTERS = "ABCDE"
MIN_WORDS = 50  # A
MIN_DISTINCT = 65  # B: per cent of the words
MAX_CAPITALS = 5  # C: per cent of the code points
SYMBOLS = "#$%&*|"  # D
BLOCK = 1 << 20  # bytes read at a time
LONG = 64  # longer words are compared as Python bytes

COUNTS = ["n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols"]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transducer: next state by byte, and two tables of counts by state and byte.

    Every byte but the six blanks leads into a word from either state, so the
    states of a whole block follow from its bytes at once. Counts are packed in
    halves of 64 bits: words and capitals, code points and symbols.
    """
    byte = np.arange(256)
    inside = ~((byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D)))
    capital = (byte >= 0x41) & (byte <= 0x5A)
    point = (byte < 0x80) | (byte >= 0xC0)  # all but continuation bytes
    symbol = np.isin(byte, list(SYMBOLS.encode()))
    start = np.concatenate([inside, np.zeros(256, bool)])  # state 0, then state 1
    packed = [
        start.astype(np.int64) << 32 | np.tile(capital, 2),
        np.tile(point, 2).astype(np.int64) << 32 | np.tile(symbol, 2),
    ]
    return inside.astype(np.uint8), packed[0], packed[1]


_NEXT, _WORDS, _POINTS = _tables()
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of 8 bytes


def _sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sums over the runs from ``start`` to ``stop``; empty runs are zero."""
    out = np.zeros(len(start), np.int64)
    some = stop > start
    if some.any():
        out[some] = np.add.reduceat(values, start[some])
    return out


def transduced(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, state: int = 0):
    """One pass over adjacent texts: word spans, packed counts by text, last state."""
    after = _NEXT[raw]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[start[start < len(raw)]] = 0
    if len(raw):
        before[0] = state
    step = before.astype(np.uint16) << 8 | raw
    counts = [_sums(table[step], start, stop) for table in (_WORDS, _POINTS)]
    first = np.flatnonzero(after > before)
    last = np.flatnonzero(after > np.append(before[1:] & after[1:], 0)) + 1
    return first, last, counts, int(after[-1]) if len(raw) else state


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def first_of_their_kind(raw: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks each span that no earlier span of its owner equals.

    ``raw`` ends with eight spare bytes. Spans take the slots of an open hash
    table; a span that finds its slot taken is compared with the holder's bytes
    and goes on to the next slot if they differ.
    """
    lanes = np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))
    lead = lanes[start] & _MASK[np.minimum(size, 8)]
    key = _mixed(lead + _mixed(owner.astype(np.uint64) << np.uint64(20) | size.astype(np.uint64)))
    longer, k = np.flatnonzero(size > 8), 8
    while len(longer):
        key[longer] = _mixed(key[longer] + (lanes[start[longer] + k] & _MASK[np.minimum(size[longer] - k, 8)]))
        k += 8
        longer = longer[size[longer] > k]

    def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = (lead[i] == lead[j]) & (size[i] == size[j]) & (owner[i] == owner[j])
        rest, k = np.flatnonzero(same & (size[i] > 8) & (i != j)), 8
        while len(rest):
            a, b = i[rest], j[rest]
            tail = _MASK[np.minimum(size[a] - k, 8)]
            differ = (lanes[start[a] + k] ^ lanes[start[b] + k]) & tail != 0
            same[rest[differ]] = False
            k += 8
            rest = rest[~differ & (size[a] > k)]
        return same

    bits = max(4, (2 * len(start)).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    slot = (key >> np.uint64(64 - bits)).astype(np.int64)
    first = np.zeros(len(start), bool)
    left = np.arange(len(start))
    while len(left):
        at = slot[left]
        free = table[at] < 0
        table[at[free][::-1]] = left[free][::-1]  # of several that claim a slot the earliest gets it
        holder = table[at]
        first[left[holder == left]] = True
        left = left[~equal(holder, left)]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return first


def _distinct(raw: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, set]:
    """Places of the first short words of their kind, and the long words with their owners."""
    size = last - first
    short = np.flatnonzero(size <= LONG)
    new = short[first_of_their_kind(raw, first[short], size[short], owner[short])]
    long = np.flatnonzero(size > LONG)
    return new, {(int(owner[i]), raw[first[i] : last[i]].tobytes()) for i in long}


def _measured(texts: pa.Array) -> np.ndarray:
    """Counts of whole texts that fit into a block, one row each."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.zeros(bounds[-1] - bounds[0] + 8, np.uint8)
    if len(raw) > 8:
        raw[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    first, last, counts, _ = transduced(raw[:-8], bounds[:-1], bounds[1:])
    n_words = counts[0] >> 32
    owner = np.repeat(np.arange(len(texts)), n_words)
    new, long = _distinct(raw, first, last, owner)
    distinct = np.bincount(owner[new], minlength=len(texts))
    for at, _ in long:
        distinct[at] += 1
    half = (1 << 32) - 1
    return np.column_stack([n_words, distinct, counts[0] & half, counts[1] >> 32, counts[1] & half])


def _measured_long(text: memoryview) -> np.ndarray:
    """Counts of one text, block by block; the state and a cut word pass on to the next block."""
    totals, seen, state, cut = np.zeros(4, np.int64), set(), 0, bytearray()
    for at in range(0, len(text), BLOCK):
        raw = np.zeros(min(BLOCK, len(text) - at) + 8, np.uint8)
        raw[:-8] = np.frombuffer(text[at : at + BLOCK], np.uint8)
        size = len(raw) - 8
        bounds = np.array([0, size])
        goes_on = state and _NEXT[raw[0]]
        if cut and not goes_on:
            seen.add(bytes(cut))
            cut.clear()
        first, last, counts, state = transduced(raw[:-8], bounds[:1], bounds[1:], state)
        totals += [counts[0][0] >> 32, counts[0][0] & (1 << 32) - 1, counts[1][0] >> 32, counts[1][0] & (1 << 32) - 1]
        if goes_on:  # the first word's beginning is in the block before
            cut += raw[: last[0]].tobytes()
            last = last[1:]
            if len(last) or not state:
                seen.add(bytes(cut))
                cut.clear()
        if state and len(last):
            cut += raw[first[-1] : size].tobytes()
            first, last = first[:-1], last[:-1]
        new, long = _distinct(raw, first, last, np.zeros(len(first), np.int64))
        seen.update(raw[a:b].tobytes() for a, b in zip(first[new].tolist(), last[new].tolist()))
        seen.update(word for _, word in long)
    if cut:
        seen.add(bytes(cut))
    return np.array([[totals[0], len(seen), *totals[1:]]])


def measured(texts: pa.Array) -> np.ndarray:
    """``COUNTS`` of every text, one row each; null counts as empty."""
    texts = pc.fill_null(texts, "")
    out = [np.zeros((0, len(COUNTS)), np.int64)]
    for part in portions(texts, BLOCK):
        long = len(part) == 1 and pc.binary_length(part)[0].as_py() > 2 * BLOCK
        out.append(_measured_long(memoryview(part[0].as_buffer())) if long else _measured(part))
    return np.concatenate(out)


def text_counts(text: Column) -> Column:
    """Words, distinct words, capitals A-Z, code points and symbols of whole texts."""

    @F.arrow_udf("struct<" + ", ".join(f"{n}: bigint" for n in COUNTS) + ">")
    def count(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in measured(texts).T], COUNTS)

    return count(text)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, the text's ``counts`` and ``fails``: bit 0 for filter A to bit 3 for D.

    A null text counts as empty. E needs the other documents; see ``audit``.
    """
    rules = [
        f"counts.n_words < {MIN_WORDS}",
        f"100 * counts.n_distinct < {MIN_DISTINCT} * counts.n_words",
        f"100 * counts.n_capitals > {MAX_CAPITALS} * counts.n_chars",
        "counts.n_symbols > 0",
    ]
    bits = " + ".join(f"if({rule}, {1 << i}, 0)" for i, rule in enumerate(rules))
    return docs.withColumn("counts", text_counts(F.col(text))).withColumn("fails", F.expr(bits))


def failing_groups(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """``part, fails, n, good, toxic``: documents by the set of filters that they fail.

    Only hashes of texts are shuffled. Copies are counted by text, part and
    label before the smallest id of each text is sought, so a text that a third
    of all rows hold is a row for each part and label there. Null ids spread
    over the hashes of their texts.
    """
    rows = failures(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
    ).select("doc_id", "part", "fails", F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.withColumn("salt", F.expr("if(doc_id IS NULL, 1 + pmod(xxhash64(digest), 65536), 0)"))
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("of"))
        .agg(
            F.max(F.expr("coalesce(quality = 1, false)")).alias("good"),
            F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"),
        )
        .withColumn("unsalted", F.lit(0).cast("bigint"))
    )
    rows = rows.join(marks, (rows.doc_id == marks.of) & (rows.salt == marks.unsalted), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)).cast("bigint") for c in ("good", "toxic")})
    kinds = ["digest", "part", "fails", "good", "toxic"]
    ids = rows.groupBy("doc_id", "salt", *kinds).agg(F.count("*").alias("n"))
    copies = ids.groupBy(*kinds).agg(
        F.sum("n").alias("n"),
        F.sum(F.expr("if(doc_id IS NULL, n, 0)")).alias("without_id"),
        F.min(F.expr("if(doc_id IS NULL, NULL, struct(doc_id, n))")).alias("lowest"),
    )
    copies = copies.withColumn("smallest", F.min("lowest.doc_id").over(W.partitionBy("digest")))
    copies = copies.withColumn("ok", F.expr("without_id + if(lowest.doc_id = smallest, lowest.n, 0)"))
    copies = copies.withColumn("ok", F.coalesce("ok", "without_id"))
    e = 1 << FILTERS.index("E")
    cells = copies.selectExpr(
        "part", "good", "toxic", f"inline(array(struct(fails, ok AS n), struct(fails + {e} AS fails, n - ok AS n)))"
    )
    return cells.groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic")
    )


def audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """Counts for every part, order of the filters and step.

    ``part, filter_order, step``; ``kept`` after the step, ``removed`` by it,
    ``redundant`` (fail it, but removed earlier), ``unique_fails`` (fail no
    other filter), ``good_lost`` and ``toxic_lost`` among the removed, and
    ``shapley``: what its filter removes, summed over all orders.

    Null texts are empty, null parts the empty string. A null id is neither
    smaller nor larger than another, so it never fails E, nor has it labels.
    Repeated rows count each; those with a text's smallest id do not fail E.
    Several labels of a document count as one: good or toxic if any says so. An
    empty table gives an empty result; other columns are ignored. In the result
    each part has as many rows as there are orders and steps, made from the at
    most 32 kinds of failure of the part.
    """
    groups = failing_groups(docs, labels, doc_id, text, part)
    parts = groups.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = parts.select("part", "cells", F.explode(F.lit(orders)).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )
    bit = "shiftleft(1, ascii(substring(filter_order, {}, 1)) - 65)"
    steps = steps.withColumn("own", F.expr(bit.format("step"))).withColumn(
        "earlier", F.expr(f"aggregate(sequence(1, step), 0, (a, i) -> a | {bit.format('i')}) - own")
    )

    def total(condition: str, value: str = "c.n"):
        return F.expr(f"aggregate(cells, 0L, (a, c) -> a + if({condition}, {value}, 0L))")

    here = "c.fails & own <> 0 AND c.fails & earlier = 0"
    every = factorial(len(FILTERS))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("c.fails & (own | earlier) = 0").alias("kept"),
        total(here).alias("removed"),
        total("c.fails & own <> 0 AND c.fails & earlier <> 0").alias("redundant"),
        total("c.fails = own").alias("unique_fails"),
        total(here, "c.good").alias("good_lost"),
        total(here, "c.toxic").alias("toxic_lost"),
        # Each of the filters that a document fails comes first in an equal share of the orders.
        total("c.fails & own <> 0", f"c.n * ({every} DIV bit_count(c.fails))").alias("shapley"),
    )
