"""Importance resampling towards a target distribution of hashed word runs.

Features are runs of consecutive words, hashed into buckets by CRC-32. The
gain of a bucket compares its share in a target table with that in all
documents; a document's weight is the sum of its gains, and documents are drawn
without replacement by weight plus Gumbel noise.

The vocabulary has a head and a tail. Frequent words go out with their CRC
states, frequent pairs with their buckets; what is not among them takes its CRC
directly, going on from the state of the words before. Both feed the same exact
bucket totals, so the head only saves work.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import LOWER_BYTES, portions, stored
from glintscan.operators.ordered import with_row_number

MAX_N = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
HEAD_WORDS = 1 << 15  # most words whose states every task holds
HEAD_PAIRS = 1 << 16
HEAD_LENGTH = 64  # bytes; longer words are always tail
SUMMARY = 4  # a task counts up to so many times the head before it trims its counts

_WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(c if c in _WORD_BYTES else 0x20 for c in LOWER_BYTES)


@dataclass
class Head:
    """Frequent words with their CRC states, and frequent pairs of them with their buckets."""

    words: pa.Array
    states: np.ndarray
    pairs: np.ndarray  # sorted: number of the first word times the number of words, plus that of the second
    pair_states: np.ndarray


NO_HEAD = Head(pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint32))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts one after another, and the number of words of each."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes() if bounds[-1] > bounds[0] else b""
    offsets = pa.py_buffer((bounds - bounds[0]).tobytes())
    folded = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(data.translate(_FOLD))])
    lists = pc.ascii_split_whitespace(folded)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(flat), 0)
    owner = owner[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real), np.bincount(owner, minlength=len(texts)).astype(np.int64)


def word_states(words: pa.Array, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """CRC states of distinct words, and their numbers in the head (-1: tail)."""
    place = pc.fill_null(pc.index_in(words, value_set=head.words), -1).to_numpy().astype(np.int64)
    state = np.zeros(len(words), np.uint32)
    state[place >= 0] = head.states[place[place >= 0]]
    tail = np.flatnonzero(place < 0)
    state[tail] = [zlib.crc32(w.encode()) for w in words.take(pa.array(tail)).to_pylist()]
    return state, place


def feature_states(texts: pa.Array, max_n: int, head: Head) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to ``max_n`` words: the CRC of each run in order, and each text's number of runs.

    A run's CRC goes on from that of the run without its last word; it is taken
    once for each distinct pair of the two.
    """
    flat, sizes = split_words(texts)
    coded = flat.dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    states, place = word_states(words, head)
    yield states[at], sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    runs, run_states = at, states
    spaced = [b" " + w.encode() for w in words.to_pylist()] if max_n > 1 else []
    for n in range(2, max_n + 1):
        runs = runs[:-1] if len(runs) else runs
        inside = owner[: len(runs)] == owner[n - 1 :] if len(runs) else np.zeros(0, bool)
        pair = runs * max(1, len(words)) + at[n - 1 :]
        kinds, runs = np.unique(pair, return_inverse=True)
        first, last = np.divmod(kinds, max(1, len(words)))
        known = np.zeros(len(kinds), bool)
        new = np.zeros(len(kinds), np.uint32)
        if n == 2 and len(head.pairs):
            key = np.where((place[first] >= 0) & (place[last] >= 0), place[first] * len(head.words) + place[last], -1)
            spot = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
            known = head.pairs[spot] == key
            new[known] = head.pair_states[spot[known]]
        for i in np.flatnonzero(~known).tolist():
            new[i] = zlib.crc32(spaced[last[i]], int(run_states[first[i]]))
        run_states = new
        yield run_states[runs[inside]], np.maximum(sizes - (n - 1), 0)


class Frequent:
    """Counts of the frequent items of a stream in bounded memory (Misra and Gries).

    When there are too many items, the count of the first one beyond ``most`` is
    taken off all. What occurs more often than that lets an item keep a count.
    """

    def __init__(self, most: int):
        self.most = most
        self.counts: Counter = Counter()

    def add(self, items: list, n: list[int]) -> None:
        counts = self.counts
        for item, k in zip(items, n):
            counts[item] += k
        if len(counts) > SUMMARY * self.most:
            values = np.fromiter(counts.values(), np.int64, len(counts))
            off = int(np.partition(values, -self.most - 1)[-self.most - 1])
            self.counts = Counter({w: k - off for w, k in counts.items() if k > off})

    def top(self) -> list[tuple]:
        return self.counts.most_common(self.most)


def most_frequent(counts: DataFrame, key: str, most: int) -> list:
    """At most ``most`` keys of ``key, n`` rows from the top; only rows that are taken reach the driver.

    Counts are binned, 16 bins a doubling; whole bins are taken as long as they
    fit, and any rows of the next one.
    """
    if not most:
        return []
    binned = stored(counts.withColumn("bin", F.floor(F.log2("n") * 16)), "importance-counts")
    left, rows = most, []
    bins = binned.groupBy("bin").count().orderBy(F.desc("bin")).collect()  # under 1,024 rows
    for lowest, row in enumerate(bins):
        if row["count"] > left:
            rows = binned.where(F.col("bin") == row["bin"]).limit(left).collect()
            break
        left -= row["count"]
    else:
        lowest = len(bins)
    if lowest:
        rows += binned.where(F.col("bin") >= bins[lowest - 1]["bin"]).collect()
    return [r[key] for r in rows]


def frequent_words(docs: DataFrame, text: str, most: int) -> list[str]:
    """At most ``most`` frequent words of all texts, by counts of all tasks together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Frequent(most)
        for batch in batches:
            for part in portions(pc.fill_null(batch.column(0), "")):
                words = split_words(part)[0]
                found = pc.value_counts(words.filter(pc.less_equal(pc.binary_length(words), HEAD_LENGTH)))
                held.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        top = held.top()
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"]
        )

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return most_frequent(parts.groupBy("word").agg(F.sum("n").alias("n")), "word", most)


def frequent_pairs(docs: DataFrame, text: str, words: list[str], most: int) -> list[tuple[int, int]]:
    """At most ``most`` frequent pairs of adjacent frequent words, by their numbers."""
    held_words = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = pa.array(held_words.value, pa.string()), Frequent(most)
        for batch in batches:
            for part in portions(pc.fill_null(batch.column(0), "")):
                flat, sizes = split_words(part)
                place = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(part)), sizes)
                both = (owner[1:] == owner[:-1]) & (place[1:] >= 0) & (place[:-1] >= 0)
                pair, n = np.unique(place[:-1][both] * len(known) + place[1:][both], return_counts=True)
                held.add(pair.tolist(), n.tolist())
        top = held.top()
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.int64()), pa.array([n for _, n in top], pa.int64())], ["pair", "n"]
        )

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "pair bigint, n bigint")
    top = most_frequent(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pair", most)
    return [divmod(pair, len(words)) for pair in top]


def head_of(docs: DataFrame, text: str, max_n: int, words: int, pairs: int) -> Head:
    """The head of the vocabulary: bounded by its two sizes and the length of a word."""
    top = frequent_words(docs, text, words)
    states = [zlib.crc32(w.encode()) for w in top]
    couples = frequent_pairs(docs, text, top, pairs) if max_n > 1 and top else []
    couples = sorted(couples)
    return Head(
        pa.array(top, pa.string()),
        np.array(states, np.uint32),
        np.array([a * len(top) + b for a, b in couples], np.int64),
        np.array([zlib.crc32(b" " + top[b].encode(), states[a]) for a, b in couples], np.uint32),
    )


def bucketed(docs: DataFrame, doc_id: str, text: str, max_n: int, buckets: int, head: Head) -> DataFrame:
    """``row, doc_id, n_words, n_features, buckets`` (32-bit numbers) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(head)
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            start = 0
            for part in portions(pc.fill_null(batch.column(1), "")):
                levels = list(feature_states(part, max_n, held.value))
                sizes = [n for _, n in levels]
                cells = [np.split((s % buckets).astype(kind), np.cumsum(n)[:-1]) for s, n in levels]
                packed = [b"".join(c.tobytes() for c in of) for of in zip(*cells)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(part))),
                        batch.column(0).slice(start, len(part)),
                        pa.array(sizes[0]),
                        pa.array(sum(sizes)),
                        pa.array(packed, pa.binary()),
                    ],
                    ["row", "doc_id", "n_words", "n_features", "buckets"],
                )
                start, row = start + len(part), row + len(part)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    of = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        features, f"row bigint, doc_id {of}, n_words bigint, n_features bigint, buckets binary"
    )


def bucket_totals(features: DataFrame, buckets: int) -> np.ndarray:
    """Features of all documents by bucket: a row a bucket and task is shuffled."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount(np.frombuffer(cell.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    parts = features.select("buckets").mapInArrow(add, "bucket bigint, n bigint")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln((t+1)(S+B) / ((s+1)(T+B))))`` for each of the B buckets."""
    b = len(source)
    all_s, all_t = float(source.sum() + b), float(target.sum() + b)
    ratio = [(float(t) + 1) * all_s / ((float(s) + 1) * all_t) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weight_of(buckets_column: str, gains: np.ndarray, docs: DataFrame) -> Column:
    """The sum of gains over a document's features."""
    held = docs.sparkSession.sparkContext.broadcast(gains)
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    @F.arrow_udf("bigint")
    def weigh(cells: pa.Array) -> pa.Array:
        g = held.value
        return pa.array([int(g[np.frombuffer(c.as_buffer(), kind)].sum()) for c in cells], pa.int64())

    return weigh(F.col(buckets_column))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the SHA-256 of ``seed:doc_id``; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    head_words: int = HEAD_WORDS,
    head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document.

    Of the documents with ``min_words`` words or more ``percent`` in a hundred
    are drawn, rounded down: those of the highest scores, ties to the smaller
    id, null ids last, equal rows in any order. ``rank`` is 1 for the first and
    null for those not drawn. Null texts have no words; a document without
    features has weight 0. Repeated rows each keep their row. An empty target
    leaves every bucket its smoothed share; an empty table gives an empty result.
    Other columns are ignored.

    Texts are read twice: for the head, then for the buckets, which are written
    to the shared folder (two bytes a feature) and give totals and weights. The
    order is a range shuffle of narrow rows.
    """
    head = head_of(docs, text, max_n, head_words, head_pairs)
    features = stored(bucketed(docs, doc_id, text, max_n, buckets, head), "importance-features")
    wanted = bucketed(target, target_text, target_text, max_n, buckets, NO_HEAD)
    gains = bucket_gains(bucket_totals(features, buckets), bucket_totals(wanted, buckets))

    weighed = features.withColumn("weight", weight_of("buckets", gains, docs)).drop("buckets")
    weighed = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    short = F.col("n_words") < min_words
    drawn = features.where(~short).count() * percent // 100
    keyed = weighed.withColumns(
        {"__late": short, "__down": -F.col("score"), "__no_id": F.col("doc_id").isNull()}
    )
    ranked = with_row_number(keyed, ["__late", "__down", "__no_id", "doc_id", "row"], "rank")
    return ranked.select(
        "doc_id",
        "n_features",
        "weight",
        "score",
        F.when(~short & (F.col("rank") <= drawn), F.col("rank")).cast("bigint").alias("rank"),
    )
