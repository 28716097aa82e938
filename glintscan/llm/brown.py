"""Brown class-based bigrams: exchange clustering, then class and word probabilities.

Words of the training documents are counted; the most frequent ones are put
into classes by exchange clustering over their bigram counts. All other training
words start in classes by their last two characters and then move by exchange
too, in sweeps of their own: a block of texts sends its words with their
neighbours' classes to the words' buckets and gets their counts and classes
back. Words unseen in training stay with their last characters. The probability
of a word after another is

    weight * P(class | class before) * P(word | class) + (1 - weight) * P(word)

with absolute discounting inside the classes, whose mass goes to unknown words.
Counts, bigrams and class statistics cover all training documents; tables that
are broadcast have a fixed number of rows, the classes of all words never do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glintscan.llm.bpe_codec import packed, unpacked
from glintscan.llm.common import portions, stored
from glintscan.session import run_dir

CLUSTERED = 4096  # most frequent words, which move first, in steps
FREQUENT = 65_536  # no task holds more words than this
CLASSES = 64  # classes of the clustered words
ENDINGS = 64  # classes where all other words start
SWEEPS = 3  # of the clustered words, then of all others
PARTS = 5  # of the clustered words a fifth moves at a time
WEIGHT = 0.9
DISCOUNT = 0.5
END = "\n"  # the end token: no word holds a blank
BLOCK = 1 << 20  # bytes of text in a block
MOST_BUCKETS = 8192
LEVELS = 5  # all moves of a sweep, a half, ... a sixteenth
LONG = 64  # bytes of a word
SMALL = 8  # counts whose gains stand in a table
PORTIONS = 32  # of a bucket's words, which move one after another
PAIRS = 1 << 20  # bigrams that a task adds up before they leave
AT_ONCE = 4096  # neighbours of words handled at a time


def _lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words one after another, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(flat), 0)
    owner = owner[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real), np.bincount(owner, minlength=len(texts)).astype(np.int64)


def _ending_numbers(words: pa.Array, endings: int) -> np.ndarray:
    """A class number for each word by its last two characters."""
    tails = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    number = np.fromiter(
        (crc32(t.encode()) % endings for t in tails.dictionary.to_pylist()), np.int64, len(tails.dictionary)
    )
    return number[tails.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ 0xEDB88320, out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def crcs(words: pa.Array) -> np.ndarray:
    """The CRC-32 of each word's bytes: of all words together, byte after byte."""
    if not len(words):
        return np.zeros(0, np.uint32)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    sizes, at = sizes[order], at[:-1][order].astype(np.int64)
    long = int(np.searchsorted(-sizes, -LONG))  # these one by one
    state = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for i in range(int(sizes[long]) if long < len(sizes) else 0):
        part = slice(long, int(np.searchsorted(-sizes, -i)))
        here = state[part]
        state[part] = _CRC[(here ^ data[at[part] + i]) & 255] ^ here >> 8
    state = ~state
    for i in range(long):
        state[i] = crc32(data[at[i] : at[i] + sizes[i]])
    out = np.empty_like(state)
    out[order] = state
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """``word, n`` over all training texts; the end token counts once a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch.column(0), 2 << 20):
                values = pc.value_counts(_lists(part)[0])
                words = pa.concat_arrays([values.field("values"), pa.array([END])])
                counts = pa.concat_arrays([values.field("counts"), pa.array([len(part)], pa.int64())])
                yield pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

    parts = train.select(F.col(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The frequent words, most frequent first, with their counts."""

    words: pa.Array
    counts: np.ndarray
    clustered: int
    classes: int
    endings: int

    @property
    def size(self) -> int:
        """Unit numbers: clustered words, endings, the end token."""
        return self.clustered + self.endings + 1


def bigram_profiles(train: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """``block_profiles`` of a table all of whose rows train."""
    rows = train.select(F.lit(0).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.lit(True).alias("train"))
    buckets = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return block_profiles(text_blocks(rows, vocabulary, buckets), vocabulary)


def _added(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, in order, with the sum of its counts."""
    order = np.argsort(pair)
    pair, n = pair[order], n[order].astype(np.int64)
    heads = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    return pair[heads], np.add.reduceat(n, heads)


def block_profiles(blocks: DataFrame, vocabulary: Vocabulary, most: int = PAIRS) -> DataFrame:
    """One row a unit: ``unit, side, others, counts``; side 0 what comes before, 1 after.

    A row has at most as many entries as there are units, whatever the corpus.
    A task adds up the bigrams of its blocks, about ``most`` of them at a time, and
    deals them by unit and side, at most as many for each as there are units.
    """
    spark = blocks.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)
    size = vocabulary.size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (2 * size * size >> 22) + 1)  # 32 MB of counts each

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value

        def dealt(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            before, after = np.divmod(pair, size)
            row, other, n = np.r_[2 * after, 2 * before + 1], np.r_[before, after], np.r_[n, n]
            part, key = row % parts, row // parts * size + other
            order = np.argsort(part, kind="stable")
            stops = np.cumsum(np.bincount(part, minlength=parts)).tolist()
            runs = [(i, order[a:b]) for i, (a, b) in enumerate(zip([0, *stops], stops)) if a < b]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in runs], pa.int32()), pa.array([packed(key[x]) for _, x in runs], pa.binary()),
                    pa.array([packed(n[x]) for _, x in runs], pa.binary()),
                ],
                ["part", "keys", "counts"],
            )

        pair = n = np.zeros(0, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                endings = _ending_numbers(_unpacked_words(row["words"]), v.endings)
                unit = np.r_[np.arange(v.clustered), size - 1, v.clustered + endings]
                unit = unit[unpacked(row["tokens"])[np.repeat(np.array(row["train"], bool), unpacked(row["sizes"]))]]
                if len(unit):
                    new, times = np.unique(np.r_[size - 1, unit[:-1]] * size + unit, return_counts=True)
                    pair, n = _added(np.r_[pair, new], np.r_[n, times])
                if len(pair) > most:
                    yield dealt(pair, n)
                    pair = n = np.zeros(0, np.int64)
        if len(pair):
            yield dealt(pair, n)

    def gather(rows: pa.Table) -> pa.Table:
        total = np.zeros(((2 * size - 1) // parts + 1) * size, np.int64)
        for keys, counts in zip(rows["keys"], rows["counts"]):
            total[unpacked(keys.as_py())] += unpacked(counts.as_py())  # no key twice in a cell
        key = np.flatnonzero(total)
        row = key // size * parts + rows["part"][0].as_py()
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        entries = pa.StructArray.from_arrays([pa.array((key % size).astype(np.int32)), pa.array(total[key])], ["other", "n"])
        near = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(row)].astype(np.int32)), entries)
        row = row[heads]
        return pa.table([pa.array(row // 2), pa.array((row % 2).astype(np.int32)), near], ["unit", "side", "near"])

    near = "array<struct<other int, n bigint>>"
    dealt = blocks.select("train", "sizes", "tokens", "words").mapInArrow(count, "part int, keys binary, counts binary")
    return dealt.groupBy("part").applyInArrow(gather, f"unit bigint, side int, near {near}")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(matrix: np.ndarray, own: int, before: np.ndarray, after: np.ndarray, self_count: float, movable: int) -> int:
    """The class where a word adds most to the class bigram likelihood; ties stay.

    ``matrix`` counts class bigrams; ``before`` and ``after`` the word's
    neighbours by class, without the word itself.
    """
    m = matrix.copy()
    m[own, :] -= after
    m[:, own] -= before
    m[own, own] -= self_count
    # What leads to the word and follows it stays in the margins of those classes.
    rows, columns = m.sum(1) + before, m.sum(0) + after
    b = np.arange(movable)
    gain = (_xlogx(m[b, :] + after) - _xlogx(m[b, :])).sum(1)
    gain += (_xlogx(m[:, b] + before[:, None]) - _xlogx(m[:, b])).sum(0)
    # The diagonal cell gets both and the word's own repeats.
    d = m[b, b]
    gain += _xlogx(d + after[b] + before[b] + self_count) + _xlogx(d)
    gain -= _xlogx(d + after[b]) + _xlogx(d + before[b])
    n_after, n_before = after.sum() + self_count, before.sum() + self_count
    gain -= _xlogx(rows[b] + n_after) - _xlogx(rows[b])
    gain -= _xlogx(columns[b] + n_before) - _xlogx(columns[b])
    top = int(np.argmax(gain))
    return top if gain[top] > gain[own] + 1e-9 * abs(gain[own]) else own


def class_matrix(profiles: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Bigram counts between classes; at most k * k rows reach the driver."""
    held = profiles.sparkSession.sparkContext.broadcast(classes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            near = batch.column(1)
            unit = np.repeat(batch.column(0).to_numpy(), np.diff(near.offsets.to_numpy()))
            other, n = (near.flatten().field(i).to_numpy() for i in range(2))
            np.add.at(total, held.value[unit] * k + held.value[other], n)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    cells = profiles.where("side = 1").select("unit", "near").mapInArrow(add, "cell bigint, n bigint")
    out = np.zeros(k * k, np.float64)
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(k, k)


def log_likelihood(matrix: np.ndarray) -> float:
    """The part of the class bigrams' log likelihood that depends on the classes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def exchange(profiles: DataFrame, vocabulary: Vocabulary, sweeps: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and the class bigram counts, after the sweeps.

    In each step a part of the clustered words move to their best class given
    the counts at its start; each task works on the profiles of its words. Only
    the class of each clustered word returns to the driver. Words that move at
    once can spoil each other's gain: the step counts only if the likelihood
    rises, else every second of the moves is taken back, and so on. ``seen``
    gets the likelihood after each step, which never falls.
    """
    spark = profiles.sparkSession
    c, e = vocabulary.classes, vocabulary.endings
    k = c + e + 1
    classes = np.r_[np.arange(vocabulary.clustered) % c, c + np.arange(e + 1)].astype(np.int64)
    both = profiles.where(F.col("unit") < vocabulary.clustered).groupBy("unit").agg(
        F.flatten(F.collect_list(F.transform("near", lambda x: F.struct(F.col("side"), x["other"].alias("other"), x["n"].alias("n"))))).alias("near")
    )
    both = stored(both, "brown-profiles")
    matrix = class_matrix(profiles, classes, k)
    best = log_likelihood(matrix)
    for step in range(sweeps * PARTS):
        state = spark.sparkContext.broadcast((classes, matrix))

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes, matrix = state.value
            for batch in batches:
                near, out = batch.column(1), []
                stops = near.offsets.to_numpy()
                flat = near.flatten()
                side, other, n = (flat.field(i).to_numpy() for i in range(3))
                for unit, i, j in zip(batch.column(0).to_pylist(), stops - stops[0], stops[1:] - stops[0]):
                    s, o, x = side[i:j], other[i:j], n[i:j].astype(np.float64)
                    alone = o == unit
                    repeats = x[alone & (s == 1)].sum()
                    before, after = (
                        np.bincount(classes[o[(s == d) & ~alone]], x[(s == d) & ~alone], k) for d in (0, 1)
                    )
                    out.append(best_class(matrix, classes[unit], before, after, repeats, c))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(out, pa.int64())], ["unit", "class"]
                )

        moving = both.where(F.col("unit") % PARTS == step % PARTS)
        moves = [
            (r["unit"], r["class"])
            for r in moving.mapInArrow(move, "unit bigint, class bigint").collect()
            if classes[r["unit"]] != r["class"]
        ]
        moves.sort()
        while moves:
            tried = classes.copy()
            for unit, to in moves:
                tried[unit] = to
            counted = class_matrix(profiles, tried, k)
            if (got := log_likelihood(counted)) > best:
                classes, matrix, best = tried, counted, got
                break
            moves = moves[::2] if len(moves) > 1 else []
        if seen is not None:
            seen.append(best)
    return classes, matrix


@dataclass
class Model:
    """All that scoring needs, of fixed size."""

    vocabulary: Vocabulary
    classes: np.ndarray  # of each unit
    transition: np.ndarray  # P(class | class before), smoothed by the class shares
    class_tokens: np.ndarray
    unknown: np.ndarray  # P(unknown word | class before)
    train_tokens: int
    types: int
    weight: float

    def base(self, count: np.ndarray | float) -> np.ndarray | float:
        return (count + 0.5) / (self.train_tokens + 0.5 * (self.types + 1))


def frequent_words(counts: DataFrame, most: int) -> list:
    """The most frequent words, at most ``most``, in order of count, then word.

    Counts are binned (16 bins a doubling); whole bins are taken from the top
    as long as they fit, of the next one those first in order. Each task
    returns only words that are taken.
    """
    words = counts.where(F.col("word") != END).withColumn("bin", F.floor(F.log2("n") * 16))
    taken, lowest, cut = 0, None, None
    for row in words.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # under 1,024 rows
        if taken + row["count"] > most:
            cut = row["bin"]
            break
        taken += row["count"]
        lowest = row["bin"]
    rows = [] if lowest is None else words.where(F.col("bin") >= lowest).collect()
    if cut is not None and taken < most:
        first = words.where(F.col("bin") == cut).orderBy(F.desc("n"), "word").limit(most - taken)
        rows += stored(first, "brown-cut").collect()
    return sorted(rows, key=lambda r: (-r["n"], r["word"]))


def _add_rows(total: np.ndarray, owner: np.ndarray, table: np.ndarray, row: np.ndarray) -> None:
    """Add rows of a table to those of their owners, which come in order."""
    if len(owner):
        sizes = np.bincount(owner)
        by = np.argsort(-sizes, kind="stable")  # who has most rows first
        first, sizes = (np.cumsum(sizes) - sizes)[by], sizes[by]
        sums = total[by]
        for turn in range(int(sizes[0])):  # no owner twice
            last = int(np.searchsorted(-sizes, -turn))
            sums[:last] += table[row[first[:last] + turn]]
        total[by] = sums


def best_classes(
    matrix: np.ndarray, own: np.ndarray, owner: np.ndarray, cell: np.ndarray, n: np.ndarray, movable: int
) -> np.ndarray:
    """``best_class`` of many words at once, from their neighbours by class.

    ``owner, cell, n`` in order of owner (0, 1, ... without gaps): a cell below k
    is the class before, one from k on the class after, 2 k the word itself.
    Counts up to ``SMALL`` find their change of the likelihood in a table.
    """
    k, m = len(matrix), matrix
    out = own.copy()
    small = np.arange(1, SMALL + 1)[:, None, None]
    # Rows by count, then class: before a word classes stand in rows, after it in columns.
    more = _xlogx(m + small) - _xlogx(m)
    gains = np.concatenate([x[:, :, :movable] for x in (more, more.transpose(0, 2, 1))], axis=1).reshape(-1, movable)
    b = np.arange(movable)
    margins = m.sum(1)[:movable], m.sum(0)[:movable]
    stops = np.searchsorted(owner, np.arange(len(own) + 1))
    first = 0
    while first < len(own):
        last = max(first + 1, int(np.searchsorted(stops, stops[first] + AT_ONCE, "right")) - 1)
        part = slice(stops[first], stops[last])
        w, c, x, a = owner[part] - first, cell[part], n[part].astype(np.float64), own[first:last]
        near = np.zeros((last - first, 2 * k + 1))
        near[w, c] = x
        before, after, alone = near[:, :k], near[:, k : 2 * k], near[:, 2 * k]
        sides = c < 2 * k
        w, c, x = w[sides], c[sides], x[sides]
        to, follows = c % k, c >= k
        mine = a[w]
        gain = np.zeros((last - first, movable))
        tabled = (x <= SMALL) & (to != mine)
        plain, rest = np.flatnonzero(tabled), np.flatnonzero(~tabled)
        row = (x[plain].astype(np.int64) - 1) * 2 * k + c[plain]
        _add_rows(gain, w[plain], gains, row)
        # Without the word, its own class has fewer bigrams with its neighbours.
        with_it = np.where(follows, m[mine, to], m[to, mine])[plain]
        real = _xlogx(with_it) - _xlogx(np.maximum(with_it - x[plain], 0.0))
        at = np.arange(last - first)
        gain[at, a] += np.bincount(w[plain], real - gains[row, mine[plain]], last - first)
        if len(rest):
            rw, rto, rmine, rx = w[rest], to[rest], mine[rest], x[rest]
            base = np.where(follows[rest][:, None], m[:movable, :].T[rto], m[rto, :movable])
            same = np.flatnonzero(rto == rmine)
            other = np.where(follows[rest][:, None], before[rw, :movable], after[rw, :movable])
            base[same] -= other[same]
            base[np.arange(len(rest)), rmine] -= rx
            base[same, rmine[same]] -= alone[rw[same]]
            np.maximum(base, 0.0, out=base)  # portions before may have left less than the word's own
            _add_rows(gain, rw, _xlogx(base + rx[:, None]) - _xlogx(base), np.arange(len(rest)))
        # The diagonal cell gets both sides and the word's own repeats.
        double = follows & (to < movable) & (alone[w] == 0)
        p, q = w[double], to[double]
        both = before[p, q] > 0
        again = np.flatnonzero(alone)
        p, q = np.r_[p[both], np.repeat(again, movable)], np.r_[q[both], np.tile(b, len(again))]
        f, g, r = before[p, q], after[p, q], alone[p]
        d = np.maximum(m[q, q] - np.where(q == a[p], f + g + r, 0.0), 0.0)
        gain[p, q] += _xlogx(d + f + g + r) + _xlogx(d) - _xlogx(d + f) - _xlogx(d + g)
        for size, margin in zip((after.sum(1) + alone, before.sum(1) + alone), margins):
            sizes, which = np.unique(size, return_inverse=True)
            gain -= (_xlogx(margin + sizes[:, None]) - _xlogx(margin))[which]
            gain[at, a] += _xlogx(margin[a] + size) - _xlogx(margin[a])
            gain[at, a] -= _xlogx(margin[a]) - _xlogx(np.maximum(margin[a] - size, 0.0))
        top = gain.argmax(1)
        kept = gain[at, a]
        out[first:last] = np.where(gain[at, top] > kept + 1e-9 * np.abs(kept), b[top], a)
        first = last
    return out


def _distinct(own: np.ndarray, owner: np.ndarray, cell: np.ndarray, counts: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """One word of each kind, and each word's kind.

    Words of one class with the same single neighbour on each side are of one
    kind; every other word is a kind of its own.
    """
    sizes = np.bincount(owner, minlength=len(own))
    start = np.cumsum(sizes) - sizes
    plain = np.flatnonzero(sizes == 2)
    plain = plain[(counts[start[plain]] == 1) & (counts[start[plain] + 1] == 1)]
    kind = -1 - np.arange(len(own))
    kind[plain] = (own[plain] * cells + cell[start[plain]]) * cells + cell[start[plain] + 1]
    return np.unique(kind, return_index=True, return_inverse=True)[1:]


def exchanged(
    matrix: np.ndarray, own: np.ndarray, n: np.ndarray, owner: np.ndarray, cell: np.ndarray, counts: np.ndarray, share: float
) -> np.ndarray:
    """The classes of a bucket's words (most frequent first) after each has moved to its best one.

    The words move in portions of equal counts, and each portion sees the moves
    of those before. The bucket holds this ``share`` of all words' tokens and
    takes it that the other buckets, which work at the same time, move alike:
    else a class that draws words would draw those of all buckets at once.
    """
    k, m, to = len(matrix), matrix.copy(), own.copy()
    ends = np.searchsorted(np.cumsum(n), np.linspace(0, n.sum(), PORTIONS + 1)[1:] - 0.5) + 1
    first = 0
    for last in np.unique(np.minimum(ends, len(own))).tolist():
        part = slice(*np.searchsorted(owner, [first, last]))
        w, c, x = owner[part], cell[part], counts[part] / share
        one, kind = _distinct(own[first:last], w - first, c, counts[part], 2 * k + 1)
        number = np.full(last - first, -1)
        number[np.sort(one)] = np.arange(len(one))
        here = number[w - first] >= 0
        moved = best_classes(m, own[first:last][np.sort(one)], number[w - first][here], c[here], counts[part][here], k - 1)
        to[first:last] = moved[number[one]][kind]
        moved = to[w] != own[w]
        w, c, x = w[moved], c[moved], x[moved]
        for classes, sign in ((own[w], -1.0), (to[w], 1.0)):
            before = np.where(c == 2 * k, classes, np.where(c < k, c, classes))
            after = np.where(c == 2 * k, classes, np.where(c < k, classes, c - k))
            np.add.at(m, (before, after), sign * x)
        np.maximum(m, 0.0, out=m)
        first = last
    return to


def _packed_words(words: pa.Array) -> bytes:
    """Words as compressed bytes: their lengths, then their characters."""
    if not len(words):
        return b""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    lengths = packed(np.diff(at))
    data = words.buffers()[2].slice(int(at[0]), int(at[-1] - at[0]))
    return len(lengths).to_bytes(8, "little") + lengths + pa.compress(data, "zstd", asbytes=True)


def _unpacked_words(cell: bytes) -> pa.Array:
    if not cell:
        return pa.array([], pa.string())
    start = 8 + int.from_bytes(cell[:8], "little")
    at = np.r_[0, np.cumsum(unpacked(cell[8:start]).astype(np.int64))].astype(np.int32)
    data = pa.decompress(cell[start:], int(at[-1]), "zstd")
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.tobytes()), data)


def bucketed(df: DataFrame, buckets: int, label: str) -> DataFrame:
    """Write to the shared folder, bucketed by ``block``: joins by block do not move it."""
    name = f"brown_{uuid.uuid4().hex}"
    written = df.write.bucketBy(buckets, "block").option("path", run_dir(df.sparkSession, label))
    written.option("compression", "none").saveAsTable(name)
    out = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # only the name: the files lie in the shared folder
    return out


_BLOCK = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.binary()),
     ("tokens", pa.binary()), ("words", pa.binary()), ("buckets", pa.binary())]
)
_BLOCK_SQL = (
    "block bigint, doc_ids array<bigint>, train array<boolean>, sizes binary, tokens binary,"
    " words binary, buckets binary"
)


def text_blocks(rows: DataFrame, vocabulary: Vocabulary, buckets: int) -> DataFrame:
    """``doc_id, text, train`` as blocks of about ``BLOCK`` bytes of text.

    ``tokens`` numbers the clustered words, then the end, then the block's other
    words, each of which is there once in ``words``, in order of its bucket.
    """
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, v = TaskContext.get().partitionId() << 32, held.value
        head = v.words.slice(0, v.clustered)

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            words, sizes = _lists(table["text"].combine_chunks())
            coded = words.dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=head), -1).to_numpy().astype(np.int64)
            rest = np.flatnonzero(place < 0)
            own = coded.dictionary.take(pa.array(rest))
            bucket = crcs(own).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            place[rest[order]] = v.clustered + 1 + np.arange(len(rest))
            code = place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
            tokens = np.insert(code, np.cumsum(sizes), v.clustered)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]), *(pa.array([table[c].to_pylist()], _BLOCK.field(i).type) for c, i in (("doc_id", 1), ("train", 2))),
                    pa.array([packed(sizes + 1)]), pa.array([packed(tokens)]),
                    pa.array([_packed_words(own.take(pa.array(order)))]), pa.array([packed(bucket[order])]),
                ],
                schema=_BLOCK,
            )

        parts: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            start = 0
            for part in portions(batch.column(1), BLOCK):
                if parts and size + part.nbytes > BLOCK:
                    yield block(parts)
                    number, parts, size = number + 1, [], 0
                    pa.default_memory_pool().release_unused()
                parts.append(batch.slice(start, len(part)))
                start, size = start + len(part), size + part.nbytes
        if parts:
            yield block(parts)

    return bucketed(rows.select("doc_id", "text", "train").mapInArrow(cut, _BLOCK_SQL), buckets, "brown-blocks")


@dataclass
class Block:
    """A block's tokens with the counts and classes of its words."""

    tokens: np.ndarray
    sizes: np.ndarray
    train: np.ndarray
    words: pa.Array
    buckets: np.ndarray
    n: np.ndarray  # of the block's other words in training
    own: np.ndarray
    to: np.ndarray
    part: np.ndarray

    @staticmethod
    def of(block: pa.Table, replies: pa.Table, vocabulary: Vocabulary) -> Block:
        row = {c: block[c].combine_chunks()[0] for c in block.column_names}
        words = _unpacked_words(row["words"].as_py())
        if len(replies):
            replies = replies.sort_by("bucket")
            n, own, to, part = (
                np.concatenate([unpacked(x) for x in replies[c].to_pylist()]).astype(np.int64)
                for c in ("n", "own", "to", "part")
            )
        else:
            n = part = np.zeros(len(words), np.int64)
            own = to = vocabulary.classes + _ending_numbers(words, vocabulary.endings)
        return Block(
            unpacked(row["tokens"].as_py()).astype(np.int64), unpacked(row["sizes"].as_py()).astype(np.int64),
            np.array(row["train"].as_py(), bool), words, unpacked(row["buckets"].as_py()).astype(np.int64), n, own, to, part,
        )

    def classes(self, head: np.ndarray, end: int, level: int) -> np.ndarray:
        """The class of each token number, with the moves that a level takes."""
        return np.r_[head, end, np.where(self.part >= level, self.to, self.own)]

    def trained(self) -> np.ndarray:
        return self.tokens[np.repeat(self.train, self.sizes)]


def word_profiles(blocks: DataFrame, replies: DataFrame, vocabulary: Vocabulary, of_unit: np.ndarray, level: int) -> DataFrame:
    """For each block and bucket the words that are not clustered with their neighbours by class."""
    held = blocks.sparkSession.sparkContext.broadcast((vocabulary, of_unit))

    def count(block: pa.Table, replies: pa.Table) -> pa.Table:
        v, units = held.value
        k, h = v.classes + v.endings + 1, v.clustered
        here = Block.of(block, replies, v)
        classes = here.classes(units[:h], k - 1, level)
        tokens = here.trained()
        at = np.flatnonzero(tokens > h)  # an end follows each
        word, last, after = tokens[at], np.r_[h, tokens][at], tokens[np.minimum(at + 1, len(tokens) - 1)]
        local = (word - h - 1) * (2 * k + 1)
        follows = after != word
        key, n = np.unique(
            np.r_[local + np.where(last == word, 2 * k, classes[last]), local[follows] + k + classes[after[follows]]],
            return_counts=True,
        )
        sizes = np.bincount(key // (2 * k + 1), minlength=len(here.words))
        cells, own = key % (2 * k + 1), classes[h + 1 :]
        starts = np.flatnonzero(np.r_[True, here.buckets[1:] != here.buckets[:-1]]) if len(own) else np.zeros(0, np.int64)
        stops, edge = np.r_[starts[1:], len(own)], np.r_[0, np.cumsum(sizes)]
        runs = list(zip(starts.tolist(), stops.tolist()))
        return pa.table(
            [
                pa.array(np.repeat(block["block"].to_numpy(), len(runs))),
                pa.array(here.buckets[starts].astype(np.int32)),
                pa.array([_packed_words(here.words[i:j]) for i, j in runs], pa.binary()),
                pa.array([packed(own[i:j]) for i, j in runs], pa.binary()),
                pa.array([packed(sizes[i:j]) for i, j in runs], pa.binary()),
                pa.array([packed(cells[edge[i] : edge[j]]) for i, j in runs], pa.binary()),
                pa.array([packed(n[edge[i] : edge[j]]) for i, j in runs], pa.binary()),
            ],
            ["block", "bucket", "words", "own", "sizes", "cells", "counts"],
        )

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        count, "block bigint, bucket int, words binary, own binary, sizes binary, cells binary, counts binary"
    )


_REPLY_SQL = "block bigint, bucket int, n binary, own binary, to binary, part binary, types array<bigint>"


def word_moves(profiles: DataFrame, matrix: np.ndarray, tokens: float, move: bool) -> DataFrame:
    """Each word's training count and best class, as a reply to every block that holds it.

    All profiles of a word meet in its bucket; ``tokens`` are those of all words
    that move. ``part`` tells which levels take
    the move: level 0 all of them, each next one half of those before. The row
    of block -1 has the words of each class by level, the last with no move.
    """
    held = profiles.sparkSession.sparkContext.broadcast(matrix)

    def deal(rows: pa.Table) -> pa.Table:
        matrix = held.value
        k = len(matrix)
        lists = [_unpacked_words(x) for x in rows["words"].to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        joined = lambda c: np.concatenate([unpacked(x) for x in rows[c].to_pylist()])
        own = np.zeros(len(words), np.int64)
        own[code] = joined("own")
        owner, cell, counts = np.repeat(code, joined("sizes")), joined("cells").astype(np.int64), joined("counts")
        before = (cell < k) | (cell == 2 * k)
        n = np.bincount(owner[before], counts[before], len(words)).astype(np.int64)
        to, part = own.copy(), np.zeros(len(words), np.int64)
        known = np.flatnonzero(n)
        if move and len(known):
            # In an order that no shuffle changes.
            table = pa.table([pa.array(n[known]), words.take(pa.array(known))], ["n", "word"])
            ranked = known[pc.sort_indices(table, [("n", "descending"), ("word", "ascending")]).to_numpy()]
            rank = np.empty(len(words), np.int64)
            rank[ranked] = np.arange(len(ranked))
            key = rank[owner] * (2 * k + 1) + cell
            order = np.argsort(key)
            key, counts = key[order], counts[order].astype(np.int64)
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts, key = np.add.reduceat(counts, heads), key[heads]
            to[ranked] = exchanged(
                matrix, own[ranked], n[ranked], key // (2 * k + 1), key % (2 * k + 1), counts, n.sum() / tokens
            )
            moved = np.flatnonzero(to != own)
            mark = crcs(words.take(pa.array(moved))).astype(np.int64) >> 16 | 1 << (LEVELS - 1)
            part[moved] = np.log2(mark & -mark)
        types = [np.bincount(np.where(part >= j, to, own)[known], minlength=k) for j in range(LEVELS + 1)]
        ends = np.cumsum([len(x) for x in lists]).tolist()
        runs = [slice(i, j) for i, j in zip([0, *ends], ends)]
        return pa.table(
            [
                pa.concat_arrays([rows["block"].combine_chunks(), pa.array([-1], pa.int64())]),
                pa.concat_arrays([rows["bucket"].combine_chunks(), rows["bucket"].combine_chunks()[:1]]),
                *(pa.array([*(packed(x[code[r]]) for r in runs), None], pa.binary()) for x in (n, own, to, part)),
                pa.array([None] * len(runs) + [np.concatenate(types).tolist()], pa.list_(pa.int64())),
            ],
            ["block", "bucket", "n", "own", "to", "part", "types"],
        )

    return profiles.groupBy("bucket").applyInArrow(deal, _REPLY_SQL)


def level_matrices(blocks: DataFrame, replies: DataFrame, vocabulary: Vocabulary, of_unit: np.ndarray) -> list[np.ndarray]:
    """Class bigram counts over all training tokens, by the level of the moves taken."""
    held = blocks.sparkSession.sparkContext.broadcast((vocabulary, of_unit))
    k = vocabulary.classes + vocabulary.endings + 1

    def count(block: pa.Table, replies: pa.Table) -> pa.Table:
        v, units = held.value
        here = Block.of(block, replies, v)
        tokens, out = here.trained(), []
        for level in range(LEVELS):
            c = here.classes(units[: v.clustered], k - 1, level)[tokens]
            out.append(np.bincount(np.r_[k - 1, c[:-1]] * k + c if len(c) else c, minlength=k * k))
        return pa.table([pa.array([packed(np.concatenate(out))], pa.binary())], ["cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS * k * k, np.int64)
        for batch in batches:
            for cells in batch.column(0):
                total += unpacked(cells.as_py())
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    counted = blocks.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInArrow(count, "cells binary")
    out = np.zeros(LEVELS * k * k)
    for row in counted.mapInArrow(add, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return list(out.reshape(LEVELS, k, k))


@dataclass
class Words:
    """The training words that are not clustered first: replies by block, and the level that holds."""

    blocks: DataFrame
    replies: DataFrame
    level: int
    matrix: np.ndarray
    types: np.ndarray  # their number in each class


def exchange_all(
    blocks: DataFrame, vocabulary: Vocabulary, of_unit: np.ndarray, matrix: np.ndarray, sweeps: int, buckets: int,
    seen: list | None = None,
) -> Words:
    """Exchange clustering of all other training words, from the classes of their last characters.

    In a sweep every word finds its best class given the counts at its start
    and the moves in its bucket. Of all moves, a half, a quarter and so on, those are taken that raise the
    likelihood most; the sweeps end if none does. ``seen`` gets the likelihood
    after each sweep.
    """
    spark = blocks.sparkSession
    k = vocabulary.classes + vocabulary.endings + 1
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(_REPLY_SQL)]
    replies, level, best = spark.range(0).select(*none), LEVELS, log_likelihood(matrix)
    ends = float(matrix[:, -1].sum())
    tokens = float(matrix.sum()) - ends - float(vocabulary.counts.sum())
    for step in range(max(1, sweeps)):
        last = replies.where("block >= 0")
        moves = word_moves(word_profiles(blocks, last, vocabulary, of_unit, level), matrix, tokens, step < sweeps)
        replies = bucketed(moves.repartition(buckets, "block"), buckets, "brown-replies")
        level = LEVELS
        if sweeps:
            counted = level_matrices(blocks, replies, vocabulary, of_unit)
            got = [log_likelihood(m) for m in counted]
            if max(got) > best:
                best, level = max(got), int(np.argmax(got))
                matrix = counted[level]
            if seen is not None:
                seen.append(best)
            if level == LEVELS:
                break
    types = np.zeros(k)
    numbers = replies.where("block = -1").select(F.posexplode("types").alias("at", "n"))
    held = numbers.where((F.col("at") >= level * k) & (F.col("at") < (level + 1) * k))
    for row in held.groupBy("at").agg(F.sum("n").alias("n")).collect():
        types[row["at"] - level * k] = row["n"]
    return Words(blocks, replies, level, matrix, types)


def train(
    rows: DataFrame, counts: DataFrame, clustered: int, frequent: int, classes: int, endings: int, sweeps: int,
    weight: float, seen: list | None = None,
) -> tuple[Model, Words]:
    """The model of the rows (``doc_id, text, train``) that train, and the words of all rows."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent_words(counts, min(clustered, frequent))
    vocabulary = Vocabulary(
        pa.array([r["word"] for r in top], pa.string()),
        np.array([r["n"] for r in top], np.int64),
        len(top),
        classes,
        endings,
    )
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(least, rows.rdd.getNumPartitions()))
    blocks = text_blocks(rows, vocabulary, buckets)
    profiles = stored(block_profiles(blocks, vocabulary), "brown-units")
    of_unit, matrix = exchange(profiles, vocabulary, sweeps)
    words = exchange_all(blocks, vocabulary, of_unit, matrix, sweeps, buckets, seen)

    matrix = words.matrix
    k = len(matrix)
    types = words.types + np.bincount(of_unit[: len(top)], minlength=k)
    tokens, after = matrix.sum(0), matrix.sum(1)
    share = tokens / max(1.0, tokens.sum())
    transition = (matrix + share) / (after + 1)[:, None]
    left = np.divide(DISCOUNT * types, tokens, out=np.zeros(k), where=tokens > 0)
    model = Model(vocabulary, of_unit, transition, tokens, transition @ left, totals["n"], totals["v"], weight)
    return model, words


def train_model(
    train_rows: DataFrame, text: str, counts: DataFrame, clustered: int, frequent: int, classes: int,
    endings: int, sweeps: int, weight: float,
) -> Model:
    """The model of a table all of whose rows train."""
    rows = train_rows.select(F.lit(0).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.lit(True).alias("train"))
    return train(rows, counts, clustered, frequent, classes, endings, sweeps, weight)[0]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs of the given sizes, each at least one."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def text_scores(words: Words, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of each text, from its block and the replies to it."""
    held = words.blocks.sparkSession.sparkContext.broadcast(model)
    level = words.level

    def score(block: pa.Table, replies: pa.Table) -> pa.Table:
        m: Model = held.value
        v = m.vocabulary
        here = Block.of(block, replies, v)
        tokens, end = here.tokens, len(m.class_tokens) - 1
        k = here.classes(m.classes[: v.clustered], end, level)[tokens]
        before = np.r_[end, k[:-1]]  # a text starts after an end
        count = np.r_[v.counts, m.class_tokens[-1], here.n][tokens].astype(np.float64)
        stop = tokens == v.clustered
        inside = np.divide(
            m.transition[before, k] * np.where(stop, count, count - DISCOUNT), m.class_tokens[k],
            out=np.zeros(len(k)), where=(count > 0) & (m.class_tokens[k] > 0),
        )
        inside = np.where((count > 0) | stop, inside, m.unknown[before])
        base = m.base(count)
        sizes = here.sizes
        return pa.table(
            [
                block["doc_ids"].combine_chunks().flatten(),
                pa.array(sizes),
                pa.array(_sums((count > 0).astype(np.int64), sizes)),
                pa.array(_sums(np.log10(base), sizes)),
                pa.array(_sums(np.log10(m.weight * inside + (1 - m.weight) * base), sizes)),
            ],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    replies = words.replies.where("block >= 0").groupBy("block")
    return words.blocks.groupBy("block").cogroup(replies).applyInArrow(
        score, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    )


def scored(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    clustered: int = CLUSTERED,
    frequent: int = FREQUENT,
    classes: int = CLASSES,
    endings: int = ENDINGS,
    sweeps: int = SWEEPS,
    weight: float = WEIGHT,
) -> DataFrame:
    """One row for each input row, learning from those that are not held out.

    ``doc_id, held_out, n_tokens`` (words and one end), ``n_known,
    train_tokens, base_score`` (unigram), ``score`` (class bigram), both log10
    probabilities of the text, and ``perplexity`` of the class bigram. Null
    texts count as empty; null ids train; repeated rows keep their rows. Without
    training texts every token is unknown. An empty table gives an empty
    result; other columns are ignored.

    The ``clustered`` most frequent words (``frequent`` at most) move first and
    are the only ones that tasks hold; all others get their counts and classes
    by block of texts.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("train", ~held_out(F.col("doc_id")))
    counts = stored(word_counts(rows.where("train"), "text"), "brown-words")
    model, words = train(rows, counts, clustered, frequent, classes, endings, sweeps, weight)
    return text_scores(words, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
