"""Benchmark decontamination: CGK walks, bit-sampling LSH, exact edit verification.

A CGK walk reads a word sequence with one pointer: at each step it outputs the
word under the pointer, and a random bit that depends on step and word decides
whether the pointer moves on. Sequences at a small edit distance give outputs at
a small Hamming distance, so sampled output positions are LSH coordinates. A
window of a document is aligned to an item at one of the item's words (an
anchor); walks from the anchor and from the document's word are compared on the
sampled coordinates, several times with independent bits. Each match is then
verified by the exact edit distance between the item and the best window there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from glintscan.llm.common import portions, stored

SIMILARITY = 0.8
MIN_WORDS = 5
# Walks over longer items, and over items of under SHORT words: repeats, steps,
# samples, and the fewest different places that the samples must read.
LONG_WALKS = (4, 8, 4, 3)
SHORT_WALKS = (6, 2, 2, 2)
SHORT = 14
BLOCK_WORDS = 500_000
# Words of the comparison: letters, digits and all non-ASCII; A-Z lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Scripts written without blanks: each of their characters is a word.
_UNSPACED = r"([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{A4CF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}])"
_ODD = np.uint64(0x100000001B3)


def _words(texts: pa.Array) -> pa.ListArray:
    spaced = pc.replace_substring_regex(pc.fill_null(texts, ""), _GAP, " ")
    if pc.any(pc.match_substring_regex(spaced, _UNSPACED)).as_py():
        spaced = pc.replace_substring_regex(spaced, _UNSPACED, r" \1 ")
    return pc.ascii_split_whitespace(pc.ascii_lower(spaced))


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


@dataclass
class Walks:
    """The sampled steps and random bits of repeated walks; fixed by the seed."""

    repeats: int
    steps: int
    samples: int
    min_seen: int
    seed: int = 7
    sampled: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        draw = np.random.default_rng(self.seed)
        # The first word is always sampled: it is where the walk is anchored.
        self.sampled = [
            np.sort(np.append(0, 1 + draw.permutation(self.steps - 1)[: self.samples - 1]))
            for _ in range(self.repeats)
        ]

    def keys(
        self, ids: np.ndarray, at: np.ndarray, ends: np.ndarray, content: np.ndarray, repeat: int, filters=None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the walks from ``at``; walks that read no known word drop out.

        ``content`` has a hash for each word number, the last for all unknown
        words; walks and keys depend on it alone. ``filters`` gives for each sampled step a bitmap of the key prefixes that
        items have; other walks stop there. Returns positions, keys and the
        number of different places that the samples read.
        """
        unknown = len(content) - 1
        # One bit for each step of each word.
        bits = _hashed(content, 1 + repeat + 1_000 * self.seed)
        pointer, key = at.copy(), np.zeros(len(at), np.uint64)
        seen, last = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        rank = 0
        for step in range(self.sampled[repeat][-1] + 1):
            inside = pointer < ends
            word = np.where(inside, ids[np.minimum(pointer, len(ids) - 1)], unknown)
            if step in self.sampled[repeat]:
                key = (key + content[word]) * _ODD
                seen += pointer != last
                last = pointer.copy()
                keep = inside & (word != unknown)
                if filters is not None:
                    bitmap = filters[rank]
                    keep &= bitmap[(key >> np.uint64(64 - 20)).astype(np.int64)]
                rank += 1
                if not keep.all():
                    at, pointer, key, ends = at[keep], pointer[keep], key[keep], ends[keep]
                    seen, last, word = seen[keep], last[keep], word[keep]
            pointer = pointer + ((bits[word] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        return at, key, seen


class Index:
    """Anchors of a bounded block of items, by walk key, for every repeat."""

    def __init__(self, items: list[tuple[object, list[str]]], similarity: float):
        long, short = Walks(*LONG_WALKS), Walks(*SHORT_WALKS)
        self.item_ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.vocabulary = pa.array(dict.fromkeys(w for _, ws in items for w in ws), pa.string())
        number = {w: n for n, w in enumerate(self.vocabulary.to_pylist())}
        self.unknown = len(number)
        self.encoded = [[number[w] for w in ws] for ws in self.words]
        self.edits = [int((1 - similarity) * len(ws) + 1e-9) for ws in self.words]
        self.masks = []
        for ws in self.encoded:
            mask: dict[int, int] = {}
            for n, w in enumerate(ws):
                mask[w] = mask.get(w, 0) | 1 << n
            self.masks.append(mask)
        self.content = np.array([xxh64_intdigest(w, 11) for w in [*number, ""]], np.uint64)
        flat = np.array([w for ws in self.encoded for w in ws], np.int64)
        sizes = np.array([len(ws) for ws in self.encoded], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # Items too short for an edit are looked up whole, by their words.
        self.exact: dict[int, dict[tuple, list[int]]] = {}
        for i, ws in enumerate(self.encoded):
            if not self.edits[i]:
                self.exact.setdefault(len(ws), {}).setdefault(tuple(ws), []).append(i)
        some = np.array([e > 0 for e in self.edits], bool)
        self.tables = []
        for walks, mine in ((long, some & (sizes >= SHORT)), (short, some & (sizes < SHORT))):
            anchors = np.flatnonzero(mine[owner])
            for repeat in range(walks.repeats if len(anchors) else 0):
                self.tables.append(self._table(walks, repeat, anchors, flat, sizes, owner))

    def _table(self, walks: Walks, repeat: int, at: np.ndarray, flat, sizes, owner) -> tuple:
        """Sorted keys of the anchors with item and place in it, and bitmaps of key prefixes."""
        starts = np.cumsum(sizes) - sizes
        ends = (starts + sizes)[owner]
        at, key, seen = walks.keys(flat, at, ends[at], self.content, repeat)
        # A walk that stays on one or two words says little; other walks and
        # anchors cover the place.
        strong = seen >= walks.min_seen
        at, key = at[strong], key[strong]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        filters = []
        for stop in range(1, len(walks.sampled[repeat]) + 1):
            cut = replace(walks)
            cut.sampled = [w[:stop] for w in walks.sampled]
            prefix = cut.keys(flat, at, ends[at], self.content, repeat)[1]
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(prefix >> np.uint64(64 - 20)).astype(np.int64)] = True
            filters.append(bitmap)
        return walks, repeat, key, owner[at], at - starts[owner[at]], filters

    def candidates(self, ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct rows (doc, item, word where the item's window starts)."""
        known = np.flatnonzero(ids != self.unknown)
        found = []
        for walks, repeat, table, item, anchor, filters in self.tables:
            at, key, _ = walks.keys(ids, known, ends[known], self.content, repeat, filters)
            low = np.searchsorted(table, key, "left")
            many = np.searchsorted(table, key, "right") - low
            total = int(many.sum())
            if not total:
                continue
            place = np.repeat(at, many)
            entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(total)
            found.append(np.column_stack([doc[place], item[entry], place - anchor[entry]]))
        for size, runs in self.exact.items():
            firsts = np.array(sorted({r[0] for r in runs}))
            for at in known[np.isin(ids[known], firsts) & (known + size <= ends[known])].tolist():
                for item in runs.get(tuple(ids[at : at + size].tolist()), ()):
                    found.append(np.array([[doc[at], item, at]]))
        if not found:
            return np.zeros((0, 3), np.int64)
        return np.unique(np.concatenate(found), axis=0)

    def best(self, item: int, ids: np.ndarray, low: int, high: int) -> tuple[int, int]:
        """Fewest edits from the item to a run of words inside [low, high), and the run's end.

        Bit-parallel columns of the edit matrix, free at both ends of the text.
        """
        mask, m = self.masks[item], len(self.encoded[item])
        top, full = 1 << (m - 1), (1 << m) - 1
        plus, minus, score = full, 0, m
        fewest, end = m, low
        for at in range(low, high):
            eq = mask.get(int(ids[at]), 0)
            x = eq | minus
            d = ((((x & plus) + plus) ^ plus) | x) & full
            up, down = minus | (full & ~(d | plus)), plus & d
            score += bool(up & top) - bool(down & top)
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(d | up)), up & d
            if score < fewest:
                fewest, end = score, at + 1
        return fewest, end

    def matches(self, texts: pa.Array) -> list[list[dict]]:
        """For each text one match for each item that it holds."""
        lists = _words(texts)
        flat = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        real = pc.greater(pc.binary_length(flat), 0)
        flat, doc = flat.filter(real), doc[real.to_numpy(zero_copy_only=False)]
        ids = pc.fill_null(pc.index_in(flat, value_set=self.vocabulary), self.unknown)
        ids = ids.to_numpy().astype(np.int64)
        ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
        starts = ends - np.bincount(doc, minlength=len(texts))
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for d, item, start in self.candidates(ids, doc, ends[doc]).tolist():
            slack, m = self.edits[item], len(self.encoded[item])
            last = done.get((d, item))
            if last is not None and last >= start:  # a place already verified
                continue
            low = max(int(starts[d]), start - slack)
            high = min(int(ends[d]), start + m + 2 * slack + 1)
            done[d, item] = start + slack
            edits, end = self.best(item, ids, low, high)
            if edits <= slack and (edits, end) < best.get((d, item), (m + 1, 0)):
                best[d, item] = edits, end
        for (d, item), (edits, end) in sorted(best.items()):
            m = len(self.encoded[item])
            out[d].append(
                {
                    "item_id": self.item_ids[item],
                    "end_word": int(end - starts[d]),
                    "edits": edits,
                    "item_words": m,
                    "similarity": 1 - edits / m,
                }
            )
        return out


def item_blocks(
    items: DataFrame, item_id: str, text: str, similarity: float,
    min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS,
) -> Iterator[Index]:
    """Indexes over the items in blocks of about ``block_words`` words, one at a time.

    A block's size is measured before it is brought together. The caller is
    done with a block before it takes the next one, so what is held at once is
    bounded whatever the number of items.
    """
    sized = items.select(F.col(item_id).alias("item_id"), F.coalesce(text, F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        rows = sized.where(part == block).distinct().collect()
        words = _words(pa.array([r.text for r in rows], pa.string())).to_pylist()
        kept = [(r.item_id, [w for w in ws if w]) for r, ws in zip(rows, words)]
        kept = sorted((k for k in kept if len(k[1]) >= max(1, min_words)), key=lambda k: (k[0] is None, str(k[0]), k[1]))
        if kept:
            yield Index(kept, similarity)


def _finder(index: Broadcast, item_type: str):
    """Matches of each text with a block; items are named by their number in it."""

    @F.arrow_udf(
        f"array<struct<item_id: {item_type}, end_word: bigint, edits: bigint,"
        " item_words: bigint, similarity: double>>"
    )
    def find(texts: pa.Array) -> pa.Array:
        rows = [row for part in portions(texts) for row in index.value.matches(part)]
        fields = [("item_id", index.value.id_type), ("end_word", pa.int64()), ("edits", pa.int64())]
        fields += [("item_words", pa.int64()), ("similarity", pa.float64())]
        return pa.array(rows, pa.list_(pa.struct(fields)))

    return find


def _each_block(
    docs: DataFrame, items: DataFrame, item_id: str, item_text: str, similarity: float, min_words: int, block_words: int
) -> Iterator[tuple[object, Broadcast]]:
    """The function that finds the items of each block, with what it holds."""
    kind = dict(items.dtypes)[item_id]
    id_type = items.select(item_id).limit(0).toArrow().schema.types[0]
    for index in item_blocks(items, item_id, item_text, similarity, min_words, block_words):
        index.id_type = id_type
        held = docs.sparkSession.sparkContext.broadcast(index)
        yield _finder(held, kind), held


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each row of ``docs`` and item that it holds.

    ``doc_id, item_id, end_word`` (words up to the end of the best window),
    ``edits, item_words, similarity`` (1 - edits / item words, at least
    ``similarity``). Ties take the earliest window. Each character of a script
    without blanks counts as a word. Items under ``min_words`` words are no
    passages and match nothing; with a smaller ``min_words`` items that allow no
    edit match where all their words stand; null texts count as empty; null
    ids and repeated rows each keep their rows; empty tables give no rows;
    other columns are ignored.
    """
    kind = dict(items.dtypes)[item_id]
    rows, out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), None
    before = None
    for find, held in _each_block(docs, items, item_id, item_text, similarity, min_words, block_words):
        if before is not None:  # several blocks: what one finds is written before the next one is built
            out = _written(out, before)
        before = rows.select("doc_id", F.explode(find(F.col("text"))).alias("hit")).select("doc_id", "hit.*"), held
    if before is None:
        none = f"CAST(array() AS array<struct<item_id: {kind}, end_word: bigint, edits: bigint, item_words: bigint, similarity: double>>)"
        return rows.select("doc_id", F.explode(F.expr(none)).alias("hit")).select("doc_id", "hit.*")
    return before[0] if out is None else _written(out, before)


def _written(out: DataFrame | None, block: tuple[DataFrame, Broadcast]) -> DataFrame:
    found = stored(block[0], "decontamination")
    block[1].unpersist()
    return found if out is None else out.union(found)


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    before = None
    for find, held in _each_block(docs, items, item_id, item_text, similarity, min_words, block_words):
        if before is not None:
            docs = stored(docs, "decontamination")
            before.unpersist()
        docs, before = docs.where(F.size(find(F.col(text))) == 0), held
    return docs
