"""Quality rules by repetition coverage.

For several n-gram lengths, the share of a text's word characters that lie in
n-grams found twice or more in the text, and the share that lies in repeated
lines. Rolling 64-bit hashes over word numbers mark the repeated n-grams; each
hash match is confirmed on the words. One map-only pass over whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import portions

# The largest share of word characters in repeated n-grams, by
# n-gram length, and in repeated lines.
MAX_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE = 0.20
BASE_WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def _scrambled(ids: np.ndarray) -> np.ndarray:
    """Word numbers as well-mixed 64-bit values."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _repeated_starts(key: np.ndarray, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Starts of the n-word windows that occur twice or more in their document."""
    start = np.flatnonzero(doc[: len(key)] == doc[n - 1 :])
    h = key[start] ^ _scrambled(doc[start] + (1 << 40))
    order = np.argsort(h)
    s, h = start[order], h[order]
    twin = np.flatnonzero(h[1:] == h[:-1])
    window = np.arange(n)
    same = (doc[s[twin]] == doc[s[twin + 1]]) & (
        ids[s[twin][:, None] + window] == ids[s[twin + 1][:, None] + window]
    ).all(axis=1)
    if not same.all():  # a hash collision: compare the windows themselves
        rows = np.column_stack([doc[start], ids[start[:, None] + window]])
        _, group, size = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        return start[size[group.ravel()] > 1]
    hit = np.zeros(len(s), bool)
    hit[twin] = hit[twin + 1] = True
    return s[hit]


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which words lie in an n-word window at one of the starts."""
    edge = np.zeros(size + 1, np.int64)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measured(texts: pa.Array, grams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text: words, characters in repeated n-grams and lines."""
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    doc = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(words), 0)
    words, doc = words.filter(real), doc[real.to_numpy(zero_copy_only=False)]
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    chars = pc.utf8_length(words).to_numpy().astype(np.int64)

    def total(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(rows, np.int64)
        np.add.at(out, at, values)
        return out

    out = {
        "n_words": np.bincount(doc, minlength=rows).astype(np.int64),
        "word_chars": total(chars, doc),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64),
    }
    key, mixed = np.zeros(len(ids), np.uint64), _scrambled(ids)
    for n in range(1, max(*grams, BASE_WINDOW) + 1):
        rolled = max(0, len(ids) - n + 1)
        key = key[:rolled] * np.uint64(0x100000001B3) + mixed[n - 1 :]
        if n not in grams and n != BASE_WINDOW:
            continue
        hit = np.zeros(len(ids), bool)
        if rolled:
            hit = _covered(_repeated_starts(key, doc, ids, n), n, len(ids))
        out[f"dup_chars_{n}"] = total(chars[hit], doc[hit])
        if n == BASE_WINDOW:
            out["n_repeat_words"] = total(np.ones(hit.sum(), np.int64), doc[hit])

    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    owner = np.repeat(np.arange(rows), np.diff(split.offsets.to_numpy()))
    some = pc.match_substring_regex(lines, r"[^ \t-\r]")
    lines, owner = lines.filter(some), owner[some.to_numpy(zero_copy_only=False)]
    again = np.ones(len(owner), bool)
    if len(owner):
        line = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
        again[np.unique(owner * (line.max() + 1) + line, return_index=True)[1]] = False
    out["n_dup_lines"] = total(np.ones(again.sum(), np.int64), owner[again])
    kept = lines.filter(pa.array(again))
    size = pc.utf8_length(pc.replace_substring_regex(kept, r"[ \t-\r]+", "")).to_numpy()
    out["dup_line_chars"] = total(size.astype(np.int64), owner[again])
    return out


def _verdicts(limits: dict[int, float], line_limit: float):
    grams = tuple(sorted(limits))
    names = _COUNTS + [f"dup_chars_{n}" for n in grams]
    schema = ", ".join(f"{n}: bigint" for n in names)

    @F.arrow_udf(f"struct<{schema}, base_failed: boolean, kept: boolean>")
    def verdict(texts: pa.Array) -> pa.Array:
        parts = [measured(p, grams) for p in portions(texts)] or [measured(texts, grams)]
        m = {n: np.concatenate([p[n] for p in parts]) for n in names}
        failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        kept = ~failed & (m["dup_line_chars"] <= line_limit * m["word_chars"])
        for n in grams:
            kept &= m[f"dup_chars_{n}"] <= limits[n] * m["word_chars"]
        arrays = [pa.array(m[n]) for n in names] + [pa.array(failed), pa.array(kept)]
        return pa.StructArray.from_arrays(arrays, [*names, "base_failed", "kept"])

    return verdict


def repetition(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    limits: dict[int, float] = MAX_SHARE,
    line_limit: float = MAX_LINE_SHARE,
) -> DataFrame:
    """Counts and verdict for every row: ``doc_id``, the counts, ``base_failed``, ``kept``.

    A null text counts as empty: all counts zero, ``base_failed`` true. Repeated
    rows and null ids each keep their row; an empty table gives an empty
    result. Other columns of the input are ignored, whatever their names. Long
    texts are measured whole, by themselves.
    """
    verdict = _verdicts(limits, line_limit)(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), verdict.alias("q")).select("doc_id", "q.*")


def keep_good(
    docs: DataFrame,
    text: str = "text",
    limits: dict[int, float] = MAX_SHARE,
    line_limit: float = MAX_LINE_SHARE,
) -> DataFrame:
    """The rows whose text passes the rules, with all their columns."""
    return docs.where(_verdicts(limits, line_limit)(F.col(text)).getField("kept"))
