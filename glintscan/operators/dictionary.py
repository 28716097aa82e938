"""Keyword dictionaries that are tables: any number of terms, no pattern in the plan.

The first characters of each term lead to the lengths of the terms that begin
so; at text positions with such a beginning the runs of these lengths are looked
up as whole terms, by a rolling hash and then character by character. Terms that share a beginning cost their number of lengths, not
their number. The texts are not moved: the dictionary goes out in parts of
measured size, with one pass over the texts each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from glintscan.functions.encoding import portions
from glintscan.operators.match import char_chunks
from glintscan.session import checkpointed

HEAD = 3  # characters that lead to a term
CHUNK = 65_536  # characters of a text in one value at most, but for the overlap
PORTION = 1 << 20  # bytes of text whose positions are looked at together
BASE = 0x5851F42D4C957F2D  # of the rolling hash; what it finds is confirmed
SLOTS = 20  # bits of the table of beginnings
NO_CODE = np.array([0x110000], np.uint32)
PIECE = 48  # characters looked up at once; longer terms are looked up in pieces
PART_TERMS, PART_BYTES = 400_000, 24 << 20  # what one pass sends to every task


def pieces(dictionary: DataFrame, piece: int = PIECE) -> DataFrame:
    """``term, at, n, piece``: a term itself, or runs of ``piece`` characters that cover a longer one.

    The last run ends with the term. Null and empty terms are left out, repeated ones count once.
    """
    terms = dictionary.where("term <> ''").select("term").distinct()
    starts = f"sequence(0, greatest(length(term) - {piece}, 0), {piece})"
    last = f"greatest(length(term) - {piece}, 0)"
    placed = terms.selectExpr("term", f"array_distinct(array_append({starts}, {last})) AS ats")
    return placed.selectExpr("term", "size(ats) AS n", "explode(ats) AS at").selectExpr(
        "term", "at", "n", f"substring(term, at + 1, {piece}) AS piece"
    )


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash modulo 2**64, and their inverses."""
    return tuple(
        np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64))
    )


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


class _Lookup:
    """One part of a dictionary: by beginning the lengths, by length and hash the pieces."""

    def __init__(self, part: pa.Table, head: int) -> None:
        self.part = part = part.combine_chunks()
        pieces = part.column("piece").to_pylist()
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.heads: dict[int, np.ndarray] = {}  # slot of a beginning: a bit for each length (modulo 64)
        self.lengths = []
        for number, size in enumerate(np.unique(sizes).tolist()):
            rows = np.flatnonzero(sizes == size)
            codes = _codes([pieces[r] for r in rows]).reshape(-1, size)
            begin, short = _powers(size)[0][:size], min(size, head)
            hashes = (codes * begin).sum(1, dtype=np.uint64)
            table = self.heads.setdefault(short, np.zeros(1 << SLOTS, np.uint64))
            bit = np.uint64(number % 64)
            table[_slot((codes[:, :short] * begin[:short]).sum(1, dtype=np.uint64))] |= np.uint64(1) << bit
            order = np.argsort(hashes, kind="stable")
            known, first, n = np.unique(hashes[order], return_index=True, return_counts=True)
            seen = np.zeros(1 << SLOTS, bool)
            seen[_slot(known)] = True
            self.lengths.append((size, short, bit, seen, known, first, n, codes[order], rows[order]))
        longest = pc.max(pc.binary_length(part.column("term"))).as_py() or 0
        self.most = max(1, min(100_000, (8 << 20) // (longest + 64)))

    def find(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``codes`` and the rows of the part that stand there."""
        power, inverse = _powers(len(codes))
        sums = np.r_[np.uint64(0), np.cumsum(codes * power[:-1], dtype=np.uint64)]
        begun = {}
        for short, table in self.heads.items():
            n = max(0, len(codes) - short + 1)
            marks = table[_slot((sums[short : short + n] - sums[:n]) * inverse[:n])]
            begun[short] = (places := np.flatnonzero(marks), marks[places])
        for size, short, bit, seen, known, first, n, pieces, rows in self.lengths:
            places, marks = begun[short]
            at = places[((marks >> bit) & np.uint64(1)).astype(bool) & (places + size <= len(codes))]
            hashes = (sums[at + size] - sums[at]) * inverse[at]
            likely = seen[_slot(hashes)]
            at, hashes = at[likely], hashes[likely]
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            same = known[place] == hashes
            at, place = at[same], place[same]
            ends, start = np.cumsum(n[place]), 0
            while start < len(at):
                # As many places as give so many rows, at least one.
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + self.most, "right")))
                count = n[place[start:stop]]
                where = np.repeat(at[start:stop], count)
                inside = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
                entry = np.repeat(first[place[start:stop]], count) + inside
                real = (codes[where[:, None] + np.arange(size)] == pieces[entry]).all(1)
                yield where[real], rows[entry[real]]
                start = stop


def _part_hits(df: DataFrame, part: DataFrame, keys: list[str], text: str, head: int, piece: int) -> DataFrame:
    """``keys, term, at, n, pos`` of all pieces of one part of the dictionary."""
    held = df.sparkSession.sparkContext.broadcast(part.select("piece", "term", "at", "n").toArrow())
    chunks = char_chunks(df, keys, text, threshold=CHUNK, width=CHUNK + piece - 1, step=CHUNK).select(*keys, "start", "chunk")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(held.value, head)
        for batch in batches:
            for begin, rows in portions(batch.column("chunk"), PORTION):
                some = batch.slice(begin, rows)
                # Each text ends with what is no character, so that nothing goes over its end.
                texts = [_codes([t.as_py().decode("utf-8", "replace")]) for t in some.column("chunk").cast(pa.binary())]
                starts = np.cumsum([0] + [len(t) + 1 for t in texts])
                codes = np.concatenate([x for t in texts for x in (t, NO_CODE)]).astype(np.uint64)
                for places, found in lookup.find(codes):
                    owner = np.searchsorted(starts, places, "right") - 1
                    local = places - starts[owner]
                    own = local < CHUNK
                    owner, local, found = pa.array(owner[own]), local[own], pa.array(found[own])
                    pos = some.column("start").take(owner).to_numpy() + local
                    listed = [lookup.part.column(c).take(found).combine_chunks() for c in ("term", "at", "n")]
                    columns = [some.column(k).take(owner) for k in keys] + listed + [pa.array(pos, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "term", "at", "n", "pos"])

    kinds = [chunks.schema[k] for k in keys] + [part.schema[c] for c in ("term", "at", "n")]
    return chunks.mapInArrow(find, StructType([StructField(k.name, k.dataType) for k in kinds] + [StructField("pos", IntegerType())]))


def dictionary_hits(
    df: DataFrame,
    dictionary: DataFrame,
    keys: list[str],
    text: str = "text",
    head: int = HEAD,
    piece: int = PIECE,
    part_terms: int = PART_TERMS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Every term of ``dictionary`` at every position: ``keys, term, pos``.

    ``dictionary`` has a column ``term``; null and empty ones never match, null
    texts have no hits. ``keys`` are unique in ``df``.
    """
    listed = checkpointed(pieces(dictionary, piece))
    size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("piece") + F.octet_length("term")), F.lit(0))).first()
    parts = max(1, -(-size[0] // part_terms), -(-size[1] // part_bytes))
    found = []
    for number in range(parts):
        part = listed.where(f"pmod(xxhash64(piece), {parts}) = {number}")
        hits = _part_hits(df, part, keys, text, head, piece)
        # One part's table at a time in the tasks.
        found.append(checkpointed(hits) if parts > 1 else hits)
    every = reduce(DataFrame.unionByName, found)
    short = every.where("n = 1").select(*keys, "term", "pos")
    if listed.where("n > 1").isEmpty():
        return short
    start = F.col("pos") - F.col("at")
    long = every.where("n > 1").groupBy(*keys, "term", start.alias("pos"), "n").agg(F.count(F.lit(1)).alias("seen"))
    return short.unionByName(long.where("seen = n").select(*keys, "term", "pos"))


def without_overlaps(hits: DataFrame, keys: list[str], best: str = "-length(term)") -> DataFrame:
    """Hits from left to right, none within another: the least ``best`` wins at a position.

    With the default the longest term does. The hits of a text lie sorted in one
    partition; the step that goes over them remembers the end of the last one
    taken, and nothing else.
    """
    ordered = (
        hits.selectExpr(*keys, "term", "cast(pos AS int) AS pos", f"{best} AS __best", "length(term) AS __size")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "pos", "__best", "term")
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, 0
        for batch in batches:
            kept = []
            of = zip(*(batch.column(k).to_pylist() for k in keys))
            for i, (key, pos, size) in enumerate(zip(of, batch.column("pos").to_pylist(), batch.column("__size").to_pylist())):
                if key != last or pos >= end:
                    kept.append(i)
                    last, end = key, pos + size
            yield batch.take(pa.array(kept, pa.int64())).select([*keys, "term", "pos"])

    return ordered.mapInArrow(take, ordered.select(*keys, "term", "pos").schema)
