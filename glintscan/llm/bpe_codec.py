"""Byte-level BPE by a global shuffle of distinct words, and back by the token-byte table.

Texts become pre-tokens with their positions. The distinct pre-tokens of a
block of texts go out by the hash of the word, each distinct word is encoded
once, and its ids come back to the block, where the positions put every text
together again. Positions are written once and never shuffled: their table is
bucketed by block, so only words and their ids move. A block sends a word once
however often it holds it, and a frequent word is one entry of many blocks in
the bucket of its hash, so no key is hot.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import portions
from glintscan.session import run_dir

BLOCK_WORDS = 1 << 18  # distinct words after which a block ends
BLOCK_PIECES = 1 << 21  # pre-tokens after which a block ends
MOST_BUCKETS = 8192
PORTION = 1 << 20  # bytes of text cut at a time
CACHED = 1 << 16  # chunks whose pre-tokens a task keeps
KEPT = 1 << 19  # words whose ids a task keeps
AT_ONCE = 1 << 16  # chunks of a long text handled at a time

# All white space of Unicode. Pre-tokens never run on from other characters into
# white space, so texts are first cut before it, which few steps do.
_BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{_BLANKS}]*[^{_BLANKS}]+|[{_BLANKS}]+")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes: their lowest bytes first, then the next ones, after their count."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 4 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Block:
    """Numbers for the distinct pre-tokens of some texts, in order of appearance."""

    def __init__(self, pattern: str):
        import regex

        self.cut = regex.compile(pattern).findall
        self.pieces: dict[str, int] = {}
        self.n_pieces = 0
        self._forget()

    def _forget(self) -> None:
        self.chunks: dict[str, int] = {}
        self.flat, self.first, self.size = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, chunks: list[str]) -> None:
        pieces, flat, sizes = self.pieces, [], []
        for chunk in chunks:
            cut = self.cut(chunk)
            sizes.append(len(cut))
            for piece in cut:
                flat.append(pieces.setdefault(piece, len(pieces)))
        size = np.array(sizes, np.int64)
        self.first = np.append(self.first, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, np.array(flat, np.int64))
        for chunk in chunks:
            self.chunks[chunk] = len(self.chunks)

    def _numbers(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of the chunks one after another, and each chunk's pieces."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        if new:
            if len(self.chunks) + len(new) > CACHED:
                self._forget()
                new = list(dict.fromkeys(chunks))
            self._learn(new)
        at = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.first[at] - (ends - size), size) + np.arange(total)], size

    def positions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of whole texts one after another, and each text's pieces."""
        if len(texts) == 1:
            found, parts = _CHUNK.finditer(texts[0]), []
            while chunks := [m.group() for m in islice(found, AT_ONCE)]:
                parts.append(self._numbers(chunks)[0].astype(np.uint32))
            numbers = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            sizes = np.array([len(numbers)])
        else:
            cut = [_CHUNK.findall(t) for t in texts]
            numbers, size = self._numbers([c for of in cut for c in of])
            stops = np.cumsum([len(of) for of in cut])
            sizes = np.diff(np.append(0, np.cumsum(size))[stops], prepend=0)
        self.n_pieces += len(numbers)
        return numbers, sizes

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, Iterator[tuple[int, bytes, np.ndarray]]]:
        """The bucket of each word, and for each bucket its words' bytes and sizes in order."""
        words = [w.encode() for w in self.pieces]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")

        def rows() -> Iterator[tuple[int, bytes, np.ndarray]]:
            for run in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(run):
                    held = [words[i] for i in run.tolist()]
                    yield int(bucket[run[0]]), b"".join(held), np.array([len(w) for w in held])

        return bucket, rows()


_COLUMNS = ["block", "doc_ids", "sizes", "positions", "bucket", "words", "lengths"]


def _pretokenized(pattern: str, buckets: int, block_words: int, block_pieces: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        block = Block(pattern)
        id_type = pa.null()

        def row(*values) -> pa.RecordBatch:
            kinds = [
                pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], _COLUMNS)

        def closed() -> Iterator[pa.RecordBatch]:
            bucket_of, rows = block.by_bucket(buckets)
            yield row(number, None, None, packed(bucket_of), -1, None, None)
            for bucket, words, lengths in rows:
                yield row(number, None, None, None, bucket, words, packed(lengths))

        open_ = False
        for batch in batches:
            start, id_type = 0, batch.schema.types[0]
            for part in portions(pc.fill_null(batch.column(1), ""), PORTION):
                numbers, sizes = block.positions(part.to_pylist())
                ids = batch.column(0).slice(start, len(part)).to_pylist()
                yield row(number, ids, sizes.tolist(), packed(numbers), None, None, None)
                start, open_ = start + len(part), True
                if len(block.pieces) >= block_words or block.n_pieces >= block_pieces:
                    yield from closed()
                    number, block, open_ = number + 1, Block(pattern), False
        if open_:
            yield from closed()

    return split


def pretokens(
    docs: DataFrame, pattern: str, doc_id: str, text: str, buckets: int, block_words: int, block_pieces: int
) -> DataFrame:
    """Rows of positions by document and rows of distinct words, in a table bucketed by block.

    Positions: ``block, doc_ids, sizes, positions``; words: ``block, bucket,
    words, lengths``; one row a block with ``bucket`` -1 has the words' buckets.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    split = _pretokenized(pattern, buckets, block_words, block_pieces)
    schema = (
        f"block bigint, doc_ids array<{kind.simpleString()}>, sizes array<bigint>, positions binary,"
        " bucket int, words binary, lengths binary"
    )
    name = f"bpe_{uuid.uuid4().hex}"
    written = rows.mapInArrow(split, schema).write.bucketBy(buckets, "block")
    written.option("path", run_dir(spark, "bpe")).option("compression", "none").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name: the files lie in the shared folder
    return out


_ranks: dict[str, dict[bytes, int]] = {}
_encoders: dict[tuple[str, str], object] = {}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file, read once in each worker."""
    if path not in _ranks:
        with open(path, "rb") as file:
            _ranks[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return _ranks[path]


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        from tiktoken import Encoding

        own = Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
        _encoders[path, pattern] = own.encode_single_piece if hasattr(own, "encode_single_piece") else own._encode_single_piece
    return _encoders[path, pattern]


def word_ids(words: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """``block, bucket, ids, counts``: the ids of each row's words, each distinct word encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, known = _encoder(path, pattern), {}
        for batch in batches:
            out: list[list[bytes]] = [[], []]
            for data, lengths in zip(batch.column(2), batch.column(3)):
                ends = np.cumsum(unpacked(lengths.as_py()).astype(np.int64))
                offsets = pa.py_buffer(np.append(0, ends).tobytes())
                found = []
                for word in pa.Array.from_buffers(
                    pa.large_binary(), len(ends), [None, offsets, data.as_buffer()]
                ).to_pylist():
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KEPT:
                            known.clear()
                        ids = known[word] = array("I", merge(word)).tobytes()
                    found.append(ids)
                out[0].append(packed(np.frombuffer(b"".join(found), np.uint32)))
                out[1].append(packed(np.array([len(x) // 4 for x in found])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(o, pa.binary()) for o in out)],
                ["block", "bucket", "ids", "counts"],
            )

    dealt = words.select("block", "bucket", "words", "lengths").repartition(buckets, "bucket")
    return dealt.mapInArrow(encode, "block bigint, bucket int, ids binary, counts binary")


def _reassembled(texts: pa.Table, words: pa.Table, path: str | None = None) -> pa.Table:
    """The texts of a block with the ids of their words put in their places.

    With the ``path`` of a rank file also the bytes that the ids decode to.
    """
    words = words.sort_by("bucket")
    ids, counts = (
        np.concatenate([np.zeros(0, np.uint32), *(unpacked(x) for x in words[c].to_pylist())])
        for c in ("ids", "counts")
    )
    counts = counts.astype(np.int64)
    rows = texts.to_pylist()
    bucket_of = next(unpacked(r["positions"]) for r in rows if r["bucket"] is not None)
    order = np.argsort(bucket_of, kind="stable")  # words by bucket, as they went out
    first, count = np.empty_like(counts), np.empty_like(counts)
    first[order], count[order] = np.cumsum(counts) - counts, counts
    docs, out = [], []
    for r in rows:
        if r["bucket"] is not None:
            continue
        at = unpacked(r["positions"])
        size = count[at]
        ends = np.cumsum(size)
        whole = ids[np.repeat(first[at] - (ends - size), size) + np.arange(int(size.sum()))].astype("<u4")
        stops = np.append(0, ends)[np.cumsum(r["sizes"])]
        docs += r["doc_ids"]
        out += [x.tobytes() for x in np.split(whole, stops[:-1])]
    id_type = texts.schema.field("doc_ids").type.value_type
    columns = {"doc_id": pa.array(docs, id_type), "ids": pa.array(out, pa.binary())}
    if path is not None:
        columns["bytes"] = pa.array((token_bytes(x, path) for x in out), pa.binary())
    return pa.table(columns)


def encoded(
    docs: DataFrame,
    path: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int | None = None,
    block_words: int = BLOCK_WORDS,
    block_pieces: int = BLOCK_PIECES,
    with_bytes: bool = False,
) -> DataFrame:
    """``doc_id, ids``: every row's ids as little-endian unsigned 32-bit integers.

    ``with_bytes`` adds ``bytes``, decoded from the ids of each text in the task
    that has them; ``decoded`` does the same for any column of ids.

    ``path`` is a file of token bytes and ranks, there on every executor;
    ``pattern`` finds the pre-tokens and must not let one run from other
    characters into white space. A null text counts as empty: no ids. Null and
    repeated ids and repeated rows keep their rows; an empty table gives an
    empty result; other columns are ignored. Long texts are read whole, a text
    larger than a block being a block of its own.

    ``buckets``: by how many hashes words are dealt; as many as the scan has
    partitions, so that a bucket's words grow with a partition and not with the
    table. Blocks end at so many words or pre-tokens.
    """
    if buckets is None:
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(MOST_BUCKETS, max(least, docs.rdd.getNumPartitions()))
    pieces = pretokens(docs, pattern, doc_id, text, buckets, block_words, block_pieces)
    texts = pieces.where("bucket IS NULL OR bucket < 0").select(*_COLUMNS[:5])
    ids = word_ids(pieces.where("bucket >= 0"), path, pattern, buckets)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids binary"
    schema += ", bytes binary" if with_bytes else ""

    def reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        return _reassembled(texts, words, path if with_bytes else None)

    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(reassemble, schema)


def decoded(ids: Column, path: str) -> Column:
    """The bytes of ids, by a join with the token-byte table, whose size is the vocabulary's.

    ``ids`` are little-endian unsigned 32-bit integers; null stays null.
    """

    @F.arrow_udf("binary")
    def join(cells: pa.Array) -> pa.Array:
        return pa.array((token_bytes(c.as_buffer(), path) if c.is_valid else None for c in cells), pa.binary())

    return join(ids)


def token_bytes(ids, path: str) -> bytes:
    """The bytes of the tokens one after another, looked up in the token-byte table."""
    taken = _token_table(path).take(pa.array(np.frombuffer(ids, "<u4")))
    if not len(taken):
        return b""
    bounds = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return taken.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes()


_tables: dict[str, pa.Array] = {}


def _token_table(path: str) -> pa.Array:
    if path not in _tables:
        by_id = {i: b for b, i in ranks(path).items()}
        _tables[path] = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.large_binary())
    return _tables[path]


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded."""
    return encoded(docs, path, pattern, doc_id, text, with_bytes=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
