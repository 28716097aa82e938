"""Token ids as fixed-width packed blocks.

Every id takes the fewest bits that hold the vocabulary. A block keeps whole
documents: packed ids, the document ids, and the place where each ends. Blocks
are rows of a Parquet table in ascending order of document, so any store that
Spark writes to can hold them, lost tasks are written again, and a reader finds
a block by its number and unpacks any range of it with numpy.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glintscan.llm.common import portions

END = 1
BLOCK_IDS = 1 << 16
STEP = 1 << 16  # ids turned into bits at once
CACHED = 300_000

BLOCKS = (
    "part int, block int, first bigint, n_ids bigint, bits int,"
    " doc_ids array<bigint>, ends array<bigint>, packed binary"
)
_BLOCKS = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
        ("packed", pa.binary()),
    ]
)
_DOCS = pa.schema(
    [("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()),
     ("ids_crc32", pa.int64())]
)


def width(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, ``bits`` bits each, low bits first."""
    shift = np.arange(bits, dtype=np.uint32)
    out = []
    for at in range(0, len(ids), STEP):  # STEP is a multiple of 8: parts end on bytes
        part = ids[at : at + STEP].astype(np.uint32)
        out.append(np.packbits(((part[:, None] >> shift) & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack(packed: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a packed block; reads only their bytes."""
    first = start * bits
    raw = np.frombuffer(packed, np.uint8)[first // 8 : (stop * bits + 7) // 8]
    ones = np.unpackbits(raw, bitorder="little")[first % 8 :][: (stop - start) * bits]
    weights = np.left_shift(np.uint32(1), np.arange(bits, dtype=np.uint32))
    return ones.reshape(-1, bits) @ weights


# Letters whose lower case and canonical form are single characters, and marks
# that never share a token with a letter before them.
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = re.compile(f"[{_LETTERS}]+").fullmatch
_MARK = f"([{_LETTERS}])([.,;:!?*$%#&])"


class WordIds:
    """Ids of texts by a tokenizer that drops white space and lower-cases, by distinct word.

    Its tokens never reach over a blank, nor from a letter to a mark, so a
    text's ids are those of its words one after another. Words of plain letters
    are one piece, which goes straight to the tokenizer's model; all others go
    through the whole tokenizer. Recent words are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # How the model's table spells the bytes of those letters.
        letters = [chr(c) for c in range(0x61, 0x100) if _WORD(chr(c))]
        self.spelling = {ord(c): spell(c)[0][0] for c in letters}
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self, words: pa.Array) -> None:
        model, new = self.tokenizer.model.tokenize, words.to_pylist()
        plain = [_WORD(w) is not None for w in new]
        whole = self.tokenizer.encode_batch_fast(
            [w for w, p in zip(new, plain) if not p], add_special_tokens=False
        )
        rest = iter(whole)
        ids = [
            [t.id for t in model(w.lower().translate(self.spelling))] if p else next(rest).ids
            for w, p in zip(new, plain)
        ]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, sizes.sum())
        self.words = pa.concat_arrays([self.words, words])
        self.flat, self.sizes = np.append(self.flat, flat), np.append(self.sizes, sizes)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, ``end`` after each text, and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        if not any(pc.any(pc.match_substring(texts, s, ignore_case=True)).as_py() for s in self.specials):
            texts = pc.ascii_lower(pc.replace_substring_regex(texts, _MARK, r"\1 \2"))
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        number = pc.index_in(words, value_set=self.words)
        if number.null_count:
            new = words.filter(number.is_null()).unique()
            if len(self.words) + len(new) > CACHED:
                self._forget()
                new = words.unique()
            self._learn(new)
            number = pc.index_in(words, value_set=self.words)
        # One more word, after each text: the end id.
        flat, sizes = np.append(self.flat, np.uint32(end)), np.append(self.sizes, 1)
        at = np.cumsum(sizes) - sizes
        stops = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        word = np.insert(number.to_numpy().astype(np.int64), stops, len(sizes) - 1)
        many = sizes[word]
        ends = np.cumsum(many)
        ids = flat[np.repeat(at[word] - (ends - many), many) + np.arange(many.sum())]
        return ids, np.diff(ends[stops + np.arange(len(stops))], prepend=0)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of a file, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        docs, start = batch.column(0).to_pylist(), 0
        for part in portions(batch.column(1), 2 << 20):
            ids, sizes = word_ids(path).encode(part, end)
            yield from zip(docs[start:], np.split(ids, np.cumsum(sizes)[:-1]))
            start += len(part)


def _blocks(path: str, bits: int, end: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block = first = size = 0
        docs: list = []
        ends: list[int] = []
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            packed = pack(np.concatenate(held), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in
                 zip([part, block, first, size, bits, docs, ends, packed], _BLOCKS)],
                schema=_BLOCKS,
            )

        for doc, ids in _encoded(batches, path, end):
            docs.append(doc)
            held.append(ids)
            size += len(ids)
            ends.append(size)
            if size >= block_ids:
                yield row()
                block, first, size = block + 1, first + size, 0
                docs, ends, held = [], [], []
        if docs:
            yield row()

    return write


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end: int = END,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode whole texts in ascending order of document and write packed blocks.

    ``tokenizer`` is a file of the tokenizers library whose tokens never hold or
    span blanks. One range shuffle of the texts; equal ids are ordered, and split between
    partitions, by a hash of the text. Null ids come first, null texts count as
    empty (only the end id). A block closes at ``block_ids`` ids; a document
    longer than that has a block of its own. Other columns are ignored.
    """
    bits = width(max(word_ids(tokenizer).tokenizer.get_vocab_size(), end + 1))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_blocks(tokenizer, bits, end, block_ids), BLOCKS).write.parquet(path)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, per document: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before. The totals of the
    partitions are a row each, whatever the number of documents.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                starts = [0, *b["ends"][:-1]]
                crcs = [
                    zlib.crc32(unpack(b["packed"], b["bits"], i, j).astype("<u4").tobytes())
                    for i, j in zip(starts, b["ends"])
                ]
                sizes = [j - i for i, j in zip(starts, b["ends"])]
                columns = [[b["part"]] * len(crcs), b["doc_ids"], [b["first"] + i for i in starts], sizes, crcs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _DOCS)], schema=_DOCS
                )

    before = W.orderBy("of").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        blocks.groupBy(F.col("part").alias("of")).agg(F.sum("n_ids").alias("total"))
        .select("of", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )
    found = blocks.mapInArrow(
        digest, "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return found.join(F.broadcast(bases), F.col("part") == F.col("of")).select(
        "doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_range(spark: SparkSession, path: str, part: int, block: int, start: int, stop: int) -> np.ndarray:
    """Random access: ids ``start`` to ``stop`` of one block."""
    row = (
        spark.read.schema(BLOCKS).parquet(path)
        .where((F.col("part") == part) & (F.col("block") == block))
        .select("packed", "bits").first()
    )
    return unpack(bytes(row.packed), row.bits, start, stop)
