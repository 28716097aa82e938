"""Byte-level BPE over a shuffle of distinct words, against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from glintscan.llm import bpe_codec

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_codec.ranks(PATH), special_tokens={})


def _texts():
    rnd = random.Random(9)
    pool = [chr(rnd.randrange(1, 0x3000)) for _ in range(200)] + list(" \n\t\u0085\xa0　\x1c  'sdlleabcÀÉßİΣ.,;!$́")
    pool += ["<|endoftext|>", " " * 5, "aaaa", "\U0001f600", "It's", "'ll", "12", " ", " ", "\n", "\r\n", "\xa0 \xa0"] * 5
    out = ["".join(rnd.choices(pool, k=rnd.randrange(60))) for _ in range(600)]
    out += ["", None, " ", "\n\n  x", "x  \n", "ab" * 2000, "a" * 3000, "word " * 2000, "  lead", "日本語のテキスト" * 20]
    return out + out[:7]


@pytest.mark.parametrize("options", [{}, {"buckets": 3, "block_words": 50, "block_pieces": 300}])
def test_encode_and_decode(spark, library, options):
    rows = list(enumerate(_texts()))
    rows += [(None, "null id"), (None, None), rows[4], rows[4]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, ids string, block int")
    out = bpe_codec.encoded(docs.repartition(4), PATH, PATTERN, **options)
    got = out.withColumn("bytes", bpe_codec.decoded(F.col("ids"), PATH)).collect()
    key = lambda r: (r[0] is not None, r[0], bytes(r[1]))
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows]
    assert sorted((tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in got), key=key) == sorted(want, key=key)
    assert bpe_codec.encoded(docs.limit(0), PATH, PATTERN).count() == 0


def test_round_trip(spark, library):
    docs = spark.createDataFrame([("a", "It's 12 o'clock"), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.round_trip(docs, PATH, PATTERN).collect()}
    for name, text in (("a", "It's 12 o'clock"), ("b", "")):
        ids = library.encode_ordinary(text)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), text.encode())]
        assert got[name] == (len(ids), *digests)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bpe_")]


def test_positions_of_long_texts(monkeypatch, library):
    text = " ".join("w%d,x" % (i % 700) for i in range(4000))
    monkeypatch.setattr(bpe_codec, "AT_ONCE", 100)
    monkeypatch.setattr(bpe_codec, "CACHED", 250)
    block = bpe_codec.Block(PATTERN)
    for texts in ([text], [text, "", text[:50]], [""]):
        numbers, sizes = block.positions(texts)
        words = list(block.pieces)
        assert sizes.sum() == len(numbers) and len(sizes) == len(texts)
        for t, at in zip(texts, np.split(numbers, np.cumsum(sizes)[:-1])):
            assert "".join(words[i] for i in at) == t


@pytest.mark.parametrize("n", [0, 1, 5, 70_000])
def test_pack(n):
    numbers = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert bpe_codec.unpacked(bpe_codec.packed(numbers)).tolist() == numbers.tolist()


def test_words_of_a_block_go_out_once(spark):
    docs = spark.createDataFrame([(i, "the same words over and over ") for i in range(50)], "doc_id bigint, text string")
    pieces = bpe_codec.pretokens(docs.coalesce(1), PATTERN, "doc_id", "text", 4, 1 << 19, 1 << 23)
    rows = pieces.where("bucket >= 0").select("lengths").collect()
    assert sum(len(bpe_codec.unpacked(bytes(r.lengths))) for r in rows) == 6
