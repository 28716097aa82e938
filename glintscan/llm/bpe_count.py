"""Token counts of byte-pair encoding without making identifiers.

A piece starts as a linked list of its symbols. A heap holds the adjacent pairs
that have a merge, by rank and place; the lowest is taken again and again and
its two symbols become one. The count of a piece is its number of first symbols
less the number of merges. Of a portion of texts every new piece is counted once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import portions

LIMIT = 512
CACHED_CHUNKS, CACHED_PIECES = 1 << 18, 1 << 19
CACHED_LENGTH = 64
PORTION = 1 << 20  # bytes of text counted at a time
AT_ONCE = 1 << 18  # chunks of a long text counted at a time
# A run of ASCII blanks and what follows it. The splitter's pieces never run on
# from other characters into a blank, so texts can be cut before such runs
# unless other white space makes a longer run.
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Fixed value: how byte-level tokenizers of this kind cut texts into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Chunks that the splitter cuts alike between line ends and alone.
_PLAIN = re.compile(r" ?[^ \t-\r]+").fullmatch


def spelled_bytes() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else one from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    others = (b for b in range(256) if b not in own)
    spelling = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [spelling[b] for b in range(256)]


class Recent(dict):
    """A dict of twice ``most`` entries: those used since it was last full, and the ones before."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self.old: dict = {}

    def new(self, keys: Iterable[str]) -> list[str]:
        """The keys that are unknown; known ones count as used."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        unknown = [k for k in set(keys) if k not in self]
        if not self.old:
            return unknown
        old = self.old
        self.update((k, old[k]) for k in unknown if k in old)
        return [k for k in unknown if k not in old]


class Merges:
    """Counts of texts by a tokenizer's merge table; keeps those of recent short chunks and pieces."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        splitter = model["pre_tokenizer"]
        if splitter["type"] != "ByteLevel" or splitter.get("add_prefix_space") or model.get("normalizer"):
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        rules = model["model"]["merges"]
        rules = [tuple(r.split(" ")) if isinstance(r, str) else tuple(r) for r in rules]
        number: dict[str, int] = {}  # from 1: 0 stands for symbols without a merge
        self.pair: dict[int, int] = {}  # rank from 1
        self.wholes = [0]
        for rank, (left, right) in enumerate(rules, 1):
            a, b, whole = (number.setdefault(x, len(number) + 1) for x in (left, right, left + right))
            self.pair.setdefault(a << 32 | b, rank)
            self.wholes.append(whole)
        self.byte = [number.get(c, 0) for c in spelled_bytes()]
        self.first = [self.pair.get(a << 32 | b, 0) for a in self.byte for b in self.byte]
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.cut = regex.compile(PIECES).findall
        self.chunks, self.pieces = Recent(CACHED_CHUNKS), Recent(CACHED_PIECES)

    def merged(self, piece: str) -> int:
        """First symbols less merges."""
        data = piece.encode()
        size = len(data)
        if size < 2:
            return size
        first, pair, wholes = self.first, self.pair.get, self.wholes
        # The merge of each symbol with the next one, by rank from 1; 0 if none.
        merge = [first[a << 8 | b] for a, b in zip(data, data[1:])]
        width = size.bit_length()
        places = (1 << width) - 1
        heap = [m << width | i for i, m in enumerate(merge) if m]
        live = len(heap)  # entries that still stand
        if not live:
            return size
        heapify(heap)
        merge.append(0)
        symbol = list(map(self.byte.__getitem__, data))
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        count = size
        while live:
            low = heappop(heap)
            i, m = low & places, low >> width
            if merge[i] != m:
                continue  # one of the two was merged meanwhile
            symbol[i] = whole = wholes[m]
            count -= 1
            live -= 1
            j = after[i]
            if merge[j]:
                merge[j] = 0
                live -= 1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                merge[i] = m = pair(whole << 32 | symbol[k], 0)
                if m:
                    heappush(heap, m << width | i)
                    live += 1
            else:
                merge[i] = 0
            h = before[i]
            if h >= 0:
                if merge[h]:
                    live -= 1
                merge[h] = m = pair(symbol[h] << 32 | whole, 0)
                if m:
                    heappush(heap, m << width | h)
                    live += 1
        return count

    def _pieces(self, pieces: list[str]) -> None:
        """Count pieces that are not known yet; short ones stay known."""
        for piece in self.pieces.new(p for p in pieces if len(p) <= CACHED_LENGTH):
            self.pieces[piece] = self.merged(piece)

    def _piece(self, piece: str) -> int:
        return self.pieces[piece] if len(piece) <= CACHED_LENGTH else self.merged(piece)

    def whole(self, text: str) -> int:
        """Tokens of any text, cut by itself."""
        n, parts = 0, [text]
        for special in self.specials:  # each of its places is one token
            split = [p.split(special) for p in parts]
            n += sum(len(p) - 1 for p in split)
            parts = [x for p in split for x in p]
        pieces = [piece for part in parts for piece in self.cut(part)]
        self._pieces(pieces)
        return n + sum(map(self._piece, pieces))

    def _learn(self, chunks: list[str]) -> None:
        """Count chunks; plain ones are cut together, a line each."""
        plain = [c for c in chunks if _PLAIN(c) and not any(s in c for s in self.specials)]
        cut = self.cut("\n".join(plain))
        self._pieces(cut)
        known, counts, n = self.pieces, [], 0
        for piece in cut:
            if piece == "\n":
                counts.append(n)
                n = 0
            else:
                n += known[piece] if len(piece) <= CACHED_LENGTH else self.merged(piece)
        self.chunks.update(zip(plain, [*counts, n]))
        if len(plain) < len(chunks):
            done = set(plain)
            for chunk in chunks:
                if chunk not in done:
                    self.chunks[chunk] = self.whole(chunk)

    def _sums(self, cut: list[list[str]]) -> list[int]:
        """Tokens of each list of chunks; what is new in any of them is counted once, together."""
        new = self.chunks.new(chain.from_iterable(cut))
        self._learn(new)
        known = self.chunks.__getitem__
        out = [sum(map(known, of)) for of in cut]
        for chunk in new:
            if len(chunk) > CACHED_LENGTH:
                del self.chunks[chunk]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        plain = [len(t) <= PORTION and not _ODD_SPACE.search(t) for t in texts]
        short = iter(self._sums([_CHUNK.findall(t) for t, p in zip(texts, plain) if p]))
        return [next(short) if p else self.long(t) for t, p in zip(texts, plain)]

    def long(self, text: str) -> int:
        """Tokens of a text that is long or has other white space than ASCII blanks."""
        if _ODD_SPACE.search(text):
            return self.whole(text)
        found, n = _CHUNK.finditer(text), 0
        while chunks := [m.group() for m in islice(found, AT_ONCE)]:
            n += self._sums([chunks])[0]
        return n

    def count(self, text: str) -> int:
        """Tokens of a text."""
        return self.counts([text])[0]


_loaded: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """The table of a file, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers
    library, there on every executor. A null text counts as empty: no bytes, no
    tokens. Null ids and repeated rows keep their rows; an empty table gives an
    empty result; other columns are ignored. A map-only pass; long pieces cost
    n log n.
    """

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        table, texts = merges(tokenizer), pc.fill_null(texts, "")
        return pa.array(chain.from_iterable(table.counts(p.to_pylist()) for p in portions(texts, PORTION)), pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(whole).cast("bigint").alias("n_bytes"),
        counted(F.col(text)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
