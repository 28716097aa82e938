"""Large files and archive members as overlapping blocks of text.

No value holds a whole file: a file is cut into blocks that many tasks read,
a member is inflated as a stream. Blocks are cut at line starts where there are
any within reach, else at characters, and each one carries ``overlap`` bytes of
its neighbours, so that a match across a seam is seen whole.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.functions.encoding import SAMPLE, charset
from glintscan.functions.unzip import TEXT_MEMBERS
from glintscan.operators.match import explode_words, with_words
from glintscan.session import checkpointed
from glintscan.sources.files import open_fs
from glintscan.sources.rules import RuleSet

SIZE = 16 << 20  # bytes of a block
OVERLAP = 4096  # bytes of the neighbours on either side; no match may be longer
HEADS = 4 << 20  # bytes of heads that a task holds
REACH = 65_536  # bytes searched for a line start
DEPTH = 3  # archives within archives
BLOCK = "block bigint, lead bigint, chars bigint, text string"
LINE = {1: b"\n", 2: (b"\n\0", b"\0\n"), 4: (b"\n\0\0\0", b"\0\0\0\n")}
At = Callable[[int, int], bytes]


def codec(name: str | None, head: bytes) -> str:
    """Python's codec of blocks: encodings with a mark get their byte order from it."""
    if name == "utf-16":
        return "utf-16-le" if head[:2] == b"\xff\xfe" else "utf-16-be"
    if name == "utf-32":
        return "utf-32-le" if head[:2] == b"\xff\xfe" else "utf-32-be"
    return "utf-8" if name == "utf-8-sig" else name or "latin-1"


def unit_of(name: str) -> int:
    return 4 if name.startswith("utf-32") else 2 if name.startswith("utf-16") else 1


def char_start(at: At, place: int, name: str) -> int:
    """The first place from ``place`` on where a character starts."""
    unit = unit_of(name)
    place += -place % unit
    if name == "utf-8":
        for step, byte in enumerate(at(place, 4)):
            if byte & 0xC0 != 0x80:
                return place + step
        return place
    if unit == 2:
        high = at(place, 2)[1 if name.endswith("le") else 0 :][:1]
        return place + 2 if high and 0xDC <= high[0] < 0xE0 else place
    if name in ("gb18030", "big5"):
        # Lower bytes are no second bytes of a character.
        low = re.search(rb"[\x00-\x2f]", at(place, REACH))
        return place + low.start() if low else place
    return place


def seam(at: At, place: int, name: str, length: int) -> int:
    """Where the block of ``place`` starts: a line start within reach, else a character."""
    if place <= 0 or place >= length:
        return max(0, min(place, length))
    unit = unit_of(name)
    line = LINE[unit] if unit == 1 else LINE[unit][name.endswith("be")]
    window = at(place - unit, REACH)
    found = window.find(line)
    while found >= 0 and found % unit:
        found = window.find(line, found + 1)
    if found >= 0:
        return min(place + found, length)
    return min(char_start(at, place, name), length)


def decoded(raw: bytes, name: str, known: bool = False) -> str:
    """Bytes as text; blocks that are not UTF-8 where the head was are GB 18030 or Latin-1.

    With a ``known`` encoding only the bytes that do not fit it are replaced.
    """
    if known:
        return raw.decode(name, "replace")
    for tried in (name, "gb18030") if name == "utf-8" else (name,):
        try:
            return raw.decode(tried)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1" if name == "utf-8" else name, "replace")


def block_text(
    at: At, place: int, name: str, length: int, size: int, overlap: int, known: bool = False
) -> tuple | None:
    """``lead, chars, text`` of the block that ``place`` belongs to; None if it starts nowhere in it."""
    start, end = seam(at, place, name, length), seam(at, place + size, name, length)
    if start >= end:
        return None
    low = char_start(at, max(0, start - overlap), name) if start > overlap else 0
    high = min(char_start(at, end + overlap, name), length) if end + overlap < length else length
    low, high = min(low, start), max(high, end)
    lead = decoded(at(low, start - low), name, known)
    body = decoded(at(start, end - start), name, known)
    tail = decoded(at(end, high - end), name, known)
    if low == 0:
        lead, body = (lead.removeprefix("﻿"), body) if lead else (lead, body.removeprefix("﻿"))
    return len(lead), len(body), lead + body + tail


def heads(files: DataFrame) -> DataFrame:
    """``path, length, head``: the first bytes of ``path, length`` rows, up to a line end if there is one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, length in zip(batch["path"], batch["length"]):
                system, inner, _ = open_fs(path)
                with system.open_input_file(inner) as file:
                    out.append((path, length, trimmed(file.read(SAMPLE), length)))
            yield pd.DataFrame(out, columns=["path", "length", "head"])

    return files.select("path", "length").mapInPandas(read, "path string, length bigint, head binary")


def trimmed(head: bytes, length: int) -> bytes:
    """The head of something longer, without a character or line that it cuts."""
    if len(head) >= length:
        return head
    line = head.rfind(b"\n")
    cut = line + 1 if line > 0 else len(head)
    if b"\0" in head:  # two- or four-byte units
        return head[: len(head) // 4 * 4]
    if line <= 0:  # no line: drop the bytes of a cut UTF-8 character
        for back in range(1, 4):
            if head[-back] >= 0xC0:
                return head[:-back]
            if head[-back] < 0x80:
                break
    return head[:cut]


def file_blocks(
    files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, encoding: str | None = None
) -> DataFrame:
    """``path, block, lead, chars, text``: the blocks of ``path, length`` rows, dealt over all tasks.

    The block's own text is the ``chars`` characters after the ``lead`` ones.
    The encoding is that of the head unless it is given; empty files have no
    block. A stream of files gives a stream of blocks.
    """
    size += -size % 4

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                system, inner, _ = open_fs(row.path)
                with system.open_input_file(inner) as file:

                    def at(place: int, n: int) -> bytes:
                        file.seek(place)
                        return file.read(max(0, min(n, row.length - place)))

                    name = codec(row.name, row.mark)
                    made = block_text(
                        at, row.block * size, name, row.length, size, overlap, encoding is not None
                    )
                if made:
                    yield pd.DataFrame([(row.path, row.block, *made)], columns=["path", "block", "lead", "chars", "text"])

    present = files.where("length > 0")
    if encoding is None:
        known = heads(present).selectExpr(
            "path", "length", "substring(head, 1, 4) AS mark", f"{charset('head')} AS name"
        )
    else:
        known = present.select(
            "path", "length", F.lit(b"").alias("mark"), F.lit(encoding).alias("name")
        )
    blocks = known.selectExpr("*", f"explode(sequence(0L, (length - 1) div {size})) AS block")
    cores = files.sparkSession.sparkContext.defaultParallelism
    dealt = blocks.repartition(4 * cores, "path", "block")
    return dealt.mapInPandas(read, f"path string, {BLOCK}")


# --------------------------------------------------------------------- archives
MEMBER = "path string, slice int, member string, chain array<int>, size bigint, error string"
SLICE_BYTES, SLICE_MEMBERS = 64 << 20, 10_000  # members that one task reads in a row


class _Inflated:
    """Forward reading of a member, with the last bytes kept."""

    def __init__(self, stream, kept: int) -> None:
        self.stream, self.kept, self.base, self.held = stream, kept, 0, b""

    def at(self, place: int, n: int) -> bytes:
        lack = place + n - self.base - len(self.held)
        if lack > 0:
            more = self.stream.read(lack)
            drop = max(0, min(place - self.kept - self.base, len(self.held)))
            self.held, self.base = self.held[drop:] + more, self.base + drop
        return self.held[place - self.base : place - self.base + n]


def listed(archive: zipfile.ZipFile, depth: int, name: str = "", chain: tuple = ()) -> Iterator[tuple]:
    """``member, chain, size, error`` of all members, those of inner archives after their own.

    A chain is the number of a member in its archive, for each archive on the way.
    """
    for i, info in enumerate(archive.infolist()):
        if info.is_dir():
            continue
        member, here = name + info.filename, [*chain, i]
        if not info.filename.lower().endswith(".zip"):
            yield member, here, info.file_size, None
        elif len(here) > depth:
            yield member, here, info.file_size, "压缩文件嵌套过深"
        else:
            try:
                with archive.open(info) as stream, zipfile.ZipFile(stream) as inner:
                    yield from listed(inner, depth, f"{member}!/", tuple(here))
            except Exception as problem:  # damaged or encrypted
                yield member, here, info.file_size, f"解压缩失败: {problem}"


class _Archives:
    """The archive opened last with the inner ones on the way to the last member.

    Members come in the order of their archive, so each one is opened once a
    slice and inner ones are read forward.
    """

    def __init__(self) -> None:
        self.path, self.way, self.open = None, [], []

    def close(self) -> None:
        for thing in reversed(self.open):
            thing.close()
        self.path, self.way, self.open = None, [], []

    def find(self, path: str, chain: list[int]) -> tuple[zipfile.ZipFile, zipfile.ZipInfo]:
        if self.path != path or self.way != chain[: len(self.way)] or len(self.way) >= len(chain):
            self.close()
            system, inner, _ = open_fs(path)
            self.open = [system.open_input_file(inner)]
            self.open.append(zipfile.ZipFile(self.open[0]))
            self.path = path
        for number in chain[len(self.way) : -1]:
            archive = self.open[-1]
            self.open.append(archive.open(archive.infolist()[number]))
            self.open.append(zipfile.ZipFile(self.open[-1]))
            self.way.append(number)
        return self.open[-1], self.open[-1].infolist()[chain[-1]]


def member_list(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per member of the ZIP files at ``path``, inner archives opened; no bytes are kept.

    A damaged archive is one row without a member. Members in a row form slices
    by their sizes.
    """

    def rows_of(path: str) -> Iterator[tuple]:
        number = held = count = 0
        try:
            system, inner, _ = open_fs(path)
            with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
                for row in listed(archive, depth):
                    yield path, number, *row
                    held, count = held + row[2], count + 1
                    if held >= SLICE_BYTES or count >= SLICE_MEMBERS:
                        number, held, count = number + 1, 0, 0
        except Exception as problem:
            yield path, number, None, None, None, f"解压缩失败: {problem}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = rows_of(path)
                while some := list(islice(rows, 10_000)):
                    made = pd.DataFrame(some, columns=["path", "slice", "member", "chain", "size", "error"])
                    yield made.astype({"size": "Int64"})

    return files.select("path").mapInPandas(read, MEMBER)


def member_blocks(
    members: DataFrame, wanted: str = TEXT_MEMBERS, size: int = SIZE, overlap: int = OVERLAP
) -> DataFrame:
    """Members of :func:`member_list` as blocks of text, whatever their size.

    Columns: ``path, member, status, error`` and those of blocks. Status is
    ``text``, ``skipped`` (a name that is not ``wanted``) or ``error``; the last
    two have one row without a block, and a text that breaks off has its error
    after the blocks that could be read. Slices are dealt over all tasks, so
    that one large archive is read by many.
    """
    size += -size % 4
    columns = ["path", "member", "status", "error", "block", "lead", "chars", "text"]
    name_test = re.compile(wanted)

    def texts(archive: zipfile.ZipFile, info: zipfile.ZipInfo, charset_name: str | None) -> Iterator[tuple]:
        with archive.open(info) as stream:
            source = _Inflated(stream, 2 * (overlap + REACH) + size)
            name = codec(charset_name, source.at(0, 4))
            for block in range(-(-info.file_size // size)):
                made = block_text(source.at, block * size, name, info.file_size, size, overlap)
                if made:
                    yield block, *made

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives, rows, held = _Archives(), [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = (row.path, row.member)
                nothing = (None, None, None, None)
                if row.error is not None or row.member is None:
                    rows.append((*key, "error", row.error, *nothing))
                elif not name_test.fullmatch(row.member.rpartition("!/")[2]):
                    rows.append((*key, "skipped", None, *nothing))
                else:
                    try:
                        for made in texts(*archives.find(row.path, list(row.chain)), row.name):
                            rows.append((*key, "text", None, *made))
                            held += len(made[-1])
                            if held >= size:
                                yield block_rows(rows, columns)
                                rows, held = [], 0
                    except Exception as problem:  # damaged or encrypted
                        archives.close()
                        rows.append((*key, "error", f"解压缩失败: {row.member}: {problem}", *nothing))
            if rows:
                yield block_rows(rows, columns)
                rows, held = [], 0
        archives.close()

    cores = members.sparkSession.sparkContext.defaultParallelism
    dealt = members.repartition(4 * cores, "path", "slice").sortWithinPartitions("path", "slice", "chain")
    return _named(dealt, name_test).mapInPandas(read, f"path string, member string, status string, error string, {BLOCK}")


def block_rows(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=columns)
    return made.astype({"block": "Int64", "lead": "Int64", "chars": "Int64"})


def _named(members: DataFrame, name_test: re.Pattern) -> DataFrame:
    """Add ``name``: the encoding of each member that will be read, by its head."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives = _Archives()
        for batch in batches:
            out, held = [], 0
            for at, row in enumerate(batch.itertuples(index=False), 1):
                head = None
                if row.error is None and row.member and name_test.fullmatch(row.member.rpartition("!/")[2]):
                    try:
                        archive, info = archives.find(row.path, list(row.chain))
                        with archive.open(info) as stream:
                            head = trimmed(stream.read(SAMPLE), info.file_size)
                    except Exception:  # its error comes with its blocks
                        archives.close()
                out.append(head)
                held += len(head or b"")
                if held >= HEADS or at == len(batch):
                    yield batch.iloc[at - len(out) : at].assign(head=out).astype({"size": "Int64"})
                    out, held = [], 0
        archives.close()

    known = members.mapInPandas(read, f"{MEMBER}, head binary")
    return known.selectExpr("path", "member", "chain", "size", "error", f"{charset('head')} AS name")


# ------------------------------------------------------------------------- hits
def block_hits(blocks: DataFrame, rules: RuleSet, keys: list[str], **options) -> DataFrame:
    """One row per match: ``keys``, kind, term and ``pos`` in the whole text.

    A match belongs to the block that it starts in. Positions follow from the
    character counts of the blocks before; only matches and counts are moved.
    A match must not be longer than the overlap; then the hits are those of the
    whole text, unless matches touch one another over a whole overlap.
    """
    body = blocks.where("text IS NOT NULL").select(*keys, "block", "lead", "chars", "text")
    matched = with_words(body, rules, **options).drop("text")
    found = checkpointed(matched)
    counts = found.select(*keys, "block", "chars")
    before = f"sum(chars) OVER (PARTITION BY {', '.join(keys)} ORDER BY block) - chars"
    starts = counts.selectExpr(*keys, "block", f"{before} AS __from")
    long = explode_words(found.where("size(words) > 0"), [*keys, "block", "lead", "chars"])
    hits = long.select(*keys, "block", "lead", "chars", "kind", "term", F.explode("positions").alias("__at"))
    owned = hits.where("__at >= lead AND __at < lead + chars")
    return owned.join(starts, [*keys, "block"]).selectExpr(*keys, "kind", "term", "__from + __at - lead AS pos")


def large_hits(files: DataFrame, rules: RuleSet, size: int = SIZE, overlap: int = OVERLAP, **options) -> DataFrame:
    """All matches in text files of any size; ``files`` has ``path, length``."""
    return block_hits(file_blocks(files, size, overlap), rules, ["path"], **options)


def member_hits(files: DataFrame, rules: RuleSet, size: int = SIZE, overlap: int = OVERLAP, **options) -> DataFrame:
    """All matches in the text members of ZIP files of any size; see :func:`member_blocks`."""
    blocks = member_blocks(member_list(files), size=size, overlap=overlap)
    return block_hits(blocks, rules, ["path", "member"], **options)
