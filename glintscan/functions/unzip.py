"""ZIP bytes to members: the one step in Python, which only inflates."""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.functions import fixed

MEMBER = "member string, size bigint, data binary, error string"
PORTION = 8 << 20  # bytes of members in one Arrow batch
ROW = 400  # bytes that a member takes besides its data
BOX = pa.struct([("member", pa.string()), ("size", pa.int64()), ("data", pa.binary()), ("error", pa.string())])
# A cell of a row must fit a task's memory: larger members give a visible error.
LARGEST = 200 << 20
TEXT_MEMBERS = r".*\.(?i:" + "|".join(e[1:] for e in fixed.ARCHIVE_TEXT_EXTENSIONS) + ")"
TYPE_FILES = ("mimetype", "[Content_Types].xml")
TYPE_MEMBERS = r"mimetype|\[Content_Types\]\.xml"
MEMBER_TEXT = "replace(make_valid_utf8(cast({} AS string)), '\\uFFFD', '')"


def _plain_member(raw: bytes, info: zipfile.ZipInfo, largest: int) -> bytes | None:
    """The bytes of a sound stored or deflated member, NULL for any other: those are left to ``zipfile``."""
    at, flags = info.header_offset, info.flag_bits
    if flags & ~0x80E or info.compress_type not in (0, 8) or info.file_size > largest or not 0 <= at <= len(raw) - 30:
        return None
    # Flags and name of the member itself, which zipfile checks too.
    mark, own_flags, name_size, extra_size = struct.unpack_from("<4s2xH18x2H", raw, at)
    start = at + 30 + name_size
    try:
        name = info.orig_filename.encode("utf-8" if flags & 0x800 else "cp437")
    except UnicodeEncodeError:
        return None
    if mark != b"PK\3\4" or own_flags != flags or raw[at + 30 : start] != name:
        return None
    start += extra_size
    end = start + info.compress_size
    limit = getattr(info, "_end_offset", None)
    if end > len(raw) or (limit is not None and end > limit):
        return None
    if info.compress_type == 0:
        data = raw[start:end]
    else:
        stream = zlib.decompressobj(-15)
        try:
            data = stream.decompress(memoryview(raw)[start:end], info.file_size + 1)
        except zlib.error:
            return None
        if not stream.eof:
            return None
    return data if len(data) == info.file_size and zlib.crc32(data) == info.CRC else None


def _opened_member(archive: zipfile.ZipFile, info: zipfile.ZipInfo, largest: int) -> tuple[bytes | None, str | None]:
    """Bytes or error of any member."""
    try:
        with archive.open(info) as member:
            data = member.read(largest + 1)
    except Exception as problem:  # damaged or encrypted
        return None, f"解压缩失败: {info.filename}: {problem}"
    return (data, None) if len(data) <= largest else (None, f"成员过大: {info.filename}")


def inflate(raw: bytes, wanted: str, largest: int) -> Iterator[tuple]:
    """``member, size, data, error`` of each file member of ZIP bytes.

    Only members whose name matches ``wanted`` are inflated, never beyond
    ``largest`` bytes. Damaged, encrypted and larger members have an error; a
    damaged archive is one row without a member.
    """
    try:
        archive = zipfile.ZipFile(BytesIO(raw))
    except Exception as problem:
        yield None, None, None, f"解压缩失败: {problem}"
        return
    name = re.compile(wanted)
    with archive:
        for info in archive.infolist():
            data = error = None
            if info.is_dir():
                continue
            if name.fullmatch(info.filename):
                data = _plain_member(raw, info, largest)
                if data is None:
                    data, error = _opened_member(archive, info, largest)
            yield info.filename, info.file_size, data, error


def inflated(files: DataFrame, wanted: str, largest: int = LARGEST) -> DataFrame:
    """``path, seq`` and one row per member of ``path, content`` rows; each ZIP is opened once."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("seq", pa.int32()), *BOX])
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            # One file at a time becomes a value of Python.
            for path, raw in zip(batch.column(0), batch.column(1)):
                name = path.as_py()
                for seq, row in enumerate(inflate(raw.as_py(), wanted, largest)):
                    rows.append((name, seq, *row))
                    held += len(row[2] or b"") + ROW
                    if held >= PORTION:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return files.select("path", "content").mapInArrow(extract, f"path string, seq int, {MEMBER}")


def boxes(batches: Iterator[pa.Array], wanted: str, largest: int) -> Iterator[pa.Array]:
    """The members of each file as a list, in arrays of about ``PORTION`` bytes."""

    def read(raw) -> list[tuple] | None:
        if raw is None:
            return None
        out, left = [], largest
        for member, size, data, error in inflate(raw, wanted, largest):
            if data is not None and len(data) > left:
                data, error = None, f"成员过大: {member}"
            left -= len(data or b"")
            out.append((member, size, data, error))
        return out

    for batch in batches:
        out, held = [], 0
        for raw in batch:
            out.append(read(raw.as_py()))
            held += sum(len(m[2] or b"") + ROW for m in out[-1] or ())
            if held >= PORTION:
                yield pa.array(out, pa.list_(BOX))
                out, held = [], 0
        if out:
            yield pa.array(out, pa.list_(BOX))


def boxed(content: str, wanted: str, largest: int = LARGEST) -> Column:
    """All members of one file as an array, NULL for NULL bytes.

    For plans that keep one row per file. The members of one file together may
    hold ``largest`` bytes; those beyond have an error. Results leave in
    portions, so that a task holds those of a few files, not of a batch.
    """

    @F.arrow_udf("array<struct<member: string, size: bigint, data: binary, error: string>>")
    def members(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from boxes(batches, wanted, largest)

    # Not to be merged into lambda bodies of later expressions.
    return members.asNondeterministic()(F.expr(content))
