"""The encoding of text files by byte-order marks, zero bytes and byte pairs.

All of it is SQL text over the bytes; only files in other encodings than UTF-8
go to Python, to be decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glintscan.functions.cols import case, let, lit

SAMPLE = 65_536
PORTION = 4 << 20  # bytes that are decoded together
UTF8 = ["utf-8", "utf-8-sig"]
MARKS = [
    ("FFFE0000", "utf-32"), ("0000FEFF", "utf-32"), ("EFBBBF", "utf-8-sig"), ("FFFE", "utf-16"), ("FEFF", "utf-16"),
]
# Bytes are seen as the characters U+0000 to U+00FF.
_GB = r"[\x81-\xfe](?:[\x40-\x7e\x80-\xfe]|[0-9][\x81-\xfe][0-9])"
_GB_COMMON = r"[\xb0-\xf7\xa1-\xa9][\xa1-\xfe]"  # the characters of GB 2312
_BIG5 = r"[\xa1-\xf9][\x40-\x7e\xa1-\xfe]"
_BIG5_COMMON = r"[\xa1-\xc6][\x40-\x7e\xa1-\xfe]"  # marks and the first level of characters
_CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f]"
_SHOWN = r"[\x09\x0a\x0c\x0d\x20-\x7e\xa0-\xff]"


def portions(content: pa.Array, limit: int = PORTION) -> Iterator[tuple[int, int]]:
    """``start, n`` of slices of about ``limit`` bytes; at least one row each."""
    start = held = 0
    for at, size in enumerate(pc.binary_length(content)):
        held += (size.as_py() or 0) + 8
        if held >= limit:
            yield start, at + 1 - start
            start, held = at + 1, 0
    if start < len(content):
        yield start, len(content) - start


def bytes_seen(content: str, size: int | None = None) -> str:
    """Bytes, or the first ``size`` of them, as characters of the same numbers."""
    return f"decode({content if size is None else f'substring({content}, 1, {size})'}, 'ISO-8859-1')"


def _found(view: str, pattern: str, of: str) -> str:
    """How many of the matches of ``of``, one after another, are matches of the two bytes ``pattern``."""
    return f"length(regexp_replace({view}, {lit(f'(?s)({pattern})|{of}|.')}, '$1')) div 2"


def _wide(view: str) -> str:
    """UTF-16 without a mark: zero bytes on one side of the byte pairs only.

    The other side must be printable; pairs of common ideographs, kana and
    wide forms count as text without a zero byte.
    """

    def share(pattern: str) -> str:
        return f"({_found(view, pattern, '..')}) / greatest(length({view}) div 2, 1)"

    high = r"[\x00\x20\x30\x4e-\x9f\xff]"
    few = f"{share(r'\x00\x00')} < 0.01D"
    zero = {"utf-16-le": f"{_SHOWN}\\x00", "utf-16-be": f"\\x00{_SHOWN}"}
    tests = [
        (f"length({view}) > 3 AND {mine} > 0.9D AND {mine} >= {other} AND {few} AND {share(zero[name])} > 0", lit(name))
        for name, mine, other in (("utf-16-le", "le", "be"), ("utf-16-be", "be", "le"))
    ]
    return let(share(f".{high}"), "le", let(share(f"{high}."), "be", case(tests)))


def _pairs(content: str) -> str:
    """Encodings of two bytes a character, or Latin-1, of bytes without zeros that are not UTF-8."""
    view = bytes_seen(content, SAMPLE)
    whole = bytes_seen(content)

    def fits(pattern: str) -> str:
        # A file may end within a character.
        return f"NOT (regexp_replace(regexp_replace({whole}, {lit(pattern)}, ''), {lit(r'[\x81-\xfe]$')}, '') RLIKE {lit(r'[\x80-\xff]')})"

    big5 = f"({_found('vw', _BIG5_COMMON, _BIG5)}) / greatest(regexp_count(vw, {lit(_BIG5)}), 1)"
    high = f"length(regexp_replace(vw, {lit(r'[\x00-\x7f]')}, '')) / length(vw)"
    chosen = case(
        [
            (f"ng > 0 AND gb >= 0.95D AND {fits(_GB)}", "'gb18030'"),
            (f"{high} > 0.3D AND regexp_count(vw, {lit(_BIG5)}) > 0 AND {big5} >= 0.9D AND {fits(_BIG5)}", "'big5'"),
            (f"ng > 0 AND gb >= 0.5D AND {fits(_GB)}", "'gb18030'"),
            (f"{high} < 0.3D AND NOT ({whole} RLIKE {lit(_CONTROL)})", "'latin-1'"),
            (f"ng > 0 AND {fits(_GB)}", "'gb18030'"),
        ]
    )
    common = f"({_found('vw', _GB_COMMON, _GB)}) / greatest(ng, 1)"
    return let(view, "vw", let(f"regexp_count(vw, {lit(_GB)})", "ng", let(common, "gb", chosen)))


def charset(content: str) -> str:
    """Python's name of the encoding of text bytes, NULL for bytes that are no text (SQL text).

    A byte-order mark before whole code units decides, and the name makes
    Python read it; zero bytes mean UTF-16 or no text; then come valid UTF-8,
    GB 18030 or Big5 by their byte pairs, checked over the whole file, and
    Latin-1 for few high bytes and no controls.
    """
    head = f"hex(substring({content}, 1, 4))"
    view = bytes_seen(content, 4096)
    unit = {"utf-32": 4, "utf-16": 2, "utf-8-sig": 1}
    marked = [
        (f"startswith(hx, '{mark}') AND octet_length({content}) % {unit[name]} = 0", lit(name)) for mark, name in MARKS
    ]
    no_zero = case(
        [(f"is_valid_utf8(cast({content} AS string))", "'utf-8'")], _pairs(content)
    )
    by_bytes = let(view, "zv", f"if(contains(zv, {lit(chr(0))}), {_wide('zv')}, {no_zero})")
    return let(head, "hx", case(marked, by_bytes))


def decoded(raw: bytes | None, name: str | None) -> str | None:
    return None if raw is None else raw.decode(name or "latin-1", "replace").removeprefix("\ufeff")


@F.arrow_udf(StringType())
def _decode_as(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for content, names in batches:
        for start, n in portions(content):
            rows = zip(content.slice(start, n), names.slice(start, n))
            yield pa.array([decoded(raw.as_py(), name.as_py()) for raw, name in rows], pa.string())


def with_text(df: DataFrame, content: str, out: str, name: str | None = None) -> DataFrame:
    """Add struct(text, encoding): bytes decoded by their :func:`charset`, Latin-1 if they have none.

    ``name`` is the encoding where it is known already. Byte-order marks are
    cut off; NULL bytes give NULLs.
    """
    known = f"if({content} IS NULL, NULL, coalesce({name or charset(content)}, 'latin-1'))"
    plain = f"__charset IN ('utf-8', 'utf-8-sig') AND is_valid_utf8(cast({content} AS string))"
    cut = f"cast(if(__charset = 'utf-8-sig', substring({content}, 4), {content}) AS string)"
    # Not to be merged into lambda bodies of later expressions.
    other = _decode_as.asNondeterministic()(F.expr(f"if({plain}, NULL, {content})"), F.col("__charset"))
    named = df.withColumn("__charset", F.expr(known)).withColumn("__other", other)
    text = F.coalesce(F.expr(f"if({plain}, {cut}, NULL)"), F.col("__other"))
    return named.withColumn(out, F.struct(text.alias("text"), F.col("__charset").alias("encoding"))).drop(
        "__charset", "__other"
    )
