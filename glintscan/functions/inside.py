"""Texts of files whose bytes need Python: Office files, archives, other encodings than UTF-8.

Texts of ZIP files are made by the task that opens them, the same ones as ``sources.archives.office_text`` and ``archive_text`` give
from all members, so that a scan moves one text a file and not the XML that
holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cmp_to_key

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glintscan.functions import fixed, office, opendocument
from glintscan.functions.detect import _best_decodings
from glintscan.functions.encoding import decoded
from glintscan.functions.unzip import BOX, LARGEST, PORTION, ROW, TEXT_MEMBERS, TYPE_FILES, inflate

# Members whose bytes later expressions read.
KEPT = (*TYPE_FILES, opendocument.BODY.replace("\\", ""))
INSIDE = pa.struct([("box", pa.list_(BOX)), ("text", pa.string()), ("encoding", pa.string())])
IS_ZIP = "zip"  # stands for the encoding of ZIP bytes

# Java's classes without (?U) are those of ASCII; its dot and dollar know five line ends.
_END = r"\n\r\x85\u2028\u2029"
_A = re.ASCII
_DOCX, _SHEET, _SLIDE = (re.compile(p, _A) for p in (office.DOCX_BODY, office.SHEET, office.SLIDE))
_TEXT_MEMBER = re.compile(TEXT_MEMBERS.replace(".*", f"[^{_END}]*", 1), _A)
_FOLDER = re.compile(f"([^{_END}]*)/")
_VISIBLE = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_EDGES = re.compile(rf"\A[ \t-\r]+|[ \t-\r]+(?=(?:\r\n|[{_END}])?\Z)")
_NUMBER = re.compile(r"([0-9]+)\.xml\Z")
_INT = re.compile(r"[+-]?[0-9]+")
_REFERENCE = re.compile("&#(?:([0-9]{1,7})|x([0-9A-Fa-f]{1,6}));")
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _opened(tag: str) -> tuple[re.Pattern, str]:
    return re.compile(rf"<({office.PREFIX}{tag})((?:\s[^>]*)?)/>", _A), rf"<\1\2></\1>"


def _closed(tag: str) -> re.Pattern:
    return re.compile(f"</{office.PREFIX}{tag}>", _A)


def _tag(tag: str) -> re.Pattern:
    return re.compile(rf"<{office.PREFIX}{tag}(?=[\s/>])[^>]*>", _A)


def _attribute(name: str) -> re.Pattern:
    return re.compile(rf"[\s:]{name}\s*=\s*[\"']([^\"']*)", _A)


_SHAPES = ("sp", "pic", "graphicFrame", "cxnSp")
_OPENED = {t: _opened(t) for t in ("p", "si", "row", "c", "tr", "tc", *_SHAPES)}
_CLOSED = {t: _closed(t) for t in ("p", "si", "row", "c", "tr", "tc", "pic", "tbl")}
_SHAPE_END = re.compile(f"</{office.PREFIX_FIXED}(?:{'|'.join(_SHAPES)})>", _A)
_RUN = re.compile(rf"<{office.PREFIX}t(?:\s[^>]*)?>([^<]*)</", _A)
_VALUE = re.compile(rf"<{office.PREFIX}v(?:\s[^>]*)?>([^<]*)<", _A)
_CHART = re.compile(rf"<{office.PREFIX}chart[\s/>]", _A)
_RELATION, _SHEET_TAG, _CELL = _tag("Relationship"), _tag("sheet"), _tag("c")
_ID, _TARGET, _KEY, _TYPE = (_attribute(n) for n in ("Id", "Target", "id", "t"))
_PLACE = re.compile('[ ]r="([A-Z]{1,3})')
# Rows of cells as spreadsheet programs write them; all others go cell by cell.
_PLAIN_CELL = (
    r'<c(?: r="{}[A-Z]{{1,3}}{}[0-9]+")?(?: s="[0-9]+")?(?: t="{}[A-Za-z]+{}")?'
    r"(?:/>|>(?:<is><t(?: xml:space=\"preserve\")?>{}[^<]*{}</t></is>|<v>{}[^<]*{}</v>|)</c>)"
)
_BEFORE = rf"(?:[^<]*+<(?!/?{office.PREFIX}[ctv][\s/>])[^<>]*+>)*+"
_INLINE = re.compile(
    r'<c(?: s="[0-9]+")? t="inlineStr"><is><t(?: xml:space="preserve")?>([^<]*)</t></is></c>', _A
)
_BEFORE_CELLS = re.compile(_BEFORE, _A)
_PLAIN_ROW = re.compile(rf"{_BEFORE}(?:[^<]*+{_PLAIN_CELL.format(*[''] * 8)})*+[^<]*", _A)
_PLAIN = re.compile(_PLAIN_CELL.format(*"()" * 4), _A)


def unescaped(text: str) -> str:
    """Character references to characters, ``&amp;`` last; half characters are ``?``."""
    if "&" not in text:
        return text

    def char(found: re.Match) -> str:
        code = int(found[1]) if found[1] else int(found[2], 16)
        if code > 0x10FFFF:
            return found[0]
        return "?" if 0xD800 <= code < 0xE000 else chr(code)

    if "&#" in text:
        text = _REFERENCE.sub(char, text)
    for name, mark in _NAMED:
        text = text.replace(name, mark)
    return text


def opened(xml: str, tag: str) -> str:
    """Empty elements of a tag written as a pair of tags."""
    if "/>" not in xml or tag not in xml:
        return xml
    pattern, pair = _OPENED[tag]
    return pattern.sub(pair, xml)


def pieces(xml: str, tag: str) -> list[str]:
    """The text up to each end of a tag."""
    whole = opened(xml, tag)
    cut = _CLOSED[tag].split(whole) if f":{tag}>" in whole else whole.split(f"</{tag}>")
    return cut[:-1]


def run_text(xml: str) -> str:
    return unescaped("".join(_RUN.findall(xml)))


def _first(pattern: re.Pattern, text: str) -> str:
    found = pattern.search(text)
    return unescaped(found[1]) if found else ""


def _int(text: str) -> int | None:
    """What a cast to an integer gives, which cuts blanks and controls."""
    text = text.strip("".join(map(chr, range(33))) + "\x7f")
    value = int(text) if _INT.fullmatch(text) else None
    return value if value is not None and -(1 << 31) <= value < 1 << 31 else None


# ------------------------------------------------------------------ Office files
def sheet_targets(book: str, relations: str) -> list[str]:
    """The members of a workbook's sheets in order."""
    by_id: dict[str, str] = {}
    for tag in _RELATION.findall(relations):
        target = _first(_TARGET, tag)
        by_id.setdefault(_first(_ID, tag), target[4:] if target.startswith("/xl/") else target)
    sheets = _SHEET_TAG.findall(book)
    return ["xl/" + by_id.get(_first(_KEY, tag), f"worksheets/sheet{i}.xml") for i, tag in enumerate(sheets, 1)]


def _column(letters: str) -> int:
    place = 0
    for letter in letters:
        place = place * 26 + ord(letter) - 64
    return place


def _shared(strings: list[str], raw: str) -> str:
    at = _int(raw)
    return strings[at] if at is not None and 0 <= at < len(strings) else ""


def _cells(row: str, strings: list[str]) -> Iterator[tuple[int, str]]:
    """Column (0 if not given) and text of each cell."""
    for cell in pieces(row, "c"):
        tag = _CELL.search(cell)
        tag = tag[0] if tag else ""
        place, kind, value = _PLACE.search(tag), _first(_TYPE, tag), _VALUE.search(cell)
        value = value[1] if value else ""
        if kind == "inlineStr":
            shown = run_text(cell)
        else:
            shown = _shared(strings, value) if kind == "s" else unescaped(value)
        yield _column(place[1]) if place else 0, shown


def row_text(row: str, strings: list[str]) -> str:
    """Cells at their columns, parted by tabs; one without a place follows its left neighbour."""
    texts = _INLINE.findall(row)
    if texts and row.count("<", _BEFORE_CELLS.match(row).end()) == 6 * len(texts):
        # Nothing else is there. No reference spans a tab, so all cells are unescaped at once.
        return unescaped("\t".join(texts))
    if _PLAIN_ROW.fullmatch(row):
        plain = _PLAIN.findall(row)
        if 't="s"' not in row and ' r="' not in row:
            return unescaped("\t".join([text if kind == "inlineStr" else value for _, kind, text, value in plain]))
        cells = [
            (
                _column(letters) if letters else 0,
                _shared(strings, value) if kind == "s" else unescaped(text if kind == "inlineStr" else value),
            )
            for letters, kind, text, value in plain
        ]
    else:
        cells = list(_cells(row, strings))
    if not any(place for place, _ in cells):
        return "\t".join([shown for _, shown in cells])
    out, last = [], 1
    for k, (place, shown) in enumerate(cells):
        place = place if place > 0 else k + 1
        out.append("\t" * (place - last if k == 0 else max(1, place - last)))
        out.append(shown)
        last = place
    return "".join(out)


def slide_text(xml: str) -> str:
    """Texts of the shapes of a slide; rows of tables with cells parted by `` | ``."""
    for tag in _SHAPES:
        xml = opened(xml, tag)
    out, start = [], 0
    for end in _SHAPE_END.finditer(xml):
        shape, start = xml[start : end.end()], end.end()
        if ("pic>" in shape and _CLOSED["pic"].search(shape)) or ("chart" in shape and _CHART.search(shape)):
            continue
        if "tbl>" in shape and _CLOSED["tbl"].search(shape):
            rows = ([run_text(c).strip(" ") for c in pieces(r, "tc")] for r in pieces(shape, "tr"))
            out.append("\n".join(" | ".join(cells) for cells in rows if any(cells)))
        else:
            plain = "\n".join(run_text(p) for p in pieces(shape, "p"))
            ends_otherwise = plain[-1:] in ("\x85", "\u2028", "\u2029")
            out.append(_EDGES.sub("", plain).strip(" ") if ends_otherwise else plain.strip(" \t\n\v\f\r"))
    return "\n".join(filter(None, out))


def _number(member: str) -> int | None:
    found = _NUMBER.search(member)
    return _int(found[1]) if found else None


def _in_order(a: tuple, b: tuple) -> int:
    if a[0] is None or b[0] is None:
        return 0
    return (a[0] > b[0]) - (a[0] < b[0])


def office_text(box: list[tuple]) -> str | None:
    """Texts of all parts of an Office file in order, NULL for other files."""
    names = {m[0] for m in box}
    kind = next((k for k in ("word/document.xml", office.BOOK, office.DECK) if k in names), None)
    if kind is None:
        return None

    def xml(name: str) -> str:
        data = next((m[2] for m in box if m[0] == name), None)
        return (data or b"").decode("utf-8", "replace")

    def parts() -> Iterator[tuple[int | None, str]]:
        pattern = {"word/document.xml": _DOCX, office.BOOK: _SHEET, office.DECK: _SLIDE}[kind]
        targets, strings = [], []
        if kind == office.BOOK:
            targets = sheet_targets(xml(office.BOOK), xml(office.RELATIONS))
            strings = [run_text(s) for s in pieces(xml(office.SHARED), "si")]
        for member, _, data, _ in box:
            if data is None or not pattern.fullmatch(member):
                continue
            whole = data.decode("utf-8", "replace")
            if kind == office.DECK:
                yield _number(member), slide_text(whole)
            elif kind == office.BOOK:
                part = targets.index(member) + 1 if member in targets else _number(member)
                yield part, "\n".join(row_text(r, strings) for r in pieces(whole, "row"))
            else:
                yield 1, "\n\n".join(run_text(p) for p in pieces(whole, "p"))

    return "\n\n".join(text for _, text in sorted(parts(), key=cmp_to_key(_in_order)))


# ---------------------------------------------------------------------- archives
def is_searched(member: str) -> bool:
    """A text member by its name, neither unsafe nor put there by a packer."""
    if not _TEXT_MEMBER.fullmatch(member) or member.startswith("/") or ".." in member.split("/"):
        return False
    folder = _FOLDER.match(member)
    junk = member.rpartition("/")[2].startswith(tuple(fixed.ARCHIVE_JUNK_PREFIXES))
    return not junk and "__MACOSX" not in (folder[1] if folder else "").split("/")


def archive_text(box: list[tuple]) -> str:
    """Texts of the searched members with visible characters, in order."""
    texts = []
    for member, _, data, _ in box:
        if data and is_searched(member):
            text = data.decode("utf-8", "ignore").replace("\ufffd", "")
            if _VISIBLE.search(text):
                texts.append(text)
    return "\n\n".join(texts)


def opened_box(raw: bytes, wanted: str, largest: int) -> tuple[list[tuple], str]:
    """Members and text of ZIP bytes; members have bytes only where later expressions read them."""
    box, left = [], largest
    for member, size, data, error in inflate(raw, wanted, largest):
        if data is not None and len(data) > left:
            data, error = None, f"成员过大: {member}"
        left -= len(data or b"")
        box.append((member, size, data, error))
    if box and box[0][0] is None:  # a damaged archive
        return box, ""
    text = office_text(box)
    text = archive_text(box) if text is None else text
    return [(m, size, data if m in KEPT else None, error) for m, size, data, error in box], text


def _files(
    batches: Iterator[tuple[pa.Array, pa.Array]], wanted: str, largest: int
) -> Iterator[pa.Array]:
    for content, names in batches:
        out: list[tuple | None] = []
        binary: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> pa.Array:
            if binary:
                best = _best_decodings(pd.Series([raw for _, raw in binary], dtype=object))
                for (at, _), text, encoding in zip(binary, best["text"], best["encoding"]):
                    out[at] = (None, text, encoding)
            return pa.array(out, INSIDE)

        for raw, name in zip(content, names):
            raw, name = raw.as_py(), name.as_py()
            if raw is None:
                out.append(None)
            elif name == IS_ZIP:
                box, text = opened_box(raw, wanted, largest)
                out.append((box, text, None))
                held += sum(len(m[2] or b"") + ROW for m in box) + len(text)
            elif name is None:
                binary.append((len(out), raw))
                out.append(None)
                held += 2 * len(raw)
            else:
                out.append((None, decoded(raw, name), name))
                held += len(raw)
            if held >= PORTION:
                yield flush()
                out, binary, held = [], [], 0
        if out:
            yield flush()
        out, raw = [], None
        del content, names
    # Workers stay for other tasks.
    pa.default_memory_pool().release_unused()


def opened_files(content: str, name: str, wanted: str, largest: int = LARGEST) -> Column:
    """struct(box, text, encoding) of bytes: those of a ZIP if their ``name`` is ``IS_ZIP``, else of their encoding.

    ``box`` is as :func:`unzip.boxed` gives it, but a member has bytes only
    where later expressions read them (``KEPT``). Bytes without a name take the
    decoding with most printable text. Results leave in portions.
    """

    @F.arrow_udf(
        "struct<box: array<struct<member: string, size: bigint, data: binary, error: string>>, "
        "text: string, encoding: string>"
    )
    def files(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _files(batches, wanted, largest)

    # Not to be merged into lambda bodies of later expressions.
    return files.asNondeterministic()(F.expr(content), F.expr(name))
