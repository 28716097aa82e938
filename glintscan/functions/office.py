"""Text and counts of Office Open XML parts (SQL text over the XML of one member)."""

from __future__ import annotations

from glintscan.functions.cols import let, lit
from glintscan.functions.text import sub

PREFIX = r"(?:\w+:)?"
PREFIX_FIXED = r"(?:\w{1,8}:)?"  # a look-behind needs a bounded length
DOCX_BODY = r"word/document\.xml"
SHEET = r"xl/worksheets/[^/]+\.xml"
SLIDE = r"ppt/slides/slide\d+\.xml"
BOOK, RELATIONS, SHARED = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
DECK = "ppt/presentation.xml"
# Members that any of the expressions below reads.
PARTS = "|".join([DOCX_BODY, SHEET, SLIDE, *(n.replace(".", r"\.") for n in (BOOK, RELATIONS, SHARED, DECK))])


def unescaped(text: str) -> str:
    """Character references of XML text to characters, ``&amp;`` last."""
    code = "if(startswith(q, 'x'), substring_index(substring(q, 2), ';', 1), hex(cast(substring_index(q, ';', 1) AS bigint)))"
    char = f"concat(decode(unhex(lpad({code}, 8, '0')), 'UTF-32'), substring(q, locate(';', q) + 1))"
    known = f"q RLIKE {lit('^([0-9]{1,7}|x[0-9A-Fa-f]{1,6});')}"
    numeric = let(
        "split(tx, '&#', -1)",
        "sp",
        f"concat(sp[0], array_join(transform(slice(sp, 2, size(sp)), q -> if({known}, {char}, concat('&#', q))), ''))",
    )
    out = f"if(contains(tx, '&#'), {numeric}, tx)"
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', {lit(mark)})"
    return let(text, "tx", out)


def opened(xml: str, tag: str) -> str:
    """Empty elements of a tag written as a pair of tags."""
    return sub(xml, rf"<({PREFIX}{tag})((?:\s[^>]*)?)/>", "<$1$2></$1>")


def pieces(xml: str, tag: str) -> str:
    """The text up to each end of a tag."""
    return let(f"split({opened(xml, tag)}, {lit(f'</{PREFIX}{tag}>')}, -1)", "pc", "slice(pc, 1, size(pc) - 1)")


def run_text(xml: str) -> str:
    """The text of all ``t`` elements, joined."""
    found = f"regexp_extract_all({xml}, {lit(f'<{PREFIX}' + r't(?:\s[^>]*)?>([^<]*)</')}, 1)"
    return unescaped(f"array_join({found}, '')")


def tags(xml: str, tag: str) -> str:
    """The start tags of a name."""
    return f"regexp_extract_all({xml}, {lit(f'<{PREFIX}{tag}' + r'(?=[\s/>])[^>]*>')}, 0)"


def attribute(tag: str, name: str) -> str:
    return unescaped(f"regexp_extract({tag}, {lit(rf'[\s:]{name}\s*=\s*' + '[\"\\\']([^\"\\\']*)')}, 1)")


def paragraphs(xml: str) -> str:
    """Text of each paragraph in order, those inside tables too."""
    return f"transform({pieces(xml, 'p')}, pp -> {run_text('pp')})"


def shared_strings(xml: str) -> str:
    """The shared strings of a workbook in order."""
    return f"transform({pieces(f'coalesce({xml}, {lit("")})', 'si')}, ss -> {run_text('ss')})"


def sheet_places(book: str, relations: str) -> str:
    """Sheets of a workbook in order: ``title`` and ``target``, the member's place below ``xl/``.

    The relation id leads to the member; without relations the n-th sheet is
    ``worksheets/sheetn.xml``.
    """
    by_id = (
        f"transform({tags(f'coalesce({relations}, {lit("")})', 'Relationship')}, "
        f"rl -> struct({attribute('rl', 'Id')} AS id, {sub(attribute('rl', 'Target'), '^/xl/', '')} AS target))"
    )
    found = f"get(filter(re, x -> x.id = {attribute('sh', 'id')}), 0).target"
    return let(
        by_id,
        "re",
        f"transform({tags(f'coalesce({book}, {lit("")})', 'sheet')}, (sh, i) -> struct("
        f"{attribute('sh', 'name')} AS title, coalesce({found}, concat('worksheets/sheet', i + 1, '.xml')) AS target))",
    )


def sheet_rows(xml: str, strings: str) -> str:
    """Rows of a sheet: ``text`` with cells at their column, tab-separated, and ``width``."""
    letters = f"regexp_extract(tag, {lit('[ ]r=\"([A-Z]{1,3})')}, 1)"
    column = f"aggregate(filter(split({letters}, ''), c -> c <> ''), 0, (a, c) -> a * 26 + ascii(c) - 64)"
    raw = f"regexp_extract(ce, {lit(f'<{PREFIX}' + r'v(?:\s[^>]*)?>([^<]*)<')}, 1)"
    value = (
        f"CASE WHEN {attribute('tag', 't')} = 'inlineStr' THEN {run_text('ce')} "
        f"WHEN {attribute('tag', 't')} = 's' THEN coalesce(get({strings}, try_cast({raw} AS int)), '') "
        f"ELSE {unescaped(raw)} END"
    )
    tag = f"regexp_extract(ce, {lit(f'<{PREFIX}' + r'c(?=[\s/>])[^>]*>')}, 0)"
    cells = f"transform({pieces('rw', 'c')}, (ce, k) -> {let(tag, 'tag', f'struct({column} AS place, {value} AS value)')})"
    # A cell without a place follows its left neighbour.
    placed = "transform(cl, (x, k) -> struct(if(x.place > 0, x.place, k + 1) AS place, x.value AS value))"
    gap = "if(k = 0, x.place - 1, greatest(1, x.place - get(pl, k - 1).place))"
    line = f"array_join(transform(pl, (x, k) -> concat(repeat('\\t', {gap}), x.value)), '')"
    width = "greatest(size(pl), coalesce(array_max(transform(pl, x -> x.place)), 0))"
    row = let(cells, "cl", let(placed, "pl", f"struct({line} AS text, {width} AS width)"))
    return f"transform({pieces(xml, 'row')}, rw -> {row})"


def slide_shapes(xml: str) -> str:
    """Top-level shapes of a slide: ``kind`` (pic, chart, table, text) and ``text``.

    Table rows become lines with cells joined by `` | ``.
    """
    ends = lit(f"(?<=</{PREFIX_FIXED}(?:sp|pic|graphicFrame|cxnSp)>)")
    cells = f"transform({pieces('tr', 'tc')}, tc -> trim({run_text('tc')}))"
    lines = (
        f"array_join(transform(filter(transform({pieces('sp', 'tr')}, tr -> {cells}), "
        "cs -> exists(cs, c -> c <> '')), cs -> array_join(cs, ' | ')), '\\n')"
    )
    kind = (
        f"CASE WHEN sp RLIKE {lit(rf'</{PREFIX}pic>')} THEN 'pic' "
        f"WHEN sp RLIKE {lit(rf'<{PREFIX}chart[\s/>]')} THEN 'chart' "
        f"WHEN sp RLIKE {lit(rf'</{PREFIX}tbl>')} THEN 'table' ELSE 'text' END"
    )
    plain = f"trim({sub(f'array_join({paragraphs("sp")}, {lit(chr(10))})', r'^\s+|\s+$', '')})"
    shape = let(kind, "kd", f"struct(kd AS kind, CASE kd WHEN 'text' THEN {plain} WHEN 'table' THEN {lines} ELSE '' END AS text)")
    whole = xml
    for tag in ("sp", "pic", "graphicFrame", "cxnSp"):
        whole = opened(whole, tag)
    split_at = f"split({whole}, {ends}, -1)"
    return let(split_at, "al", f"transform(slice(al, 1, size(al) - 1), sp -> {shape})")

