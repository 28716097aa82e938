"""Text of OpenDocument content (SQL text over ``content.xml``)."""

from __future__ import annotations

from glintscan.functions.cols import let, lit
from glintscan.functions.office import unescaped
from glintscan.functions.text import sub

BODY = r"content\.xml"


def _spaced(xml: str) -> str:
    """Space, tab and line break elements as characters; line ends of the file as blanks."""
    flat = sub(xml, r"[\t\r\n]+", " ")
    runs = f"split({sub(flat, '<text:s/>', '<text:s text:c=\"1\"/>')}, {lit('<text:s text:c=\"')}, -1)"
    many = "concat(repeat(' ', coalesce(try_cast(substring_index(q, '\"', 1) AS int), 1)), substring(q, locate('/>', q) + 2))"
    whole = let(runs, "sr", f"concat(sr[0], array_join(transform(slice(sr, 2, size(sr)), q -> {many}), ''))")
    return f"replace(replace({whole}, '<text:tab/>', '\\t'), '<text:line-break/>', '\\n')"


def _plain(xml: str) -> str:
    """Text without tags; what a note, an annotation or a tracked deletion holds stays."""
    return unescaped(sub(xml, "<[^>]*>", ""))


def _paragraphs(xml: str) -> str:
    """Text of each paragraph and heading in order."""
    # An empty paragraph is one tag, which has no text.
    own = f"regexp_extract_all({xml}, {lit('(?s)<text:(?:p|h)(?:[ ][^>]*)?(?<!/)>(.*?)</text:(?:p|h)>')}, 1)"
    return f"transform({own}, pp -> {_plain('pp')})"


def document_text(xml: str) -> str:
    """Paragraphs of a text document or a presentation, parted by an empty line."""
    return let(_spaced(xml), "ox", f"array_join({_paragraphs('ox')}, '\\n\\n')")


def _repeated(tag: str, name: str) -> str:
    found = f"regexp_extract({tag}, {lit(f'^[^>]*table:number-{name}-repeated=\"([0-9]+)\"')}, 1)"
    return f"coalesce(try_cast({found} AS int), 1)"


def sheet_text(xml: str) -> str:
    """Rows of all sheets as lines, cells parted by tabs.

    Repeated cells and rows with text are written out; empty ones at the end of
    a row or sheet, which fill it up, are not.
    """
    cell_tag = "<table:(?:covered-)?table-cell(?=[ />])"
    cells = f"slice(split(rw, {lit(cell_tag)}, -1), 2, 100000)"
    value = f"array_join({_paragraphs('ce')}, '\\n')"
    cell = f"transform({cells}, ce -> {let(value, 'cv', f'''struct(cv AS v, {_repeated('ce', 'columns')} AS n)''')})"
    # Places of a run of empty cells before the next filled one are tabs.
    line = (
        "aggregate(cl, struct('' AS done, '' AS gap, true AS first), (a, x) -> if(x.v = '', "
        "struct(a.done AS done, if(x.n > 16384, a.gap, concat(a.gap, repeat('\\t', x.n))) AS gap, a.first AS first), "
        "struct(concat(a.done, if(a.first, a.gap, concat('\\t', a.gap)), array_join(array_repeat(x.v, x.n), '\\t')) AS done, "
        "'' AS gap, false AS first)), a -> a.done)"
    )
    rows = f"slice(split(sx, {lit('<table:table-row(?=[ />])')}, -1), 2, 100000000)"
    made = f"transform({rows}, rw -> {let(cell, 'cl', f'''struct({line} AS v, {_repeated('rw', 'rows')} AS n)''')})"
    lines = f"transform(filter({made}, r -> r.v <> ''), r -> array_join(array_repeat(r.v, r.n), '\\n'))"
    return let(_spaced(xml), "sx", f"array_join({lines}, '\\n')")
