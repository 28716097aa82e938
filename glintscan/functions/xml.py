"""Character data of XML texts by their tokens (SQL text)."""

from __future__ import annotations

from glintscan.functions.cols import any_of, case, let, lit

_NAME = r"[A-Za-z_:\x{80}-\x{10FFFF}][-\w:.\x{80}-\x{10FFFF}]*+"
_SPACE = r"[ \t\r\n]"
_VALUE = r"""(?:"[^"<]*+"|'[^'<]*+')"""
_ATTRIBUTES = f"(?:{_SPACE}++{_NAME}{_SPACE}*+={_SPACE}*+{_VALUE})*+"
COMMENT = r"<!--(?s:.*?)-->"
CDATA = r"<!\[CDATA\[(?s:.*?)\]\]>"
INSTRUCTION = r"<\?(?!(?i:xml)[ \t\r\n?])(?s:.*?)\?>"
OPEN = f"<{_NAME}{_ATTRIBUTES}{_SPACE}*+/?>"
CLOSE = f"</{_NAME}{_SPACE}*+>"
# A text run, a piece of markup, or a bracket that starts none.
TOKENS = "|".join([r"[^<]++", COMMENT, CDATA, INSTRUCTION, OPEN, CLOSE, "<"])
REFERENCE = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});)"


def _is_tag(token: str) -> str:
    return f"{token} RLIKE {lit(r'^</?[^!?]')}"


def _nested(tokens: str) -> str:
    """Whether every tag of ``tokens`` is closed in its place."""
    tags = f"transform(filter({tokens}, t -> {_is_tag('t')}), t -> struct(regexp_extract(t, {lit('^</?([^ /><\t\r\n]+)')}, 1) AS n, startswith(t, '</') AS c, endswith(t, '/>') AS e))"
    step = case(
        [
            ("NOT a.ok OR x.e", "a"),
            ("NOT x.c", "struct(array_append(a.st, x.n) AS st, true AS ok)"),
            (
                "size(a.st) > 0 AND get(a.st, size(a.st) - 1) = x.n",
                "struct(slice(a.st, 1, size(a.st) - 1) AS st, true AS ok)",
            ),
        ],
        "struct(a.st AS st, false AS ok)",
    )
    return (
        f"aggregate({tags}, struct(cast(array() AS array<string>) AS st, true AS ok), (a, x) -> {step}, "
        "a -> a.ok AND size(a.st) = 0)"
    )


def character_data(text: str) -> str:
    """All character data of well-formed content, a space for each tag; NULL if it is not well-formed.

    Content is what may stand within an element: text, elements, CDATA
    sections, comments and instructions, none of them needed. Comments,
    instructions and attributes give no text, a section its own characters, and
    the five references of XML theirs; numeric references are left as they are.
    Declarations, document types, other references, tags that do not match and
    stray brackets are not well-formed. Prefixes need not be bound.
    """
    bad = any_of(
        [
            "t = '<'",
            f"NOT startswith(t, '<') AND (t RLIKE {lit(REFERENCE)} OR contains(t, ']]>'))",
        ]
    )
    plain = "t"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = f"replace({plain}, {lit(name)}, {lit(char)})"
    shown = case(
        [
            ("startswith(t, '<![CDATA[')", "substring(t, 10, length(t) - 12)"),
            ("startswith(t, '<!--') OR startswith(t, '<?')", "''"),
            ("startswith(t, '<')", "' '"),
        ],
        plain,
    )
    found = f"if(exists(tk, t -> {bad}) OR NOT {_nested('tk')}, NULL, array_join(transform(tk, t -> {shown}), ''))"
    tokens = f"regexp_extract_all({text}, {lit(TOKENS)}, 0)"
    return f"if({text} IS NULL, NULL, {let(tokens, 'tk', found)})"
