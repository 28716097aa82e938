"""Match positions as native expressions (SQL text).

One regex pass marks every match in the text with two characters the text
does not contain; cutting at the marks gives the matched terms, and the
running sum of piece lengths gives their 0-based code-point positions.
"""

from __future__ import annotations

from glintscan.functions import fixed
from glintscan.functions.cols import case, let, lit, quote, running_totals
from glintscan.sources.rules import RuleSet, java_pattern

SPAN = "array<struct<term:string,pos:int>>"
NESTED = "array<struct<kind:string,term:string,positions:array<int>>>"

# Candidate marker pairs; the first pair absent from a text is used for it.
MARKS = [("\u0001", "\u0002"), ("\ufdd0", "\ufdd1"), ("\ue000", "\ue001"), ("\ue002", "\ue003")]
NO_SPANS = f"cast(array() AS {SPAN})"
NO_WORDS = f"cast(array() AS {NESTED})"


# ------------------------------------------------------------------ patterns
def reachable(keywords: list[str]) -> list[str]:
    """Distinct keywords no earlier keyword is a prefix of."""
    kept: dict[str, None] = {}
    for word in keywords:
        if word and not any(word[:n] in kept for n in range(1, len(word) + 1)):
            kept[word] = None
    return list(kept)


def in_class(char: str) -> str:
    """A character inside a regex class."""
    return "\\" + char if not char.isalnum() and ord(char) < 128 else char


def trie_pattern(keywords: list[str]) -> str:
    """A prefix-sharing regex that prefers the longer branch everywhere."""
    root: dict = {}
    for word in keywords:
        node = root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def choice(node: dict, chars: list[str]) -> str:
        # Many branches: halve them behind range tests, so a position costs
        # about log2(n) tests and not one per branch.
        if len(chars) <= 4:
            return "|".join(quote(c) + render(node[c]) for c in chars)
        middle = len(chars) // 2
        return "|".join(
            f"(?=[{in_class(half[0])}-{in_class(half[-1])}])(?:{choice(node, half)})"
            for half in (chars[:middle], chars[middle:])
        )

    def render(node: dict) -> str:
        tail = ""
        chars = sorted(c for c in node if c)
        while len(chars) == 1 and "" not in node:
            tail += quote(chars[0])
            node = node[chars[0]]
            chars = sorted(c for c in node if c)
        if not chars:
            return tail
        return f"{tail}(?:{choice(node, chars)})" + ("?" if "" in node else "")

    return render(root)


def keyword_pattern(keywords: list[str], order: str = "config") -> str | None:
    """One pattern for all keywords.

    ``config``: the earlier keyword wins. ``longest``: the longer one wins.
    """
    if order not in ("config", "longest"):
        raise ValueError(f"unknown keyword order: {order}")
    words = [w for w in dict.fromkeys(keywords) if w]
    if order == "config":
        words = reachable(words)
    return trie_pattern(words) if words else None


# ---------------------------------------------------------------- span arrays
def _marked(text: str, pattern: str, group: int, otherwise: str) -> str:
    """Spans of ``text`` by marking matches with a pair of absent characters.

    Group 0 consumes the match. Group 1 of a zero-width pattern is a copy that
    takes up no text.
    """
    pick = case(
        (
            f"NOT contains({text}, {lit(o)}) AND NOT contains({text}, {lit(c)})",
            f"struct({lit(o)} AS o, {lit(c)} AS c)",
        )
        for o, c in MARKS
    )
    cut = (
        f"split(regexp_replace({text}, {lit(pattern)}, concat(mk.o, '${group}', mk.c)), mk.o, -1)"
    )
    used = "1" if group == 0 else "length(substring_index(p, mk.c, 1)) + 1"
    starts = running_totals(f"transform(ps, (p, i) -> length(p) - if(i > 0, {used}, 0))")
    found = (
        "zip_with(slice(ps, 2, size(ps) - 1), "
        f"slice({starts}, 1, size(ps) - 1), "
        "(p, s) -> struct(substring_index(p, mk.c, 1) AS term, s AS pos))"
    )
    by_mark = let(cut, "ps", f"if(size(ps) < 2, {NO_SPANS}, {found})")
    return f"coalesce({let(pick, 'mk', f'if(mk IS NULL, {otherwise}, {by_mark})')}, {NO_SPANS})"


def spans(text: str, pattern: str) -> str:
    """All leftmost non-overlapping matches as ``array<struct<term,pos>>``."""
    # Texts holding every marker character: two regex passes instead of one.
    lengths = (
        f"zip_with(slice(split({text}, {lit(pattern)}, -1), 1, size(tk)), "
        "concat(array(''), slice(tk, 1, size(tk) - 1)), (g, t) -> length(g) + length(t))"
    )
    two_pass = let(
        f"regexp_extract_all({text}, {lit('(' + pattern + ')')}, 1)",
        "tk",
        f"if(size(tk) = 0, {NO_SPANS}, "
        f"zip_with(tk, {running_totals(lengths)}, (t, s) -> struct(t AS term, s AS pos)))",
    )
    return _marked(text, pattern, 0, two_pass)


def overlapping_spans(text: str, keywords: list[str]) -> str:
    """Longest keyword starting at each position, overlaps included.

    A zero-width lookahead copies the keyword into the mark without consuming
    text, so every start position is seen in one pass.
    """
    words = [w for w in sorted(dict.fromkeys(keywords), key=len, reverse=True) if w]
    # All marker characters present: test the keywords position by position.
    at = case(
        (f"substring({text}, i + 1, {len(w)}) = {lit(w)}", lit(w)) for w in words
    )
    scanned = (
        f"filter(transform(sequence(0, length({text}) - 1), "
        f"i -> struct({at} AS term, i AS pos)), s -> s.term IS NOT NULL)"
    )
    return _marked(text, f"(?=({keyword_pattern(keywords, 'longest')}))", 1, scanned)


# --------------------------------------------------------------- nested views
def _capped(positions: str, cap: int | None) -> str:
    return f"slice({positions}, 1, {cap})" if cap else positions


def by_term(found: str, kind: str, cap: int | None) -> str:
    """Group spans by term, terms in order of first occurrence."""
    mine = "transform(filter(sp, y -> y.term = t), y -> y.pos)"
    return let(
        found,
        "sp",
        "transform(array_distinct(transform(sp, y -> y.term)), "
        f"t -> struct({lit(kind)} AS kind, t AS term, {_capped(mine, cap)} AS positions))",
    )


def rule_label(prefix: str, pattern: str, width: int = 30) -> str:
    shown = pattern if len(pattern) <= width else pattern[:width] + "..."
    return f"{prefix}[{shown}]"


def by_rule(text: str, kind: str, pattern: str, label: str, cap: int | None) -> str:
    """Positions of one regex rule as a nested array of zero or one entries."""
    mine = _capped("transform(sp, y -> y.pos)", cap)
    entry = f"array(struct({lit(kind)} AS kind, {lit(label)} AS term, {mine} AS positions))"
    return let(
        spans(text, java_pattern(pattern)), "sp", f"if(size(sp) > 0, {entry}, {NO_WORDS})"
    )


def is_blank(text: str) -> str:
    visible = lit(r"(?U)[^\s\x1c-\x1f]")
    return f"({text} IS NULL OR NOT {text} RLIKE {visible})"


def checked(
    text: str,
    rules: RuleSet,
    order: str = "config",
    cap: int | None = None,
    labelled: bool = False,
    kinds: tuple[str, ...] = ("keyword", "structured", "number"),
) -> str:
    """Keyword, structured and number results of one text, in that order.

    ``order='longest', cap=10, labelled=True`` is the refined form.
    """
    parts: list[str] = []
    pattern = keyword_pattern(rules.keywords, order)
    if "keyword" in kinds and pattern:
        parts.append(by_term(spans(text, pattern), "keyword", cap))
    for kind, patterns, prefix in (
        ("structured", list(rules.structured), fixed.LABEL_STRUCTURED),
        ("number", rules.numbers, fixed.LABEL_NUMBER),
    ):
        if kind in kinds:
            for p in patterns:
                label = rule_label(prefix, p) if labelled else p
                parts.append(by_rule(text, kind, p, label, cap))
    if not parts:
        return NO_WORDS
    return f"if({is_blank(text)}, {NO_WORDS}, cast(concat({', '.join(parts)}) AS {NESTED}))"
