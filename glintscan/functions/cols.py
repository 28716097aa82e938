"""Building blocks for Spark SQL expression text.

Expressions of this package are SQL text that ``F.expr`` parses in one JVM
call; the same expression built from Column calls costs a call per node.
Arguments named ``text``, ``content``, ``path`` and the like are expressions
too, in the simplest case a column name.
"""

from __future__ import annotations

from collections.abc import Iterable

# A run without whitespace, for the Java regex engine with (?U): together these
# classes are Python's str.isspace() set.
WORD = r"[^\s\x1c-\x1f]+"


def lit(value: str) -> str:
    """A SQL string literal."""
    out = []
    for char in value:
        if char in "\\'":
            out.append("\\" + char)
        elif ord(char) < 32 or 0x7F <= ord(char) < 0xA0 or 0xD800 <= ord(char) < 0xF900 or 0xFDD0 <= ord(char) < 0xFDF0:
            out.append(f"\\u{ord(char):04x}")
        else:
            out.append(char)
    return "'" + "".join(out) + "'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def any_of(tests: Iterable[str]) -> str:
    joined = " OR ".join(f"({t})" for t in tests)
    return f"({joined})" if joined else "false"


def total(parts: Iterable[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def case(pairs: Iterable[tuple[str, str]], default: str = "NULL") -> str:
    """Ordered CASE: the first true test decides."""
    arms = " ".join(f"WHEN {test} THEN {value}" for test, value in pairs)
    return f"(CASE {arms} ELSE {default} END)" if arms else default


def is_in(value: str, items: Iterable[str]) -> str:
    return f"({value} IN ({', '.join(lit(i) for i in items)}))"


def lookup(key: str, table: dict[str, str]) -> str:
    """Constant map lookup, NULL when the key is missing."""
    pairs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"


def has_any(text: str, needles: Iterable[str]) -> str:
    return any_of(f"contains({text}, {lit(n)})" for n in needles)


def quote(text: str) -> str:
    """Escape ``text`` for use as a literal inside a Java regex."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def count_of(text: str, needle: str) -> str:
    """Non-overlapping occurrences of a literal."""
    removed = f"length(replace({text}, {lit(needle)}, ''))"
    return f"cast((length({text}) - {removed}) div {len(needle)} AS int)"


def _fold(arr: str, acc: str, x: str) -> str:
    """Inclusive running sums of an int array, growing one result array."""
    return (
        f"aggregate({arr}, struct(0 AS s, cast(array() AS array<int>) AS o), "
        f"({acc}, {x}) -> struct({acc}.s + {x} AS s, concat({acc}.o, array({acc}.s + {x})) AS o)).o"
    )


def running_totals(values: str, block: int = 128) -> str:
    """Inclusive running sums of an int array.

    Done in two levels (inside blocks, then over block totals) so the cost of
    growing result arrays stays near n * block instead of n squared.
    """
    parts = (
        f"transform(sequence(1, size(rt), {block}), "
        f"b -> {_fold(f'slice(rt, b, {block})', 'a1', 'x1')})"
    )
    ends = _fold("transform(bl, q -> element_at(q, -1))", "a2", "x2")
    stitched = let(
        ends,
        "es",
        "flatten(transform(bl, (q, j) -> transform(q, v -> v + if(j > 0, get(es, j - 1), 0))))",
    )
    return let(
        values,
        "rt",
        f"CASE WHEN size(rt) = 0 THEN cast(array() AS array<int>) "
        f"WHEN size(rt) <= {block} THEN {_fold('rt', 'a0', 'x0')} "
        f"ELSE {let(parts, 'bl', stitched)} END",
    )
