"""Keywords and rules in texts, a portion of texts at a time in a Python task.

Gives what ``functions.match.checked`` gives. Rules whose regex means the same
to Java, Python and RE2 are searched here: RE2 says at the speed of reading
which texts hold a match, and only those are searched for its places. All other
rules stay with Java's engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _parser as parser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.functions import fixed
from glintscan.functions.cols import quote
from glintscan.functions.encoding import portions
from glintscan.functions.match import NESTED, NO_WORDS, by_rule, is_blank, keyword_pattern, reachable, rule_label
from glintscan.sources.rules import RuleSet

FOUND = pa.list_(
    pa.list_(pa.struct([("kind", pa.string()), ("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
)
FOUND_TYPE = f"array<{NESTED}>"
FLAT = 64  # first characters of keywords that are tried one after another
FILTER = 2000  # length of the largest pattern that RE2 looks for first
TOGETHER = 500  # and of patterns that it looks for all at once

# Regex syntax with one meaning: characters, escaped marks, classes of those, groups, choices and counts.
_MARK = r"\\[!-/:-@\[-`{-~]"
_PLAIN = r"[^\\.^$*+?{}\[\]()|\ud800-\udfff]"
_ITEM = rf"(?:{_MARK}|[^\\\[\]^&\-~|#\ud800-\udfff])"
_TOKEN = rf"{_MARK}|{_PLAIN}|\[\^?(?:{_ITEM}(?:-{_ITEM})?)+-?\]|\(\?:|\((?!\?)|[)|]|(?:[*+?]|\{{[0-9]+(?:,[0-9]*)?\}})\??(?![*+?{{])"
_COMMON = re.compile(f"(?:{_TOKEN})+")


def _counts_characters(parsed) -> bool:
    """No repeat of what may be empty, where engines differ."""
    for _, args in parsed:
        for arg in args if isinstance(args, tuple) else (args,):
            if isinstance(arg, parser.SubPattern):
                if isinstance(args[0], int) and len(args) == 3 and arg.getwidth()[0] == 0:
                    return False
                if not _counts_characters(arg):
                    return False
            elif isinstance(arg, list) and not all(_counts_characters(x) for x in arg if isinstance(x, parser.SubPattern)):
                return False
    return True


def is_common(pattern: str) -> bool:
    """Whether Java, Python and RE2 find the same matches of a rule."""
    if not _COMMON.fullmatch(pattern):
        return False
    parsed = parser.parse(pattern)
    return parsed.getwidth()[0] > 0 and _counts_characters(parsed)


def keyword_regex(keywords: list[str], order: str = "config") -> str | None:
    """As :func:`match.keyword_pattern`; few first characters stand side by side, so that others are skipped at once."""
    whole = keyword_pattern(keywords, order)
    words = [w for w in dict.fromkeys(keywords) if w]
    by_first: dict[str, list[str]] = {}
    for word in reachable(words) if order == "config" else words:
        by_first.setdefault(word[0], []).append(word[1:])
    if whole is None or len(by_first) > FLAT:
        return whole

    def rest(ends: list[str]) -> str:
        more = keyword_pattern(ends, "longest")
        return "" if more is None else f"(?:{more})" + ("?" if "" in ends else "")

    return "|".join(quote(first) + rest(ends) for first, ends in sorted(by_first.items()))


def _with_match(texts: pa.Array, pattern: str) -> list[bool]:
    """Which texts may hold a match; all, if RE2 does not take the pattern."""
    if len(pattern) > FILTER or "(?=" in pattern:
        return [True] * len(texts)
    try:
        return pc.match_substring_regex(texts, pattern).to_pylist()
    except (pa.ArrowInvalid, UnicodeEncodeError):
        return [True] * len(texts)


def _keywords(pattern: str, cap: int | None) -> Callable[[str], list[tuple]]:
    regex = re.compile(pattern)

    def found(text: str) -> list[tuple]:
        places: dict[str, list[int]] = {}
        for hit in regex.finditer(text):
            places.setdefault(hit[0], []).append(hit.start())
        return [("keyword", term, at[:cap]) for term, at in places.items()]

    return found


def _rule(kind: str, pattern: str, label: str, cap: int | None) -> Callable[[str], list[tuple]]:
    regex = re.compile(pattern)

    def found(text: str) -> list[tuple]:
        at = [hit.start() for hit in regex.finditer(text)]
        return [(kind, label, at[:cap])] if at else []

    return found


def _may_match(texts: pa.Array, patterns: list[str]) -> list[list[bool]]:
    """For each pattern which texts may hold a match; short ones are first looked for all together."""
    together = "|".join(f"(?:{p})" for p in patterns)
    if len(patterns) < 2 or len(together) > TOGETHER:
        return [_with_match(texts, p) for p in patterns]
    some = _with_match(texts, together)
    those = texts.filter(pa.array(some, pa.bool_()))
    found = [iter(_with_match(those, p)) for p in patterns]
    return [[test and next(mine) for test in some] for mine in found]


def _found(texts: pa.Array, finders: list[tuple[int, str, str, Callable]], runs: int) -> list[list[list[tuple]]]:
    """For each text the results of each run of parts; blank texts have none."""
    texts = texts.fill_null("")
    # Keywords, which come first if there are any, are in more texts than rules.
    patterns = [pattern for _, _, pattern, _ in finders]
    n = sum(kind == "keyword" for _, kind, _, _ in finders)
    held = [_with_match(texts, p) for p in patterns[:n]] + _may_match(texts, patterns[n:])
    rows: list[list[list[tuple]]] = []
    for value, *tests in zip(texts, *held):
        rows.append([[] for _ in range(runs)])
        if any(tests):
            text = value.as_py()
            if text.strip():
                for (run, _, _, finder), test in zip(finders, tests):
                    if test:
                        rows[-1][run] += finder(text)
    return rows


def with_checked(
    df: DataFrame,
    text: str,
    out: str,
    rules: RuleSet,
    order: str = "config",
    cap: int | None = None,
    labelled: bool = False,
    kinds: tuple[str, ...] = ("keyword", "structured", "number"),
) -> DataFrame:
    """Add what :func:`match.checked` gives for a column of valid UTF-8 texts."""
    cap = cap or None
    # Runs of parts that are searched here, each a list of a text; the others are SQL texts between them.
    parts: list[str] = []
    finders: list[tuple[int, str, str, Callable]] = []
    runs = 0

    def here(kind: str, pattern: str, finder: Callable) -> None:
        nonlocal runs
        if not parts or not parts[-1].startswith("get("):
            parts.append(f"get(__found, {runs})")
            runs += 1
        finders.append((runs - 1, kind, pattern, finder))

    pattern = keyword_regex(rules.keywords, order)
    if "keyword" in kinds and pattern:
        here("keyword", pattern, _keywords(pattern, cap))
    for kind, patterns, prefix in (
        ("structured", list(rules.structured), fixed.LABEL_STRUCTURED),
        ("number", rules.numbers, fixed.LABEL_NUMBER),
    ):
        for p in patterns if kind in kinds else ():
            label = rule_label(prefix, p) if labelled else p
            if is_common(p):
                here(kind, p, _rule(kind, p, label, cap))
            else:
                parts.append(by_rule(text, kind, p, label, cap))
    if not parts:
        return df.withColumn(out, F.expr(NO_WORDS))

    @F.arrow_udf(FOUND_TYPE)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start, n in portions(batch):
                yield pa.array(_found(batch.slice(start, n), finders, runs), FOUND)
            del batch
        # Workers stay for other tasks.
        pa.default_memory_pool().release_unused()

    whole = f"cast(concat({', '.join(parts)}) AS {NESTED})"
    if not finders:
        return df.withColumn(out, F.expr(f"if({is_blank(text)}, {NO_WORDS}, {whole})"))
    # The text is used beside the step, too, so that the optimizer does not make its expression the step's argument.
    none = is_blank(text) if len(parts) > 1 else f"{text} IS NULL"
    whole = f"if({none}, {NO_WORDS}, {whole})"
    # Not to be merged into lambda bodies of later expressions.
    got = df.withColumn("__found", found.asNondeterministic()(F.col(text)))
    return got.withColumn(out, F.expr(whole)).drop("__found")
