"""Text cleaning, previews and chunking (SQL text unless noted)."""

from __future__ import annotations

import html
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glintscan.functions import fixed
from glintscan.functions.cols import WORD, case, count_of, is_in, let, lit, running_totals
from glintscan.functions.xml import character_data

TOKEN = r"[一-龥a-zA-Z0-9]+"
TOKEN_ALPHA = r"[一-龥a-zA-Z]+"
WORDS = "cast(array() AS array<string>)"


def sub(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)})"


def token_clean(text: str, digits: bool = True) -> str:
    """Lower-case runs of CJK, Latin letters (and digits) joined by one space."""
    pattern = lit(TOKEN if digits else TOKEN_ALPHA)
    return f"array_join(regexp_extract_all(lower({text}), {pattern}, 0), ' ')"


def css_clean(text: str, digits: bool = True) -> str:
    for pattern in (
        r"(?s)/\*.*?\*/",
        r"(?i)url\([^)]*\)",
        r"var\(--[^)]*\)",
        r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]",
    ):
        text = sub(text, pattern, "")
    return token_clean(text, digits)


@F.pandas_udf(StringType())
def _unescape_all(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def html_unescape(text: str) -> Column:
    """HTML character references to text (a Column).

    The five XML references are replaced natively (``&amp;`` last, as one pass
    would do). Only texts with any other reference are sent to Python.
    """
    other = f"{text} RLIKE {lit('&(?!(?:amp|lt|gt|quot|apos);)[#A-Za-z]')}"
    native = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        native = f"replace({native}, {lit(name)}, {lit(char)})"
    return F.coalesce(_unescape_all(F.expr(f"if({other}, {text}, NULL)")), F.expr(native))


def xml_clean(text: str, digits: bool = True) -> Column:
    """Character data, references to text, then token clean (a Column).

    Texts that are not well-formed lose what stands between angle brackets.
    """
    data = f"coalesce({character_data(text)}, {sub(text, r'<[^>]+>', ' ')})"
    plain = F.lower(html_unescape(data))
    pattern = F.lit(TOKEN if digits else TOKEN_ALPHA)
    return F.array_join(F.regexp_extract_all(plain, pattern, F.lit(0)), " ")


def cut(text: str, limit: int, notice: str) -> str:
    return let(text, "tx", f"if(length(tx) > {limit}, concat(left(tx, {limit}), {lit(notice)}), tx)")


def general_clean(text: str, limit: int | None = None) -> str:
    """Lower case, words only (which also drops whitespace runs), with a ``limit`` cut with ``...``."""
    out = token_clean(text, digits=False)
    return cut(out, limit, "...") if limit else out


def is_markup(file_type: str) -> str:
    return (
        f"({file_type} = 'application/zip' OR endswith({file_type}, '+xml')"
        f" OR {file_type} = 'text/xml')"
    )


def clean_dispatch(text: str, file_type: str, digits: bool = True) -> Column:
    """Markup types through the XML cleaner, others through the CSS one (a Column)."""
    failed = f"({text} IS NULL OR {text} = '' OR {is_in(text, fixed.CLEAN_ERRORS)})"
    markup = f"NOT {failed} AND {is_markup(file_type)}"
    return (
        F.when(F.expr(failed), "")
        .when(F.expr(markup), xml_clean(f"if({markup}, {text}, NULL)", digits))
        .otherwise(F.expr(css_clean(text, digits)))
    )


def words_of(text: str) -> str:
    """Words split on whitespace, none for blank text."""
    return f"regexp_extract_all({text}, {lit('(?U)' + WORD)}, 0)"


def collapse(text: str) -> str:
    """Runs of whitespace to one space, none at the ends."""
    return f"array_join({words_of(text)}, ' ')"


def preview(text: str, limit: int = 200, collapsed: bool = True) -> str:
    body = f"coalesce({collapse(text) if collapsed else text}, '')"
    return cut(body, limit, "...")


def truncate(text: str, limit: int, notice: str) -> str:
    return f"if(length({text}) > {limit}, concat(left({text}, {limit}), {lit(notice)}), {text})"


def control_share(text: str) -> str:
    """Share of control characters other than tab, newline, return."""
    n = f"regexp_count({text}, {lit(r'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')})"
    return f"if(length({text}) > 0, {n} / length({text}), 0D)"


def rewrite_phrases(text: str, rules: Sequence[tuple[str, str]]) -> str:
    """Ordered regex rewrites; replacements use ``$1`` for groups."""
    for pattern, replacement in rules:
        text = sub(text, pattern, replacement)
    return text


# ------------------------------------------------------------------ paragraphs
PLAIN_SYMBOLS = r"[^\p{L}\p{N} .,;:!?\-\"'()\[\]{}<>/\\]"
BLANK_LINES = r"\n\s*\n|\r\n\s*\r\n|\r\s*\r"


def printable_only(text: str) -> str:
    """Drop control, format, surrogate, private and unassigned characters."""
    return sub(text, r"[\p{C}\p{Zl}\p{Zp}&&[^ \t\n\r]]", "")


def paragraphs(
    text: str, separator: str = BLANK_LINES, min_length: int = 20, max_special: float = 0.3
) -> str:
    """Paragraphs long enough and not made of special characters.

    Whitespace is collapsed inside each paragraph, after the split.
    """
    parts = f"transform(split({printable_only(text)}, {lit(separator)}, -1), p -> {collapse('p')})"
    special = f"regexp_count(p, {lit(PLAIN_SYMBOLS)}) / length(p)"
    return f"filter({parts}, p -> length(p) >= {min_length} AND {special} <= {max_special}D)"


def budget_paragraphs(paras: str, budget: int = 50_000) -> str:
    """Paragraphs that fit a budget of characters.

    All of them in order if they fit, else the longest ones (earlier first on
    ties) until the next one would not fit; two characters are spent on each
    separator.
    """
    ranked = "array_sort(transform(pa, (p, i) -> struct(-length(p) AS neg, i AS ord, p AS text)))"
    used = running_totals("transform(rk, r -> cast(2 - r.neg AS int))")
    fitting = let(
        ranked,
        "rk",
        f"transform(filter(zip_with(rk, {used}, (r, u) -> struct(r.text AS t, u AS u)), "
        f"z -> z.u <= {budget}), z -> z.t)",
    )
    size = "aggregate(transform(pa, p -> length(p)), 0, (a, b) -> a + b)"
    return let(paras, "pa", f"if({size} > {budget}, {fitting}, pa)")


# ---------------------------------------------------------------------- chunks
def word_chunks(
    text: str, size: int = 512, stride: int | None = None, max_chunks: int | None = None
) -> str:
    """Overlapping word windows; ``max_chunks`` keeps only the first ones."""
    starts = f"sequence(1, size(wd), {stride or max(1, size // 2)})"
    starts = f"slice({starts}, 1, {max_chunks})" if max_chunks else starts
    chunks = f"transform({starts}, s -> array_join(slice(wd, s, {size}), ' '))"
    return let(words_of(text), "wd", f"if(size(wd) = 0, {WORDS}, {chunks})")


# ---------------------------------------------------------------- augmentation
def unit_draw(*parts: str) -> str:
    """A reproducible draw: four hex digits of an MD5 over the parts."""
    return f"left(md5(concat_ws(':', {', '.join(parts)})), 4)"


def hex_share(p: float) -> str:
    """Draws below this text happen with probability ``p``."""
    return f"'{int(p * 65536):04x}'"


def delete_words(text: str, key: str, seed: int = 42, p: float = 0.2) -> str:
    """Drop each word with probability ``p``; never empties a text."""
    draw = unit_draw(f"'{seed}'", f"cast({key} AS string)", "cast(x.i AS string)")
    stay = (
        "transform(filter(transform(wd, (w, i) -> struct(w AS w, i AS i)), "
        f"x -> {draw} >= {hex_share(p)}), x -> x.w)"
    )
    chosen = let(stay, "st", "if(size(st) = 0, get(wd, 0), array_join(st, ' '))")
    return let(words_of(text), "wd", f"if(size(wd) <= 1, {text}, {chosen})")


def replace_synonyms(text: str, synonyms: dict[str, str], buckets: int = 64) -> str:
    """Dictionary replacement word by word.

    The dictionary is a constant array of small maps chosen by CRC, so one
    lookup does not scan the whole dictionary.
    """
    if not synonyms:
        return text
    n = max(1, min(buckets, len(synonyms)))
    slots: list[list[str]] = [[] for _ in range(n)]
    for word, other in synonyms.items():
        slots[zlib.crc32(word.encode()) % n] += [lit(word), lit(other)]
    maps = ", ".join(
        f"map({', '.join(s)})" if s else "cast(map() AS map<string,string>)" for s in slots
    )
    slot = f"get(array({maps}), cast(crc32(encode(w, 'UTF-8')) % {n} AS int))"
    swap = f"coalesce(try_element_at({slot}, w), w)"
    return f"array_join(transform({words_of(text)}, w -> {swap}), ' ')"


def augmented(
    text: str, key: str, synonyms: dict[str, str], seed: int = 42, share: float = 0.3
) -> str:
    """Augment about ``share`` of the texts, half by deletion, half by synonyms."""
    pick = unit_draw(f"'{seed}'", "'row'", f"cast({key} AS string)")
    kind = unit_draw(f"'{seed}'", "'kind'", f"cast({key} AS string)")
    return case(
        [
            (f"{pick} >= {hex_share(share)}", text),
            (f"{kind} < {hex_share(0.5)}", delete_words(text, key, seed)),
        ],
        replace_synonyms(text, synonyms),
    )


# --------------------------------------------------------------- text profiles
def markdown_profile(text: str) -> str:
    """struct(headers, code_blocks, links, images)."""

    def n(pattern: str) -> str:
        return f"regexp_count({text}, {lit(pattern)})"

    return (
        f"struct({n(r'(?m)^#{1,6}\s+')} AS headers, cast({n('```')} div 2 AS int) AS code_blocks, "
        f"{n(r'\[.*?\]\(.*?\)')} AS links, {n(r'!\[.*?\]\(.*?\)')} AS images)"
    )


def sniff_delimiter(text: str, sample: int = 4096) -> str:
    """Most frequent of ``, ; tab |`` in the sample; comma below five."""
    counts = {d: count_of("hd", d) for d in fixed.CSV_DELIMITERS}
    best = f"greatest({', '.join(counts.values())})"
    picks = [(f"{best} < 5", lit(","))]
    picks += [(f"{n} = {best}", lit(d)) for d, n in counts.items()]
    return let(f"left({text}, {sample})", "hd", case(picks))
