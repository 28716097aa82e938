"""Row predicates and gates of a scan (SQL text, or DataFrame in and out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.functions import fixed
from glintscan.functions.cols import any_of, case, has_any, is_in, lit, lookup
from glintscan.functions.detect import header_hex
from glintscan.functions.paths import expected_mime

MB = 1024 * 1024


def skips_extension(ext: str, only: Sequence[str] | None = None) -> str:
    return is_in(ext, only or fixed.SKIP_EXTENSIONS)


def skips_mime(mime: str) -> str:
    prefixes = [f"startswith({mime}, {lit(p)})" for p in fixed.SKIP_MIME_PREFIXES]
    return any_of([is_in(mime, fixed.SKIP_MIMES), *prefixes])


def is_unsupported(mime: str) -> str:
    return any_of(f"startswith({mime}, {lit(p)})" for p in fixed.UNSUPPORTED_PREFIXES)


def size_gate(length: str, is_archive: str) -> str:
    """``error``, ``warn`` or ``ok`` by file size."""
    return case(
        [
            (f"{is_archive} AND {length} > {100 * MB}", "'error'"),
            (f"{length} > {200 * MB}", "'error'"),
            (f"{length} > {50 * MB}", "'warn'"),
        ],
        "'ok'",
    )


def too_large_text(length: str) -> str:
    return f"concat('文件过大 (', format_string('%.2f', {length} / {MB}D), ' MB)，跳过处理')"


def drop_failed(df: DataFrame, content: str = "content", by_substring: bool = False) -> DataFrame:
    """Keep rows with text that is not (or does not contain) an error text."""
    errors = fixed.EXTRACTION_ERRORS
    failed = has_any(content, errors) if by_substring else is_in(content, errors)
    return df.where(f"{content} IS NOT NULL AND {content} != '' AND NOT {failed}")


def keep_failed(df: DataFrame, content: str = "content") -> DataFrame:
    """Keep failed rows: their error text moves to ``extraction_status``."""
    failed = f"coalesce(startswith({content}, {lit(fixed.EXTRACTION_ERRORS[0])}), false)"
    return df.withColumns(
        {
            "extraction_status": F.expr(f"if({failed}, {content}, {lit(fixed.STATUS_OK)})"),
            content: F.expr(f"if({failed}, '', {content})"),
        }
    )


def status(error: str, is_empty: str, skipped: str) -> str:
    return case(
        [
            (f"coalesce({error}, '') != ''", lit(fixed.STATUS_FAILED)),
            (is_empty, lit(fixed.STATUS_EMPTY)),
            (skipped, lit(fixed.STATUS_SKIPPED)),
        ],
        lit(fixed.STATUS_OK),
    )


def recognition(words: str) -> str:
    return f"if(size({words}) > 0, {lit(fixed.TYPE_SENSITIVE)}, {lit(fixed.TYPE_REGULAR)})"


def mime_mismatch(ext: str, mime: str) -> str:
    """The extension promises another type than the detected one."""
    return f"(coalesce({lookup(ext, fixed.EXTENSION_MIME)}, {mime}) != {mime})"


def header_warning(ext: str, content: str) -> str:
    """Office extension whose file header is not the one of its container."""
    named, head = expected_mime(ext), header_hex(content, 4)
    message = f"concat('文件头不符合 ', {ext}, ' 格式')"
    return case(
        [
            (f"{is_in(named, [fixed.PPT, fixed.DOC])} AND {head} != 'D0CF11E0'", message),
            (f"{is_in(named, [fixed.PPTX, fixed.XLSX])} AND {head} != '504B0304'", message),
        ]
    )


def is_office_label(label: str) -> str:
    return has_any(label, fixed.OFFICE_TYPE_WORDS)


def label_matches(label: str, words: Sequence[str]) -> str:
    """Any of the words occurs in the label, case ignored."""
    return has_any(f"lower({label})", [w.strip().lower() for w in words])
