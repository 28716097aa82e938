"""Reports over scan results.

A results table has one row per file: ``file_path, mime_type, content,
words, error, processing_time`` (and ``is_empty, skipped`` where known), with
``words`` the nested array of :mod:`glintscan.functions.match`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glintscan.functions import fixed
from glintscan.functions.cols import lit
from glintscan.functions.paths import base_name
from glintscan.functions.text import preview, truncate
from glintscan.operators.filters import recognition, status
from glintscan.operators.ordered import with_row_number


def _failed() -> Column:
    return F.col("error").isNotNull() & (F.col("error") != "")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def terms_text(words: str, unit: str = "次") -> str:
    """``term(n次); ...`` in order of first occurrence (SQL text)."""
    one = f"concat(w.term, '(', cast(size(w.positions) AS string), {lit(unit + ')')})"
    return f"array_join(transform({words}, w -> {one}), '; ')"


NAME = base_name("file_path")
SECONDS = "round(processing_time, 3) AS processing_time"
ERROR = "coalesce(error, '') AS error"
FLAG = "if(size(words) > 0, '是', '否') AS is_sensitive"


def run_summary(results: DataFrame) -> DataFrame:
    """One row: totals, sensitive share, errors, times."""
    out = results.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.size("words") > 0).alias("sensitive_files"),
        F.count_if(_failed()).alias("error_files"),
        F.coalesce(F.sum("processing_time"), F.lit(0.0)).alias("total_time"),
    )
    n = F.col("total_files")
    return out.select(
        "total_files",
        "sensitive_files",
        _share(F.col("sensitive_files"), n).alias("sensitive_percent"),
        "error_files",
        F.round("total_time", 2).alias("total_time"),
        F.when(n > 0, F.round(F.col("total_time") / n, 4)).otherwise(F.lit(0.0)).alias("avg_time"),
    )


def top_mimes(results: DataFrame, n: int = 10) -> DataFrame:
    counts = results.groupBy("mime_type").agg(F.count(F.lit(1)).alias("files"))
    return counts.orderBy(F.desc("files"), "mime_type").limit(n)


def term_totals(results: DataFrame) -> DataFrame:
    """Positions kept per term over all files.

    Each file contributes one count per term, so the shuffle carries counts.
    """
    return (
        results.select(F.explode_outer("words").alias("w"))
        .where("w IS NOT NULL")
        .groupBy(F.col("w.term").alias("term"))
        .agg(F.sum(F.size("w.positions")).alias("hits"))
    )


def top_terms(results: DataFrame, n: int = 10) -> DataFrame:
    return term_totals(results).orderBy(F.desc("hits"), "term").limit(n)


def type_report(detected: DataFrame, label: str = "type", size: str = "size") -> DataFrame:
    """Count, share, bytes and mean bytes per type.

    The whole is summed over the counted types, one narrow row each.
    """
    whole = F.sum("files").over(W.partitionBy())
    counted = detected.groupBy(F.col(label).alias("type")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes")
    )
    return counted.select(
        "type",
        "files",
        _share(F.col("files"), whole).alias("percent"),
        "bytes",
        F.round(F.col("bytes") / F.col("files"), 2).alias("mean_bytes"),
    )


def detect_counts(detected: DataFrame, label: str = "type") -> DataFrame:
    """Recognised, unknown and failed files."""
    failed = F.col("error").isNotNull()
    unknown = F.col(label).startswith(fixed.UNKNOWN_PREFIX)
    counts = detected.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(unknown).alias("unknown"),
        F.count_if(failed).alias("errors"),
    )
    return counts.select(
        "total", (F.col("total") - F.col("errors") - F.col("unknown")).alias("recognised"), "unknown", "errors"
    )


def table_stats(files: DataFrame) -> DataFrame:
    """Rows, sensitive rows, rows with an error message."""
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_sensitive") == 1).alias("sensitive"),
        F.count_if(F.col("error_message") != "").alias("with_error"),
    )


def sensitive_detail(results: DataFrame) -> DataFrame:
    """One row per file and term."""
    return results.select("file_path", F.posexplode_outer("words").alias("ord", "w")).where(
        "w IS NOT NULL"
    ).selectExpr(
        f"{NAME} AS file_name",
        "file_path",
        "ord",
        "w.term AS term",
        "size(w.positions) AS n",
        "concat('[', array_join(w.positions, ', '), ']') AS positions",
    )


def result_projection(results: DataFrame, preview_chars: int = 500) -> DataFrame:
    """Flat result rows: name, type, preview, flags, counts."""
    return results.selectExpr(
        "file_path",
        f"{NAME} AS file_name",
        "mime_type",
        f"{preview('content', preview_chars)} AS content_preview",
        "size(words) AS n_terms",
        "size(words) > 0 AS has_sensitive_content",
        "error",
        SECONDS,
    )


def report_results(results: DataFrame, none_text: str = "无", preview_chars: int = 500) -> DataFrame:
    """Main report rows with the terms text."""
    return results.selectExpr(
        "file_path",
        f"{NAME} AS file_name",
        "mime_type",
        FLAG,
        f"if(size(words) > 0, {terms_text('words')}, {lit(none_text)}) AS terms",
        SECONDS,
        ERROR,
        f"{preview('content', preview_chars)} AS preview",
    )


def csv_rows(results: DataFrame) -> DataFrame:
    """CSV report rows: terms without counts."""
    return results.selectExpr(
        "file_path",
        f"{NAME} AS file_name",
        "mime_type",
        FLAG,
        "array_join(transform(words, w -> w.term), '; ') AS terms",
        SECONDS,
        ERROR,
    )


def content_rows(results: DataFrame, limit: int = 10_000) -> DataFrame:
    """Text part of the report, cut with a notice."""
    body = truncate("content", limit, fixed.NOTICE_REPORT_CUT)
    return results.selectExpr("file_path", "mime_type", f"coalesce({body}, '') AS content")


def json_rows(results: DataFrame, preview_chars: int = 500) -> DataFrame:
    """One JSON document per result."""
    words = (
        "transform(words, w -> struct(w.term AS word, w.positions AS positions, "
        "size(w.positions) AS count))"
    )
    body = (
        f"struct(file_path, {NAME} AS file_name, mime_type, "
        f"{preview('content', preview_chars)} AS content_preview, {words} AS sensitive_words, "
        "size(words) > 0 AS has_sensitive_content, error, processing_time)"
    )
    return results.selectExpr(
        "file_path", f"to_json({body}, map('ignoreNullFields', 'false')) AS json"
    )


def checker_stats(results: DataFrame, n_keywords: int) -> DataFrame:
    """Checks, checks with hits, ratio, keyword count."""
    out = results.agg(
        F.count(F.lit(1)).alias("check_count"), F.count_if(F.size("words") > 0).alias("hit_count")
    )
    return out.select(
        "check_count",
        "hit_count",
        _share(F.col("hit_count"), F.col("check_count")).alias("hit_percent"),
        F.lit(n_keywords).cast("bigint").alias("keywords_count"),
    )


def run_log(results: DataFrame, order: list[str]) -> DataFrame:
    """Numbered log rows in completion order (eight-column form)."""
    rows = results.selectExpr(
        *order,
        f"{NAME} AS file_name",
        "file_path",
        f"{recognition('words')} AS recognition",
        f"{terms_text('words')} AS terms",
        SECONDS,
        ERROR,
    )
    return with_row_number(rows, order, "seq")


def run_log_wide(results: DataFrame) -> DataFrame:
    """Ten-column log rows with size, emptiness and status."""
    return results.selectExpr(
        "file_path",
        "mime_type",
        "file_size",
        "if(is_empty, 'Yes', 'No') AS is_empty",
        "size(words) AS n_terms",
        f"{terms_text('words', '处')} AS terms",
        SECONDS,
        f"{status('error', 'is_empty', 'skipped')} AS status",
        ERROR,
    )


def progress(running: DataFrame, done: str, seconds: str, total: Column) -> DataFrame:
    """Percent done, mean seconds per file and seconds left, per running row."""
    mean = F.when(F.col(done) > 0, F.col(seconds) / F.col(done)).otherwise(F.lit(0.0))
    return running.withColumns(
        {
            "percent_done": F.round(F.col(done) * 100.0 / total, 4),
            "mean_seconds": F.round(mean, 4),
            "seconds_left": F.round(mean * (total - F.col(done)), 2),
        }
    )
