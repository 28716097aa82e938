"""Report sinks: partitioned files written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.operators import report


def write_json_report(results: DataFrame, folder: str) -> None:
    """``results`` (one JSON document per line) and a one-row ``summary``."""
    report.json_rows(results).select("json").write.mode("overwrite").text(f"{folder}/results")
    summary = report.run_summary(results).withColumn(
        "exported_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    )
    summary.write.mode("overwrite").json(f"{folder}/summary")


def write_csv(df: DataFrame, folder: str, sep: str = ",", bom: bool = False) -> None:
    """CSV or TSV part files, quotes doubled inside quotes. ``bom`` starts the header with a byte-order mark,
    for a table small enough to open as one file elsewhere."""
    out = df
    if bom:
        first = df.columns[0]
        out = df.withColumnRenamed(first, "﻿" + first)
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(folder)


def write_report(results: DataFrame, folder: str, with_content: bool = True) -> None:
    """The four report parts as Parquet: results, detail, summary, content.

    The scan runs once, into ``base``; the parts are read from there.
    """
    results.write.mode("overwrite").parquet(f"{folder}/base")
    results = results.sparkSession.read.parquet(f"{folder}/base")
    parts = {
        "results": report.report_results(results),
        "detail": report.sensitive_detail(results),
        "summary": report.run_summary(results),
    }
    if with_content:
        parts["content"] = report.content_rows(results)
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_free_keys(df: DataFrame, folder: str) -> None:
    """CSV with the important columns first, the others after them."""
    important = ["file_path", "type", "size", "signature", "error"]
    ordered = [c for c in important if c in df.columns]
    ordered += [c for c in df.columns if c not in important]
    write_csv(df.select(*ordered), folder)


def export_sheet(df: DataFrame, folder: str, form: str = "csv") -> None:
    """One sheet as csv, json or tab-separated text."""
    if form == "csv":
        write_csv(df, folder)
    elif form == "txt":
        write_csv(df, folder, sep="\t")
    elif form == "json":
        df.write.mode("overwrite").json(folder)
    else:
        raise ValueError(f"unknown sheet format: {form}")
