"""Delimited files: delimiter sniffing and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.functions.text import sniff_delimiter


def file_delimiters(files: DataFrame) -> DataFrame:
    """Delimiter of each delimited file from its first 4 KB."""
    head = "cast(substring(content, 1, 4096) AS string)"
    return files.selectExpr("path", f"{sniff_delimiter(head)} AS delimiter")


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, rows: int | None = None
) -> DataFrame:
    """A delimited file or folder as strings, whole unless ``rows`` is given.

    Without ``sep`` the delimiter is sniffed from the header line of the files.
    """
    if sep is None:
        lines = spark.read.text(path).limit(20)
        head = lines.agg(F.array_join(F.collect_list("value"), "\n").alias("head"))
        sep = head.selectExpr(sniff_delimiter("head")).first()[0]
    df = spark.read.options(header=True, sep=sep, escape='"', multiLine=True).csv(path)
    return df.limit(rows) if rows is not None else df


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type name, whether numeric, row count.

    All columns are tested in one aggregation: whole numbers without gaps are
    int64, other numbers float64, the rest object.
    """
    tests = [F.count(F.lit(1)).alias("__rows")]
    for i, name in enumerate(df.columns):
        col = F.col(f"`{name}`")
        known = col.isNotNull() & (col != "")
        tests += [
            F.count_if(~known).alias(f"gaps_{i}"),
            F.count_if(known & col.try_cast("bigint").isNull()).alias(f"not_int_{i}"),
            F.count_if(known & col.try_cast("double").isNull()).alias(f"not_num_{i}"),
        ]
    counted = df.agg(*tests)
    entries = []
    for i, name in enumerate(df.columns):
        kind = (
            F.when((F.col(f"not_int_{i}") == 0) & (F.col(f"gaps_{i}") == 0), "int64")
            .when(F.col(f"not_num_{i}") == 0, "float64")
            .otherwise("object")
        )
        entries.append(F.struct(F.lit(name).alias("column_name"), kind.alias("column_type")))
    return counted.select(F.explode(F.array(*entries)).alias("c"), "__rows").select(
        "c.column_name",
        "c.column_type",
        F.col("c.column_type").isin("int64", "float64").alias("is_numeric"),
        F.col("__rows").alias("rows"),
    )
