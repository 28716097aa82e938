"""Parquet tables, spread over the cluster where the files do not do it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glintscan.functions.cols import lit


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of ``folder`` with only the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan by a unique key if it has fewer splits than cores.

    Large tables have more splits than cores and are left alone: their text is
    never shuffled just to be matched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def texts(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """A spread text table for per-row work."""
    return spread(table(spark, folder, name, key, *columns), key)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table as SQL values, planned without a Python worker."""

    def value(v) -> str:
        if v is None:
            return "NULL"
        return lit(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)

    columns = [c.strip().split(" ") for c in schema.split(",")]
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns)
    names = ", ".join(n for n, _ in columns)
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in columns)
        return spark.sql(f"SELECT {nulls} WHERE false")
    body = ", ".join("(" + ", ".join(value(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
