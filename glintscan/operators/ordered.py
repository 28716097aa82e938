"""Global order without a single-task sort: row numbers and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glintscan.session import checkpointed


def ordered_slices(df: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """Range-partition by the order and name each row's slice in ``__slice``.

    The result is checkpointed: the slice bounds come from sampling, and every
    later use must see the same ones, also after an executor is lost. The order
    must be a unique key, so that equal values of its first part can be split.
    """
    spark = df.sparkSession
    n = slices or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    ranged = df.repartitionByRange(n, *order).withColumn("__slice", F.spark_partition_id())
    return checkpointed(ranged)


def running(
    df: DataFrame,
    order: list[str],
    measures: dict[str, str],
    grouped: dict[str, tuple[str, str]] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Running sums in global order.

    ``measures`` maps a new column to the SQL expression summed over all
    earlier rows and the row itself; ``grouped`` maps a new column to (key
    column, expression) summed within the key. Totals of whole slices are few;
    each row adds the totals of earlier slices to its sum inside its own slice.
    """
    plans = {name: (None, expr) for name, expr in measures.items()}
    plans.update(grouped or {})
    values = df.selectExpr("*", *[f"{e} AS __v_{name}" for name, (_, e) in plans.items()])
    out = sliced = ordered_slices(values, order, slices)
    for key in dict.fromkeys(k for k, _ in plans.values()):
        names = [n for n, (k, _) in plans.items() if k == key]
        keys = [key] if key else []
        totals = sliced.groupBy("__slice", *keys).agg(
            *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names]
        )
        before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
        bases = totals.select(
            "__slice",
            *keys,
            *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in names],
        )
        if not keys:
            bases = F.broadcast(bases)  # one row per slice
        out = out.join(bases, ["__slice", *keys])
    sums = []
    for name, (key, _) in plans.items():
        keys = [key] if key else []
        inside = (
            W.partitionBy("__slice", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        )
        sums.append((F.sum(f"__v_{name}").over(inside) + F.col(f"__b_{name}")).alias(name))
    return out.select(*df.columns, *sums)


def with_row_number(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """1-based global row numbers in the given order."""
    return running(df, order, {name: "1L"})
