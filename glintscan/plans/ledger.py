"""Logs that go on over runs: a ledger of number ranges beside the rows.

Each run, or batch of a stream, has one ledger entry with the numbers that it
owns. The entry is written before the rows: a run that dies and is started
again, or a batch that is repeated, takes its old range and replaces its rows,
so that numbers have no gaps and no repeats.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glintscan.operators.ordered import with_row_number
from glintscan.session import checkpointed
from glintscan.sources.tables import inline_table

LEDGER = "run string, first bigint, n bigint"


def ledger(spark: SparkSession, log: str) -> DataFrame:
    """``run, first, n`` of all runs so far."""
    try:
        return spark.read.option("recursiveFileLookup", "true").schema(LEDGER).parquet(f"{log}/ledger")
    except AnalysisException as problem:  # no run yet
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return inline_table(spark, [], LEDGER)


def reserve(spark: SparkSession, log: str, run: str, n: int) -> int:
    """The first number of a run's range: its old one, or the one after the last run's.

    The last run may come again with other rows; an earlier one keeps its
    number of rows, as the ranges after it are taken. One writer at a time.
    """
    entries = ledger(spark, log)
    others = entries.where(F.col("run") != run)
    mine = entries.where(F.col("run") == run).first()
    after = others.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 1
    if mine is None:
        first = after
    else:
        first = mine["first"]
        if n != mine["n"] and after > first:
            raise ValueError(f"run {run} had {mine['n']} rows, now {n}, and later runs follow it")
    name = run.encode().hex()  # any name is a folder
    inline_table(spark, [(run, first, n)], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{log}/ledger/{name}")
    return first


def append_run(rows: DataFrame, order: list[str], log: str, run: str, name: str = "seq") -> None:
    """Append the rows of a run, numbered in ``order`` from where the log ends.

    ``order`` is a unique key. The rows are numbered once and kept in the shared
    folder, so that their count and their numbers agree.
    """
    spark = rows.sparkSession
    numbered = checkpointed(with_row_number(rows, order, name))
    first = reserve(spark, log, run, numbered.count())
    placed = numbered.withColumn(name, F.col(name) + F.lit(first - 1)).withColumn("run", F.lit(run))
    placed.write.mode("overwrite").parquet(f"{log}/rows/{run.encode().hex()}")


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The rows of all runs."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{log}/rows")


def append_numbered_log(
    stream: DataFrame, order: list[str], log: str, checkpoint: str, stream_name: str = "stream"
) -> StreamingQuery:
    """Every batch of a stream as a run of the log; a repeated batch takes its old numbers."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            append_run(batch, order, log, f"{stream_name}-{batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
