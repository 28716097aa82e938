"""Incremental scans with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glintscan.functions.match import NESTED
from glintscan.operators.match import with_words
from glintscan.plans.scan import scan
from glintscan.sources.blocks import OVERLAP, SIZE, file_blocks
from glintscan.sources.files import FILE_SCHEMA, wanted
from glintscan.sources.rules import RuleSet


def stream_files(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of files as they arrive in a folder."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def stream_table(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None
) -> DataFrame:
    """A stream over the Parquet files of a growing table (a folder or a glob)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def scan_stream(texts: DataFrame, rules: RuleSet, text: str = "text", **options) -> DataFrame:
    """The batch check on a stream; map-only, so it keeps no state."""
    return with_words(texts, rules, text, **options)


def scan_block_stream(
    files: DataFrame, rules: RuleSet, size: int = SIZE, overlap: int = OVERLAP,
    encoding: str | None = None, **options,
) -> DataFrame:
    """The check on text files of any size as they arrive: ``path, block, chars, words``.

    ``files`` has ``path, length``; the files are read as blocks, so that no
    value holds a whole file, and the stream keeps no state. A block has the
    matches that start in its own ``chars`` characters, their positions counted
    from there. A match must not be longer than the overlap.
    """
    found = scan_stream(file_blocks(files, size, overlap, encoding), rules, **options)
    own = "transform(filter(w.positions, p -> p >= lead AND p < lead + chars), p -> cast(p - lead AS int))"
    words = f"transform(words, w -> struct(w.kind AS kind, w.term AS term, {own} AS positions))"
    return found.selectExpr("path", "block", "chars", f"filter({words}, w -> size(w.positions) > 0) AS words")


def scan_file_stream(files: DataFrame, rules: RuleSet, **options) -> DataFrame:
    """The whole scan on a stream of files: names, types, extraction, matching.

    Every step works within a row, so the stream keeps no state.
    """
    return scan(files.where(wanted("path")), rules, **options)


def scan_counters(results: DataFrame) -> DataFrame:
    """``counter, name, n`` over scan results, as a stream or a table.

    Files processed, with errors, empty and skipped, and the hits of each term;
    a stream's state is one row for each of these.
    """
    flags = {"processed": "true", "errors": "error IS NOT NULL", "empty": "is_empty", "skipped": "skipped"}
    fixed = ", ".join(
        f"named_struct('counter', '{name}', 'name', '', 'n', cast({flag} AS bigint))" for name, flag in flags.items()
    )
    terms = (
        f"transform(coalesce(words, cast(array() AS {NESTED})), "
        "w -> named_struct('counter', 'term', 'name', w.term, 'n', cast(size(w.positions) AS bigint)))"
    )
    each = results.select(F.explode_outer(F.expr(f"concat(array({fixed}), {terms})")).alias("c"))
    return each.groupBy("c.counter", "c.name").agg(F.sum("c.n").alias("n"))


def append_log(
    stream: DataFrame, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append every micro-batch to a log table, one folder per batch id.

    A batch that is run again after a failure overwrites its own folder, so
    the log has each result once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def counters(stream: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Running counters per key; state is one row per key."""
    return stream.groupBy(*by).agg(*[m.alias(name) for name, m in measures.items()])


def latest_counters(
    counted: DataFrame, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Keep the newest full set of counters as a small table per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = (
        counted.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_to_end(start: Callable[[], StreamingQuery]) -> None:
    query = start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def final_counters(spark: SparkSession, out: str) -> DataFrame:
    """Counters of the last batch written by :func:`latest_counters`."""
    rows = spark.read.parquet(out)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")
