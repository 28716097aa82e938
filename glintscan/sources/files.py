"""File inventories from any Hadoop-readable folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.functions import fixed
from glintscan.functions.cols import any_of, case, is_in, lit
from glintscan.functions.detect import header_hex, with_binary_text
from glintscan.functions.encoding import with_text
from glintscan.functions.paths import (
    base_name,
    in_hidden_dir,
    is_hidden,
    is_internal_stream,
    suffix,
)
from glintscan.functions.text import BLANK_LINES, budget_paragraphs, paragraphs, truncate
from glintscan.session import checkpointed
from glintscan.sources.tables import inline_table

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LISTING_SCHEMA = "path string, is_dir boolean, modificationTime timestamp, length bigint"
CELL = (1 << 31) - (1 << 20)  # bytes that one value of a row can hold


def wanted(path: str) -> str:
    """Not hidden, not an Office temporary or internal stream, not skipped by type."""
    tests = [is_hidden(path), in_hidden_dir(path), is_internal_stream(path)]
    tests.append(is_in(suffix(path), fixed.SKIP_EXTENSIONS))
    return f"NOT {any_of(tests)}"


def read_binary(
    spark: SparkSession, paths: Sequence[str] | str, recursive: bool = True
) -> DataFrame:
    """Raw ``binaryFile`` rows of one or many folders.

    ``content`` is read only when a later step uses it, and is NULL for files
    over what a value can hold (the length test reaches the reader, which would
    end the job); ``sources.blocks`` reads those.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    rows = reader.load([paths] if isinstance(paths, str) else list(paths))
    large = rows.where(F.col("length") > CELL).withColumn("content", F.lit(None).cast("binary"))
    return rows.where(F.col("length") <= CELL).unionByName(large)


def scan_files(
    spark: SparkSession,
    paths: Sequence[str] | str,
    recursive: bool = True,
    with_left_out: bool = False,
) -> DataFrame:
    """Inventory of wanted files.

    ``binaryFile`` leaves out empty files and names starting with ``_``;
    ``with_left_out`` lists the folders once more and adds those.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    rows = read_binary(spark, roots, recursive).select(
        "path", "modificationTime", "length", "content"
    )
    if with_left_out:
        extra = [left_out_files(spark, root, recursive) for root in roots]
        rows = reduce(DataFrame.unionByName, extra, rows)
    return rows.where(wanted("path"))


def open_fs(location: str):
    from pyarrow import fs

    if "://" not in location and not location.startswith("file:"):
        return fs.LocalFileSystem(), location, "file:"
    if location.startswith("file:"):
        return fs.LocalFileSystem(), "/" + location[5:].lstrip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(location)
    return system, inner, location[: len(location) - len(inner)]


def list_folder(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """All entries below ``root``, hidden folders pruned.

    One job per folder level: the folders of a level are rows, and the tasks
    list their direct children.
    """

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for place in batch["dir"]:
                system, inner, prefix = open_fs(place)
                infos = system.get_file_info(fs.FileSelector(inner))
                yield pd.DataFrame(
                    {
                        "path": [prefix + i.path for i in infos],
                        "is_dir": [i.type == fs.FileType.Directory for i in infos],
                        "modificationTime": pd.to_datetime(
                            [(i.mtime_ns or 0) // 1000 for i in infos], unit="us"
                        ),
                        "length": [int(i.size or 0) for i in infos],
                    }
                )

    level = inline_table(spark, [(root,)], "dir string")
    levels: list[DataFrame] = []
    while True:
        listed = checkpointed(level.mapInPandas(children, LISTING_SCHEMA))
        levels.append(listed)
        below = listed.where(f"is_dir AND NOT startswith({base_name('path')}, '.')")
        if not recursive or below.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        level = below.select(F.col("path").alias("dir")).repartition("dir")


def left_out_files(
    spark: SparkSession, root: str, recursive: bool = True, limit: int | None = None
) -> DataFrame:
    """Empty files and ``_`` names below ``root``, with the bytes of the latter.

    Bytes of files over ``limit``, or over what a value can hold, are not read:
    their content is NULL, and scans give them an error.
    """
    most = CELL if limit is None else min(limit, CELL)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                data = b"" if row.length == 0 else None
                if 0 < row.length <= most:
                    system, inner, _ = open_fs(row.path)
                    with system.open_input_stream(inner) as stream:
                        data = stream.read()
                yield pd.DataFrame(
                    {
                        "path": [row.path],
                        "modificationTime": [row.modificationTime],
                        "length": [row.length],
                        "content": [data],
                    }
                )

    files = list_folder(spark, root, recursive).where(~F.col("is_dir"))
    left = files.where(f"length = 0 OR startswith({base_name('path')}, '_')")
    return left.select("path", "modificationTime", "length").mapInPandas(load, FILE_SCHEMA)


def file_metadata(files: DataFrame) -> DataFrame:
    """Name, suffix, size, header and formatted time of inventory rows."""
    return files.selectExpr(
        "path",
        f"{base_name('path')} AS file_name",
        f"{suffix('path')} AS extension",
        "length AS file_size",
        f"{header_hex('content', 32)} AS header_hex",
        "date_format(modificationTime, 'yyyy-MM-dd HH:mm:ss') AS modified_at",
    )


def read_text(
    files: DataFrame, limit: int | None = None, content: str = "content"
) -> DataFrame:
    """Add ``text``: decoded bytes, with a ``limit`` cut above so many characters with a notice."""
    decoded = with_text(files, content, "text").withColumn("text", F.col("text.text"))
    if limit is None:
        return decoded
    return decoded.withColumn("text", F.expr(truncate("text", limit, fixed.NOTICE_FILE_CUT)))


def labelled(files: DataFrame, flag: int) -> DataFrame:
    """Inventory rows with a constant sample label."""
    return files.withColumn("is_sensitive", F.lit(flag))


def binary_text(
    files: DataFrame,
    content: str = "content",
    separator: str = BLANK_LINES,
    budget: int | None = None,
    shortest: int = 100,
) -> DataFrame:
    """Text found in binary files: ``text``, ``encoding``, ``paragraphs``, ``error``.

    Readable paragraphs of the best decoding, with a budget the longest ones
    within it. Too little readable text is an error.
    """
    decoded = with_binary_text(files, content)
    paras = paragraphs("decoded.text", separator)
    kept = decoded.withColumn("__paras", F.expr(budget_paragraphs(paras, budget) if budget else paras))
    joined = "coalesce(array_join(__paras, '\\n\\n'), '')"
    error = case(
        [
            ("decoded.ratio < 0.5D", lit("二进制内容提取失败: 未能提取到有效的文本内容")),
            (f"length({joined}) < {shortest}", lit("二进制内容提取失败: 未能提取到足够的文本内容")),
        ]
    )
    failed = kept.withColumn("error", F.expr(error))
    return failed.withColumns(
        {
            "text": F.expr(f"if(error IS NULL, {joined}, '')"),
            "encoding": F.col("decoded.encoding"),
            "paragraphs": F.size("__paras"),
        }
    ).drop("decoded", "__paras")
