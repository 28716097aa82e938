"""Helpers shared by the pipeline operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.session import run_dir

# A word is a run of characters other than the six ASCII blanks. ``bytes.split``
# and Arrow's ``ascii_split_whitespace`` cut at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def lowered(text: Column) -> Column:
    """The text, empty if null, with only A-Z lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later steps restart from there."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def portions(texts: pa.Array, limit: int = 4 << 20) -> Iterator[pa.Array]:
    """Slices of a text array of about ``limit`` bytes; at least one row each."""
    start = size = 0
    for at, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if at > start and size + (n or 0) > limit:
            yield texts.slice(start, at - start)
            start, size = at, 0
        size += n or 0
    if start < len(texts):
        yield texts.slice(start)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns; nulls and empty values differ."""
    maps = {n for n, kind in df.dtypes if "map<" in kind or kind == "variant"}
    values = [F.to_json(F.struct(F.col(c))) if c in maps else F.col(c) for c in df.columns]
    return F.xxhash64(*values, *[F.col(c).isNull() for c in df.columns])


def numbered(df: DataFrame, first: str, last: str, name: str, step: int = 10_000) -> DataFrame:
    """Each row once for every number from ``first`` to ``last`` (SQL texts), in column ``name``.

    The numbers come in blocks, so that no cell holds those of very many equal
    rows; rows whose last number is before the first one drop out.
    """
    blocks = df.where(F.expr(f"{last} >= {first}")).withColumn(
        "__block", F.explode(F.expr(f"sequence(0L, ({last} - {first}) DIV {step})"))
    )
    inside = f"sequence({first} + __block * {step}, least({last}, {first} + (__block + 1) * {step} - 1))"
    return blocks.withColumn(name, F.explode(F.expr(inside))).drop("__block")
