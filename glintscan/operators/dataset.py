"""Training-set preparation: hashing, deduplication, cleaning, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.functions import fixed
from glintscan.functions.text import clean_dispatch


def content_md5(content: Column) -> Column:
    return F.md5(content)


def _group_keys(df: DataFrame, md5: str, key: str) -> DataFrame:
    # Only hash and key are shuffled, combined map-side, so one hash shared by
    # a large part of the rows costs one row per task.
    return df.groupBy(md5).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("__n"))


def keep_first(df: DataFrame, md5: str = "md5", key: str = "id") -> DataFrame:
    """One row per hash, the one with the smallest key.

    The surviving keys are found on two narrow columns; the rows follow by a
    semi-join on the unique key, which no repeated hash can skew. Adaptive
    execution makes it a hash join where every partition of keys is small.
    """
    kept = _group_keys(df, md5, key).select(key)
    return df.join(kept, key, "left_semi")


def drop_all_repeats(df: DataFrame, md5: str = "md5", key: str = "id") -> DataFrame:
    """Only rows whose hash occurs once."""
    kept = _group_keys(df, md5, key).where(F.col("__n") == 1).select(key)
    return df.join(kept, key, "left_semi")


def duplicate_groups(df: DataFrame, md5: str = "md5") -> DataFrame:
    return df.groupBy(md5).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def migrate(files: DataFrame, digits: bool = True) -> DataFrame:
    """Copy a ``files`` table with cleaned content; as is without its columns."""
    if not {"content", "file_type"} <= set(files.columns):
        return files
    return files.withColumn(
        "content", clean_dispatch("content", "file_type", digits)
    )


def add_status(files: DataFrame, default: str = fixed.STATUS_OK) -> DataFrame:
    """Add ``extraction_status`` with its default where it is missing."""
    if "extraction_status" in files.columns:
        return files.withColumn(
            "extraction_status", F.coalesce("extraction_status", F.lit(default))
        )
    return files.withColumn("extraction_status", F.lit(default))


def append_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both tables; columns one of them lacks are NULL."""
    return old.unionByName(new, allowMissingColumns=True)


def split_side(key: Column, share: float = 0.7, seed: int = 42) -> Column:
    """``train`` or ``test`` from a hash of the key, the same on every run."""
    draw = F.left(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), F.lit(6))
    return F.when(draw < format(int(share * 16**6), "06x"), "train").otherwise("test")
