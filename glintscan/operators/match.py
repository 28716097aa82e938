"""Matching as DataFrame transforms: nested results and the long hits table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.functions import fixed
from glintscan.functions.match import (
    NESTED,
    by_rule,
    checked,
    overlapping_spans,
)
from glintscan.session import checkpointed
from glintscan.sources.rules import RuleSet
from glintscan.sources.tables import inline_table

# Rule tables are driver-side configuration. Above this many rows a rules side
# is joined by shuffle instead of being broadcast.
BROADCAST_RULES = 100_000


def with_words(
    df: DataFrame, rules: RuleSet, text: str = "text", out: str = "words", **options
) -> DataFrame:
    """Add the nested result of every text. Map-only, no shuffle."""
    return df.withColumn(out, F.expr(checked(text, rules, **options)))


def explode_words(df: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """One row per (text, term): kind, term, order in the text, positions.

    The outer form keeps the optimizer from testing the size of the array
    first, which would match every text again in a filter.
    """
    listed = df.select(*keys, F.posexplode_outer(words).alias("ord", "w")).where("w IS NOT NULL")
    return listed.select(
        *keys,
        F.col("w.kind").alias("kind"),
        F.col("w.term").alias("term"),
        "ord",
        F.col("w.positions").alias("positions"),
        F.size("w.positions").alias("n"),
    )


def hits(
    df: DataFrame, rules: RuleSet, keys: list[str], text: str = "text", **options
) -> DataFrame:
    """The long hits table: one row per match position."""
    found = with_words(df.select(*keys, text), rules, text, **options)
    return explode_words(found, keys).select(
        *keys, "kind", "term", F.explode("positions").alias("pos")
    )


def overlapping_hits(
    df: DataFrame, rules: RuleSet, keys: list[str], text: str = "text"
) -> DataFrame:
    """Every keyword at every position, overlaps and repeats included.

    Keywords that start at one position are prefixes of the longest one there,
    so one pass finds the longest and a small rules table expands it.
    """
    words = rules.keywords
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    entries = [
        (longest, i, longest[:size])
        for longest in places
        for size in range(1, len(longest) + 1)
        for i in places.get(longest[:size], ())
    ]
    spark = df.sparkSession
    chain = inline_table(spark, entries, "longest string, ord int, term string")
    if len(entries) <= BROADCAST_RULES:
        chain = F.broadcast(chain)
    found = df.select(*keys, F.explode_outer(F.expr(overlapping_spans(text, words))).alias("s"))
    return (
        found.where("s IS NOT NULL")
        .select(*keys, F.col("s.term").alias("longest"), F.col("s.pos").alias("pos"))
        .join(chain, "longest")
        .select(*keys, "ord", "term", "pos")
    )


def regex_hits(df: DataFrame, rules: RuleSet, keys: list[str], text: str = "text") -> DataFrame:
    """Named regex rules (declared in configs, kept apart from the checker)."""
    parts = [
        by_rule(text, "regex", p, name, None) for name, (p, _) in rules.regexes.items()
    ]
    found = df.select(*keys, F.expr(f"concat({', '.join(parts)})").alias("words"))
    return explode_words(found, keys).select(
        *keys, "kind", "term", F.explode("positions").alias("pos")
    )


# ------------------------------------------------------------------ large text
def char_chunks(
    df: DataFrame,
    keys: list[str],
    text: str = "text",
    threshold: int = 100_000,
    width: int = 50_000,
    step: int = 40_000,
    max_chunks: int | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Overlapping character chunks of long texts; short texts stay whole.

    Cut in two levels (blocks of 64 steps, then chunks) so that a very long
    text is not rescanned from its start for every chunk. ``spread`` moves the
    chunks of long texts over that many partitions.
    """
    body = F.col("__text")
    length = F.length(body)
    block = 64 * step
    blocks = F.when(length > threshold, F.sequence(F.lit(0), length - 1, F.lit(block))).otherwise(
        F.array(F.lit(0))
    )
    source = df.select(*keys, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    outer = source.select(
        *keys, (length > threshold).alias("__long"), F.explode(blocks).alias("__base"), "__text"
    ).select(
        *keys,
        "__long",
        "__base",
        F.when(
            F.col("__long"), F.substring(body, F.col("__base") + 1, F.lit(block + width))
        ).otherwise(body).alias("__text"),
    )
    # Only the first `block` characters of a block start chunks of their own.
    offsets = F.when(
        F.col("__long"), F.sequence(F.lit(0), F.least(length, F.lit(block)) - 1, F.lit(step))
    ).otherwise(F.array(F.lit(0)))
    chunks = outer.select(*keys, "__long", "__base", F.explode(offsets).alias("__at"), "__text")
    out = chunks.select(
        *keys,
        F.when(F.col("__long"), ((F.col("__base") + F.col("__at")) / step).cast("int"))
        .otherwise(0)
        .alias("chunk_id"),
        (F.col("__base") + F.col("__at")).alias("start"),
        F.when(F.col("__long"), F.substring(body, F.col("__at") + 1, F.lit(width)))
        .otherwise(body)
        .alias("chunk"),
    )
    if max_chunks is not None:
        out = out.where(F.col("chunk_id") < max_chunks)
    return out.repartition(spread, *keys, "chunk_id") if spread else out


def chunked_hits(
    df: DataFrame,
    rules: RuleSet,
    keys: list[str],
    text: str = "text",
    absolute: bool = True,
    max_chunks: int | None = None,
    threshold: int = 100_000,
    width: int = 50_000,
    step: int = 40_000,
    spread: int | None = None,
    **options,
) -> DataFrame:
    """Distinct (text, term, position) over the chunks of every text.

    Positions are absolute; ``absolute=False`` keeps them chunk-relative.
    """
    chunks = char_chunks(df, keys, text, threshold, width, step, max_chunks, spread)
    found = hits(chunks, rules, [*keys, "start"], "chunk", **options)
    pos = F.col("pos") + F.col("start") if absolute else F.col("pos")
    return found.select(*keys, "kind", "term", pos.alias("pos")).distinct()


def chunked_words(
    df: DataFrame,
    rules: RuleSet,
    keys: list[str],
    text: str = "text",
    cap: int | None = None,
    max_chunks: int | None = None,
    threshold: int = 100_000,
    width: int = 50_000,
    step: int = 40_000,
    spread: int | None = None,
    **options,
) -> DataFrame:
    """One row per (text, term): kind, term, its absolute positions, sorted.

    A chunk gives one row a term, with its first ``cap`` positions: the first
    ``cap`` of a text are among them, so one aggregate is exact.
    """
    chunks = char_chunks(df, keys, text, threshold, width, step, max_chunks, spread)
    found = with_words(chunks.select(*keys, "start", "chunk"), rules, "chunk", **options)
    listed = explode_words(found, [*keys, "start"])
    first = F.array_sort(F.transform("positions", lambda p: p + F.col("start")))
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("__first"))))
    if cap is not None:
        first, every = F.slice(first, 1, cap), F.slice(every, 1, cap)
    return (
        listed.withColumn("__first", first)
        .groupBy(*keys, "kind", "term")
        .agg(every.alias("positions"))
    )


# ----------------------------------------------------------------------- gates
def _marker() -> Column:
    return F.array(
        F.struct(
            F.lit("model").alias("kind"),
            F.lit(fixed.MODEL_MARKER).alias("term"),
            F.array(F.lit(0)).alias("positions"),
        )
    ).cast(NESTED)


def gated_check(
    df: DataFrame,
    rules: RuleSet,
    predictions: DataFrame,
    key: str,
    text: str = "text",
    words: str = "words",
    prediction: str = "prediction",
    **options,
) -> DataFrame:
    """Rule results only where the classifier says sensitive; other texts are not matched.

    A sensitive text without rule results gets one marker at position 0. Texts
    without a prediction count as not sensitive; a key has one prediction at
    most.
    """
    sensitive = predictions.where(F.col(prediction) == 1).select(key, F.lit(True).alias("__sensitive"))
    joined = df.join(sensitive, key, "left")
    found = f"if(__sensitive, {checked(text, rules, **options)}, NULL)"
    return joined.withColumn(words, F.expr(found)).withColumn(
        words,
        F.when(F.col("__sensitive").isNull(), F.array().cast(NESTED))
        .when(F.size(words) > 0, F.col(words))
        .otherwise(_marker()),
    ).drop("__sensitive")


def model_only_words(sensitive: Column) -> Column:
    """Result of the model-only mode: one marker or nothing."""
    return F.when(sensitive, _marker()).otherwise(F.array().cast(NESTED))


# ----------------------------------------------------------------- repeated text
def match_distinct_text(
    df: DataFrame,
    rules: RuleSet,
    key: str,
    text: str = "text",
    hot_copies: int = 10_000,
    salts: int = 64,
    broadcast_ids: int = 1_000_000,
    **options,
) -> DataFrame:
    """Match every distinct text once and give the result to all its copies.

    Only narrow rows move: the copies beyond the first of each text are found
    by hash and left out where the texts lie (broadcast if they are at most
    ``broadcast_ids``), the others are matched in place, and the copies take
    their first one's result. Texts with more than ``hot_copies`` copies are
    joined over ``salts`` sub-keys. Keys are unique; null texts are no copies.
    """
    keyed = df.select(key, F.md5(F.encode(F.col(text), "UTF-8")).alias("md5"), F.col(text))
    narrow = keyed.select(key, "md5")
    groups = narrow.groupBy("md5").agg(
        F.count(F.lit(1)).alias("__copies"), F.min(key).alias("__first")
    )
    repeated = groups.where("__copies > 1")
    copies = checkpointed(
        narrow.join(repeated, "md5").where(F.col(key) != F.col("__first"))
    )
    skipped = copies.select(key)
    if copies.limit(broadcast_ids + 1).count() <= broadcast_ids:
        skipped = F.broadcast(skipped)
    found = checkpointed(
        keyed.join(skipped, key, "left_anti").select(
            key, "md5", F.expr(checked(text, rules, **options)).alias("words")
        )
    )
    hot = F.col("__copies") > hot_copies
    salt = F.when(hot, F.pmod(F.xxhash64(key), F.lit(salts))).otherwise(F.lit(0))
    firsts = copies.select("__first", "__copies").distinct().join(
        found.select(F.col(key).alias("__first"), "words"), "__first"
    )
    parts = F.sequence(F.lit(0), F.when(hot, F.lit(salts - 1)).otherwise(F.lit(0)))
    right = firsts.select("__first", "words", F.explode(parts).alias("__salt"))
    rest = copies.select(key, "md5", "__first", salt.cast("int").alias("__salt"))
    return found.unionByName(rest.join(right, ["__first", "__salt"]).select(key, "md5", "words"))


# -------------------------------------------------------------------- weighting
def category_hits(found: DataFrame, rules: RuleSet) -> DataFrame:
    """Tag long hits with their rule's category and weight."""
    rows = [
        (("keyword" if r[0] == "mark" else r[0]), r[1], r[2], r[3]) for r in rules.rows()
    ]
    table = inline_table(
        found.sparkSession, rows, "kind string, category string, term string, weight double"
    )
    side = F.broadcast(table) if len(rows) <= BROADCAST_RULES else table
    return found.join(side, ["kind", "term"])


def weighted_score(
    tagged: DataFrame, keys: list[str], threshold: float
) -> DataFrame:
    """Weight totals per text and whether the largest reaches the threshold."""
    return tagged.groupBy(*keys).agg(
        F.sum("weight").alias("weight_sum"),
        F.max("weight").alias("weight_max"),
        F.coalesce(F.max("weight") >= threshold, F.lit(False)).alias("over_threshold"),
    )
