"""Text classification with Spark ML, evaluation and deciding features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.functions.cols import lit
from glintscan.functions.match import overlapping_spans
from glintscan.functions.text import word_chunks


def features(buckets: int = 1 << 16) -> list:
    return [
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=buckets),
        IDF(inputCol="tf", outputCol="features"),
    ]


def probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", vector_to_array("probability")[1])


def log_loss(scored: DataFrame) -> float:
    """Mean negative log likelihood; ``scored`` has ``label`` and ``p``."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    one = F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return scored.agg(F.avg(one)).first()[0]


def train_classifier(
    train: DataFrame,
    test: DataFrame,
    reg_params: Sequence[float] = (1.0, 0.1, 0.01, 0.001),
    patience: int = 2,
    buckets: int = 1 << 16,
    max_iter: int = 30,
) -> tuple[PipelineModel, list[tuple[float, float]]]:
    """Fit on ``text, label``; keep the model with the lowest test loss.

    Stops after ``patience`` candidates without improvement. Features are
    computed once and shared by the candidates.
    """
    prepared = Pipeline(stages=features(buckets)).fit(train)
    fit_on = prepared.transform(train).select("label", "features").persist()
    check_on = prepared.transform(test).select("label", "features").persist()
    best, best_loss, waited = None, float("inf"), 0
    history: list[tuple[float, float]] = []
    try:
        for reg in reg_params:
            model = LogisticRegression(regParam=reg, maxIter=max_iter).fit(fit_on)
            loss = log_loss(probability(model.transform(check_on)))
            history.append((reg, loss))
            if loss < best_loss:
                best, best_loss, waited = model, loss, 0
            else:
                waited += 1
                if waited >= patience:
                    break
    finally:
        fit_on.unpersist()
        check_on.unpersist()
    return PipelineModel(stages=[*prepared.stages, best]), history


def predict(model: PipelineModel, df: DataFrame, chars: int | None = None) -> DataFrame:
    """Class and probability per text; ``chars`` limits what the model reads."""
    text = F.left("text", F.lit(chars)) if chars else F.col("text")
    whole = df.withColumn("text", text)
    scored = probability(model.transform(whole))
    return scored.select(
        *[c for c in df.columns if c != "text"], "p", F.col("prediction").cast("int").alias("prediction")
    )


def predict_max_chunk(
    model: PipelineModel,
    df: DataFrame,
    key: str,
    threshold: float = 0.7,
    size: int = 512,
    max_chunks: int | None = None,
) -> DataFrame:
    """Largest chunk probability per text against a threshold."""
    chunks = df.select(
        key, F.explode(F.expr(word_chunks("text", size, max_chunks=max_chunks))).alias("text")
    )
    scored = probability(model.transform(chunks))
    return scored.groupBy(key).agg(F.max("p").alias("p")).withColumn(
        "prediction", (F.col("p") >= threshold).cast("int")
    )


def confusion_matrix(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and averages.

    One aggregation gives the confusion counts; the rest is arithmetic on a
    handful of rows.
    """
    cm = confusion_matrix(scored, label, pred)
    sides = cm.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said")),
                F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("said")),
            )
        ).alias("s"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
    )
    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    per = (
        sides.groupBy(F.col("s.c").alias("c"))
        .agg(
            F.sum("s.actual").alias("support"),
            F.sum("s.said").alias("said"),
            (F.sum("hit") / 2).alias("hit"),
        )
        .withColumn("precision", ratio(F.col("hit"), F.col("said")))
        .withColumn("recall", ratio(F.col("hit"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    def weighted(name):
        return (F.sum(F.col(name) * F.col("support")) / F.sum("support")).alias(name)

    rows = per.select(F.col("c").cast("string").alias("class"), "precision", "recall", "f1", "support")
    accuracy = F.sum("hit") / F.sum("support")
    accuracy_row = per.agg(
        accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"),
        F.sum("support").alias("support"),
    ).select(F.lit("accuracy").alias("class"), "precision", "recall", "f1", "support")
    macro = per.agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").alias("support"),
    ).select(F.lit("macro avg").alias("class"), "precision", "recall", "f1", "support")
    mean = per.agg(
        weighted("precision"), weighted("recall"), weighted("f1"), F.sum("support").alias("support")
    ).select(F.lit("weighted avg").alias("class"), "precision", "recall", "f1", "support")
    out = rows.unionByName(accuracy_row).unionByName(macro).unionByName(mean)
    return out.select(
        "class",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
        F.col("support").cast("bigint").alias("support"),
    )


def top_features(
    positives: DataFrame,
    terms: Sequence[str],
    phrases: Sequence[str],
    n: int = 10,
    text: str = "text",
) -> DataFrame:
    """Deciding features among positive texts.

    Dictionary terms (two characters or more) count once per text that holds
    them; phrase patterns count every occurrence of two characters or more,
    case ignored.
    """
    long_terms = [t for t in dict.fromkeys(terms) if len(t) >= 2]
    parts = []
    if long_terms:
        # All terms at one start position are prefixes of the longest one.
        listed = f"array({', '.join(lit(t) for t in long_terms)})"
        longest = f"array_distinct(transform({overlapping_spans(text, long_terms)}, s -> s.term))"
        found = (
            f"array_distinct(flatten(transform({longest}, "
            f"t -> filter({listed}, w -> startswith(t, w)))))"
        )
        parts.append(f"transform({found}, t -> struct(t AS feature, 1L AS n))")
    for p in phrases:
        seen = f"regexp_extract_all({text}, {lit(f'(?iU)({p})')}, 1)"
        parts.append(
            f"array(struct({lit(p)} AS feature, "
            f"cast(size(filter({seen}, m -> length(m) >= 2)) AS bigint) AS n))"
        )
    return (
        positives.select(F.explode_outer(F.expr(f"concat({', '.join(parts)})")).alias("f"))
        .where(F.col("f.n") > 0)
        .groupBy(F.col("f.feature").alias("feature"))
        .agg(F.sum("f.n").alias("weight"))
        .orderBy(F.desc("weight"), "feature")
        .limit(n)
    )
