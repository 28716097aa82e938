"""Connected components as DataFrame rounds: nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the undirected edges ``(a, b)``.

    The label is the smallest node of the component. Each round takes the
    smallest label among the neighbours and then the label of that label, so
    paths shrink by half. Rounds are written to the shared folder; only the
    number of changed labels reaches the driver. A hub's rows are one side of a
    join with a unique side, which skew handling splits, or are reduced by a
    minimum that combines before the shuffle.
    """
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).distinct(), "component-edges"
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
        "component-labels",
    )
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("at"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, F.col("node") == F.col("at")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("hook")
        )
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = hooked.join(up, F.col("hook") == F.col("up"), "left").select(
            "node", "old", F.coalesce("top", "hook").alias("label")
        )
        jumped = stored(jumped, "component-labels")
        labels = jumped.select("node", "label")
        if not jumped.where("old <> label").take(1):
            return labels
