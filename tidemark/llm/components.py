"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def components(links: DataFrame, folder: str) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a``, ``b``); the label is the smallest node of the component.

    Each turn takes the smallest label among a node and its neighbours, then the label of that label, so that paths
    shrink by half. Minima are taken within tasks first, so a node with very many links is no hot spot. Labels are
    written to ``folder`` after each turn, which ends the lineage.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = common.written(both, f"{folder}/links")
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")
    ), f"{folder}/labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("node").alias("a"), F.col("label").alias("l")), "a")
        near = near.groupBy(F.col("b").alias("node")).agg(F.min("l").alias("l"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "l").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        moved = moved.join(jump, "to").select("node", F.least("to", "further").alias("new"), "label")
        moved = common.written(moved, f"{folder}/labels-{turn}")
        done = moved.where("new <> label").limit(1).count() == 0
        labels = moved.select("node", F.col("new").alias("label"))
        if done:
            return labels
