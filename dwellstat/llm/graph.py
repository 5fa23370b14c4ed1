"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellstat.llm.common import written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): each node of ``edges`` (a, b: long) with the least node it is linked to.

    Every round takes the least label among a node's neighbours and then follows labels one step
    further, so long chains shrink quickly. Minima are aggregated before the shuffle, and each round
    is written to the shared folder; nothing but a count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, f"{label}-edges")
    state = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("node"), "c"), label)
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near"))
        lower = state.join(near, state.node == near.a).select("node", "c", F.least("c", "near").alias("low"))
        # the label's own label: one row per label on the right, so a large component splits on the left
        up = lower.select(F.col("node").alias("low"), F.col("low").alias("above"))
        step = lower.join(up, "low", "left").select("node", "c", F.least("low", F.coalesce("above", "low")).alias("next"))
        step = written(step, label)
        state = step.select("node", F.col("next").alias("c"))
        if step.where("next <> c").isEmpty():
            return state.select("node", F.col("c").alias("component"))
