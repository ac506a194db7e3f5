"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours (combined before the shuffle, so a hub with very many links
    costs no more than its links) and then the label of that label, which halves the length of chains. Links and labels stay in Spark.
    """
    both = written(
        links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).distinct(), "links"
    )
    labels = written(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = lower.join(jump, "mid").select("node", F.least("mid", "far").alias("component"), (F.col("old") != F.least("mid", "far")).alias("moved"))
        after = written(step, "labels")
        moved = after.filter("moved").limit(1).count()
        drop(labels)
        labels = after.select("node", "component")
        labels._llm_path = after._llm_path
        if not moved:
            drop(both)
            return labels
