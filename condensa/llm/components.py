"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for links(a, b).

    Every round a node takes the smallest label around it, then the label of that
    label, so a chain shortens by more than half; each round is checkpointed, and
    no link or label goes to the driver.
    """
    both = checkpoint(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    labels = checkpoint(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        least = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        now = checkpoint(least.join(jump, "label").select("node", F.col("component").alias("was"), F.least("label", "further").alias("component")))
        if now.where("was <> component").isEmpty():
            return now.select("node", "component")
        labels = now.select("node", "component")
