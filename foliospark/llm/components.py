"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> id, component (the smallest id reachable) of each id that has a link.

    Each round gives every node the smallest label around it and then its label's label; each round's labels
    are written to the shared folder, so lineage stays short and nothing but a count comes to the driver.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(around, F.col("id") == F.col("a"), "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        up = hooked.select(F.col("id").alias("up"), F.col("component").alias("top"))
        new = stage(hooked.join(up, F.col("component") == F.col("up"), "left").select("id", F.least("component", F.coalesce("top", "component")).alias("component"), "was"), "labels")
        changed = new.where(F.col("component") != F.col("was")).limit(1).count()
        unstage(labels)
        labels = new
        if not changed:
            unstage(both)
            return labels.select("id", "component")
