"""Connected components by passing on the smallest label and jumping to the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import saved


def connected_components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reached) of every end of a link. ``links`` has columns a and b, in any direction.

    A round lets every node take the smallest label among its neighbours and the label of that label, so a path of n nodes takes
    about log2(n) rounds and a star one or two. Each round is written to the shared folder; nothing is collected but one count.
    """
    both = saved(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    while True:
        # of hub and spokes the hub's row is joined to many: an equi-join that adaptive execution may split
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(near, labels.id == near.a).select("id", "component", F.least("component", "low").alias("low"))
        roots = labels.select(F.col("id").alias("low"), F.col("component").alias("root"))
        after = saved(step.join(roots, "low").select("id", F.col("component").alias("was"), F.least("low", "root").alias("component")), "labels")
        labels = after.select("id", "component")
        if after.where("was <> component").isEmpty():
            return labels
