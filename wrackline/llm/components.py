"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.session import cut


def components(edges: DataFrame) -> DataFrame:
    """`id, component` (the least id of the component) of every end of `edges` (`a, b`).

    Every node repeatedly takes the least label among its own and its neighbours', then the
    label of that label, so paths shorten by doubling. Hubs are harmless: labels are reduced
    before the shuffle. Rounds end when no label changed; each is cut from its lineage.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("near"))
        least = labels.join(near, "id").select("id", F.least("component", "near").alias("via"), F.col("component").alias("was"))
        jump = labels.toDF("via", "further")
        step = cut(least.join(jump, "via", "left").select("id", F.least("via", F.coalesce("further", "via")).alias("component"), "was"))
        labels = step.select("id", "component")
        if step.where("component <> was").isEmpty():
            return labels
