"""Connected components of an edge list, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.durable import durable


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that its component has.

    ``edges`` has columns a and b of one orderable type.  Each round takes the
    least label among the neighbours and then the label of that label, so a
    component of any shape is done after about the logarithm of its diameter.
    Rounds go on until no label changes; each is kept in the checkpoint folder.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").filter("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("best"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("best", "root")).alias("via"))
        jump = labels.select(F.col("node").alias("n"), F.col("root").alias("r"))
        after = durable(lower.join(jump, lower.via == jump.n, "left").select("node", "was", F.least("via", F.coalesce("r", "via")).alias("root")))
        changed = after.filter("root <> was").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
