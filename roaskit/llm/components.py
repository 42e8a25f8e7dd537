"""Connected components of pairs, as tables written to the shared folder from round to round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roaskit.sources.storage import materialize


def components(pairs: DataFrame) -> DataFrame:
    """node and label (the smallest node that can be reached) of every node of the pairs (a, b).

    Each round takes the least label of a node's neighbours (a partial minimum before the
    shuffle) and then the label of that label, so the rounds grow with the logarithm of the
    longest path. Only counts come to the driver.
    """
    both = materialize(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        after = materialize(lower.join(jump, "mid").select("node", "was", F.least("mid", "far").alias("label")), "labels")
        labels = after.select("node", "label")
        if not after.filter("label <> was").count():
            return labels
