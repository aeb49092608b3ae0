"""Connected components of links, by least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import keep


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b) is linked with, directly or not.

    Every round takes the least label among a node's neighbours, then the label of that label, so that rounds grow
    with the logarithm of the longest path. Each round is written to the shared folder, and the last one is returned.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    label = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "label")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        lower = label.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "root", F.least("root", F.coalesce("m", "root")).alias("low"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = keep(lower.join(jump, "low", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("next", "low")).alias("root")), "label")
        label = new.select("node", "root")
        if new.filter("old <> root").isEmpty():
            return label
