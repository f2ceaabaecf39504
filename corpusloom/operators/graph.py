"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import discard, stored


def connected(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the least node that links reach.

    In each round a node takes the least label among its own and its neighbours', and then that label's label; so the
    rounds grow with the logarithm of a component's width in the common case. Labels are written to the shared folder
    after each round. Minima are taken map-side first, so a node with very many links is no hot key.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = stored(least.join(jump, "comp").select("node", "old", F.least("comp", "next").alias("comp")), "labels")
        discard(labels)
        labels = new
        if new.where("old <> comp").isEmpty():
            discard(both)
            return new.select("node", "comp")
