"""Connected components of edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import durable


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for edges (node, root) between strings.

    Rounds of neighbour minima, each followed by a jump to the minimum's own minimum, until nothing changes. Every
    round is written to the shared folder; no node's neighbours are ever gathered in one place.
    """
    both = durable(edges.select("node", F.col("root").alias("other")).unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = durable(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("offer"))
        nearer = labels.join(offered, "node").select("node", F.col("root").alias("old"), F.least("root", "offer").alias("mid"))
        jump = nearer.join(labels.select(F.col("node").alias("mid"), F.col("root").alias("far")), "mid").select("node", "old", F.least("mid", "far").alias("root"))
        new = durable(jump, "labels")
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels
