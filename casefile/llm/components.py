"""Connected components by joins: labels spread along edges and jump to their labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Workspace, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node reachable.

    A round takes the least label among the neighbours and follows it once, so chains shorten to half; rounds go on
    until no label changes. Every table is written to the shared folder, which cuts the lineage. Labels of a node
    with many neighbours are reduced by partial aggregation.
    """
    with Workspace() as w:
        return w.keep(spread_labels(edges)).select("node", "root")


def spread_labels(edges: DataFrame) -> DataFrame:
    """The last table of labels."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "cc-0")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("low"))
        step = labels.join(seen, labels.node == seen.a).select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = step.select(F.col("node").alias("at"), F.col("root").alias("further"))
        labels = written(step.join(jump, F.col("root") == F.col("at")).select("node", "old", F.least("root", "further").alias("root")), "cc")
        if not labels.filter("old <> root").limit(1).count():
            return labels
