"""Connected components of a graph of links as Spark jobs: nodes hook to their least neighbour, edges contract, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._staging import small, stage


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node that has a link; `links` has two columns of one type, read as undirected.

    Self links and repeated links do no harm. comp is one of the component's nodes, the same for all of them.
    Each round halves the nodes that still have links at least, and works on the links that are left.
    """
    edges = stage(links.toDF("a", "b").filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = small(stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")), "hooks"))
        jumped = hook
        for _ in range(3):
            jumped = jumped.join(hook.toDF("up", "top"), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        hook = small(stage(jumped, "hooks"))
        rounds.append(hook)
        for side in ("a", "b"):
            edges = edges.join(hook.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
        edges = stage(edges.filter("a <> b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    labels = rounds[0].withColumnRenamed("up", "comp")
    for hook in rounds[1:]:
        labels = labels.join(hook.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return stage(labels, "components")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, comp) of components that more links join, nodes that have no label yet included."""
    known = small(labels)
    for side in ("a", "b"):
        links = links.join(known.toDF(side, "comp"), side, "left").withColumn(side, F.coalesce("comp", side)).drop("comp")
    joined = small(components(links))
    old = labels.join(joined.toDF("comp", "top"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = joined.join(known.select(F.col("comp").alias("node")).distinct(), "node", "left_anti")
    return stage(old.unionByName(new.select("node", "comp")), "components")
