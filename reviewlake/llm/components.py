"""Connected components of an edge table, as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.storage import written


#: Bytes of an edge, or of a node's labels.
ROW_BYTES = 24


def components(edges: DataFrame, number: int | None = None) -> DataFrame:
    """(a, b) long pairs to (node, component), the component being its least node.

    Each round every node takes the least label among its own and its
    neighbours', then the label of that label; labels are written each round.
    Nodes without an edge are not returned. ``number``: of edges at most, if known.
    """
    most = 2 * ROW_BYTES * (edges.count() if number is None else number)
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", most)
    labels = written(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", most)
    while True:
        near = (both.join(labels, both.b == labels.node)
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = written(lower.join(jump, "label")
                      .select("node", F.least("label", "root").alias("label"),
                              (F.least("label", "root") < F.col("old")).alias("moved")), "labels", most)
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def merged_components(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The labels (node, component) of all edges so far, from those before ``edges`` and the new
    ones: the old components, as nodes, are connected by the new edges."""
    number = edges.count()
    if labels is None:
        return components(edges, number)
    ends = edges.select("a", "b")
    for c in ("a", "b"):
        of = labels.select(F.col("node").alias(c), F.col("component").alias("_of"))
        ends = ends.join(of, c, "left").withColumn(c, F.coalesce("_of", c)).drop("_of")
    joined = components(ends.where("a <> b"), number)
    old = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_new")),
                      "component", "left").select("node", F.coalesce("_new", "component").alias("component"))
    # Nodes that had no edge before; a component's least node is in the old labels.
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    return written(old.unionByName(fresh), "labels", ROW_BYTES * (labels.count() + 2 * number))
