"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.shared import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id reachable from every linked node.

    Labels fall along links; a link also offers the smaller label to the node
    that the larger label names, and labels are then followed once (pointer
    jumping), so that chains shorten by halves. Each round is staged. Rows with
    a null end and links of a node with itself say nothing and are ignored; an
    empty table gives an empty result. A hub with very many links is a skewed
    join key with one row on the other side, which Spark splits.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = staged(ends.union(ends.select("b", "a")).distinct(), "links")
    labels = staged(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")),
        "labels",
    )
    while True:
        at_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        at_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        near = edges.join(at_a, "a").join(at_b, "b").where("lb < la")
        offers = near.select(F.explode(F.array("a", "la")).alias("node"), F.col("lb").alias("offer"))
        best = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        moved = staged(
            labels.join(best, "node", "left").select("node", F.coalesce("offer", "label").alias("label"), F.col("offer").isNotNull().alias("moved")),
            "labels",
        )
        if moved.where("moved").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        onward = moved.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = staged(moved.select("node", "label").join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
