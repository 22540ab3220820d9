"""Connected components of an edge table by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.storage import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: the least node it reaches.

    Each round takes the least label among a node and its neighbours, then the label of
    that label, and is written, so that a lost executor costs its own tasks only. A node
    with many neighbours gathers its least label before the shuffle.
    """
    both = written(
        edges.selectExpr("a AS node", "b AS other").unionByName(edges.selectExpr("b AS node", "a AS other")),
        "component-edges",
    )
    labels = written(
        both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "component-labels"
    )
    while True:
        heard = both.join(labels.selectExpr("node AS other", "root AS theirs"), "other").groupBy("node").agg(
            F.min("theirs").alias("theirs")
        )
        lowered = labels.join(heard, "node").select(
            "node", "root", F.least("root", "theirs").alias("lower")
        )
        jumped = written(
            lowered.join(labels.selectExpr("node AS lower", "root AS far"), "lower").select(
                "node", F.least("lower", "far").alias("root"), (F.least("lower", "far") < F.col("root")).alias("moved")
            ),
            "component-labels",
        )
        labels = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return labels
