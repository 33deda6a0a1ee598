"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that links reach) for every node of edges(a, b).

    Each round a node takes the smallest label among itself and its neighbours, then the label of that label; labels
    and edges between different labels are written out each round. Edges inside one label leave the table."""
    live = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")))
    while live.limit(1).count():
        # live edges join labels: the larger label hooks onto the smallest neighbour, then chains are shortened
        hooks = live.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to"))
        hooks = materialize(hooks)
        while True:
            far = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
            jumped = hooks.join(far.hint("merge"), "to", "left").select("label", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
            jumped = materialize(jumped)
            hooks = jumped.select("label", "to")
            if not jumped.filter("moved").limit(1).count():
                break
        labels = materialize(labels.join(hooks.hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        a, b = (hooks.select(F.col("label").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = live.join(a.hint("merge"), "a", "left").join(b.hint("merge"), "b", "left")
        moved = moved.select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"))
        live = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
    return labels
