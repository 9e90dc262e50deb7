"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.workspace import Workspace


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: numbers); ``component`` is
    the smallest node reachable.

    Each round a node takes the smallest label among its neighbours, then its
    label's label, until nothing changes; the distance to the smallest node falls
    by about half a round. Labels are a table in the shared folder; the driver sees
    one count a round.
    """
    both = ws.table(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), f"{name}-links"
    )
    labels = ws.table(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")),
        f"{name}-0",
    )
    step = 0
    while True:
        step += 1
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("component").alias("least"))
        )
        mine = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("old"), F.least("component", "least").alias("best")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        new = ws.table(
            mine.join(jump, F.col("best") == F.col("via"), "left").select(
                "node", F.least("best", F.coalesce("further", "best")).alias("component"), "old"
            ),
            f"{name}-{step}",
        )
        changed = new.filter("component <> old").limit(1).count()
        ws.drop(f"{name}-{step - 1}")
        labels = new.select("node", "component")
        if not changed:
            return labels
