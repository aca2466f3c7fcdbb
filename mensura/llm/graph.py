"""Connected components of a graph that no machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import stage_table


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in ``links`` (``a``, ``b``, whole
    numbers): columns ``node``, ``label``.

    Each round, a node takes the smallest label of its neighbours, passes it
    on to the node that its own label names, and then jumps to its label's
    label; the number of rounds grows with the logarithm of the longest path.
    Rounds are stored tables; a count of changes is all that comes back. Null
    ids are left out; no links give an empty result.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = stage_table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                        "edges")
    labels = stage_table(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("label").alias("near"))
        seen = stage_table(labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "seen")
        passed = seen.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("passed"))
        hooked = stage_table(seen.join(passed, "node", "left").select(
            "node", "old", F.least("label", "passed").alias("label")), "hooked")
        roots = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = stage_table(hooked.join(roots, "label").select(
            "node", F.col("root").alias("label"), (F.col("root") != F.col("old")).alias("moved")), "labels")
        if not labels.filter("moved").limit(1).count():
            return labels.select("node", "label")
