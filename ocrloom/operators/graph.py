"""Connected components of a link table, for links between long keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import cut_lineage, hot_keys, looked_up


def connected(nodes: DataFrame, links: DataFrame, by: tuple[str, ...] = ("g",)) -> DataFrame:
    """nodes (g, id) with label, the least id that links (g, a, b) reach within the group g; by () has no groups.

    Rounds of two lookups: the least label among a node's neighbours, then the label of the label, until none moves. A hub
    and a label that many nodes have are hot keys, whose rows aren't brought together; minima have partial ones before.
    Without groups keys are single numbers, of which broadcasts take far less memory than of pairs.
    """
    both = links.select(*by, "a", "b").unionByName(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    hubs = hot_keys(both, [*by, "b"])
    # the first round needs no lookup: every node's label is its own
    near = both.groupBy(*by, F.col("a").alias("id")).agg(F.min("b").alias("near"))
    labels = cut_lineage(nodes.select(*by, "id").join(near, [*by, "id"], "left").select(*by, "id", F.least("id", F.coalesce("near", "id")).alias("label")))
    while True:
        seen = looked_up(both, labels.select(*by, F.col("id").alias("b"), "label"), [*by, "b"], hubs)
        near = seen.groupBy(*by, F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = cut_lineage(labels.join(near, [*by, "id"], "left").select(*by, "id", "label", F.least("label", F.coalesce("near", "label")).alias("to")))
        if moved.where("to <> label").isEmpty():
            return labels
        over = moved.select(*by, F.col("id").alias("to"), F.col("to").alias("over"))
        labels = cut_lineage(looked_up(moved, over, [*by, "to"]).select(*by, "id", F.col("over").alias("label")))
