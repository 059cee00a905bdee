"""Connected components of a link table, by repeated lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from .common import cut


def components(links: DataFrame) -> DataFrame:
    """id, label of every node of links (a, b): label is the smallest id reachable from it.

    A node of any number of links, and a label of any number of nodes, is no task's own: connected() looks up hot keys by
    broadcasts of a bounded number of rows. An empty table of links gives no rows.
    """
    both = cut(links.select("a", "b"))
    nodes = both.select(F.col("a").alias("id")).unionByName(both.select(F.col("b").alias("id"))).distinct()
    return connected(nodes, both, ()).select("id", "label")
