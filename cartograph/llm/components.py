"""Connected components of a link table, as joins and aggregates.

Alternating large and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014): every node links its neighbours to the smallest node it knows. The rounds grow with the
logarithm of the longest chain; each is written to the shared folder, so a lost executor costs no
more than one round, and joins on a hub node are between two plain shuffles, which AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.session import Staged, stage


def _star(links: DataFrame, small: bool) -> DataFrame:
    """(node, low) with node > low: each node's neighbours linked to the smallest one.

    ``links`` has every link once, from the larger node to the smaller.
    """
    back = links.select(F.col("low").alias("node"), F.col("node").alias("low"))
    # A small star looks at smaller neighbours only; a large star moves the larger ones.
    around = links if small else links.unionByName(back)
    centre = stage(
        around.groupBy(F.col("node").alias("centre")).agg(
            F.least(F.col("node"), F.min("low")).alias("least")
        ),
        "centre",
    ).df
    moved = (links if small else back).join(centre, F.col("node") == F.col("centre"))
    out = moved.select(F.col("low").alias("node"), F.col("least").alias("low"))
    if small:
        out = out.unionByName(centre.select(F.col("centre").alias("node"), F.col("least").alias("low")))
    return out.where("node > low").distinct()


def _staged(links: DataFrame) -> Staged:
    return stage(links, "links", mark=F.sum(F.xxhash64("node", "low").cast("decimal(38,0)")))


def components(links: DataFrame) -> DataFrame:
    """(node, low): every node that is not the smallest of its component, with the smallest.

    ``links`` has two columns of one orderable type; direction, repeats and loops don't matter.
    """
    a, b = links.columns
    ordered = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("low"))
    current = _staged(ordered.where("node > low").distinct())
    while current.rows:
        done = current
        current = _staged(_star(stage(_star(current.df, small=False), "large").df, small=True))
        if (current.rows, current.metrics["mark"]) == (done.rows, done.metrics["mark"]):
            break
    return current.df
