"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's (large: larger; small: smaller) neighbours are linked to its smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        out = both.join(least, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("low"))
        hooked = down.join(least, "src").where(F.col("dst") > F.col("low")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        out = hooked.unionByName(least.select("src", F.col("low").alias("dst")))
    return out.where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link: root is the smallest node that can be reached from it.

    edges: (src, dst), any direction, repeats allowed. Sums and minima are taken before rows are shuffled, and no
    step lists a node's neighbours, so a hub costs no more than its links. Each round is written to the shared
    folder; it ends when a round leaves the links as they were, which the logarithm of the longest chain bounds.
    """
    now = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "links")
    sums = None
    while True:
        then = materialize(_star(_star(now, True), False), "links")
        found = then.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.count_if(F.col("src") < F.col("dst"))).first()
        discard(now)
        now = then
        if tuple(found) == sums:
            break
        sums = tuple(found)
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
