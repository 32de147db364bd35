"""Equal points as clusters: each member knows its number and the cluster's size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry


def cluster(points: DataFrame, by: Sequence[str] = ("geom_id",), order: str = "row_id", span: int = 1_000_000) -> DataFrame:
    """Points with cl_num, from 0 in the order of a whole-numbered column, and cl_tot.

    One site may hold a great part of all points, so members are numbered in parts of a site, ranges of `span`
    numbers: a part's first number is the sum of the sizes of the parts before it.
    """
    parts = points.withColumn("_part", F.floor(F.col(order) / F.lit(span)))
    sizes = parts.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    site = Window.partitionBy(*by)
    before = site.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(site).alias("cl_tot"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order)) - 1
    return parts.withColumn("_k", inside).join(sizes, [*by, "_part"]).withColumn("cl_num", F.col("_first") + F.col("_k")).drop("_part", "_first", "_k")


def displaced(clusters: DataFrame, res: Column | float) -> DataFrame:
    """Clusters with dx and dy, where each member is drawn at resolution res."""
    res = res if isinstance(res, Column) else F.lit(float(res))
    dx, dy = geometry.spiral(F.col("x"), F.col("y"), F.col("cl_num"), F.col("cl_tot"), res)
    return clusters.withColumns({"dx": dx, "dy": dy})
