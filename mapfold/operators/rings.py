"""Polygons from rings without order: which rings are shells, and whose holes the others are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from . import grid


def assemble(rings: DataFrame, ident: str = "ring_id", ox: float = 0.0, oy: float = 0.0) -> DataFrame:
    """rings (row_id, ident, coords, minx, miny, maxx, maxy) with poly, ring and hole; rings of a row may nest, and touch at vertices.

    The rings of a row form a forest: a ring lies in another if the middle of its first edge does. One that lies in an even number of
    others is a shell, in an odd number a hole of the smallest ring around it. Polygons of a row are numbered by their shells' idents,
    rings of a polygon from the shell (0) on by theirs. ox, oy: the grid's origin, on no ring's far side. Rings are paired by grid cells,
    so the pairs grow with how deep rings nest, not with the square of a row's rings.
    """
    known = rings.withColumn("_area", geometry.ring_area(F.col("coords")))
    first, second = F.get("coords", 0), F.get("coords", 1)
    middle = known.select("row_id", F.col(ident).alias("_own"), F.col("_area").alias("_own_area"), *[((first[a] + F.coalesce(second[a], first[a])) / 2).alias(a) for a in "xy"])
    pairs = grid.join_boxes(middle, known.select("row_id", F.col(ident).alias("_around"), "minx", "miny", "maxx", "maxy"), "_around", ox, oy, by=["row_id"]).where("_own <> _around")
    around = known.select("row_id", F.col(ident).alias("_around"), "_area", F.col("coords").alias("_coords"))
    pairs = pairs.select("row_id", "_own", "_own_area", "_around", "x", "y").join(around, ["row_id", "_around"])
    larger = (F.col("_area") > F.col("_own_area")) | ((F.col("_area") == F.col("_own_area")) & (F.col("_around") < F.col("_own")))  # equal rings lie in the first
    pairs = pairs.where(larger & geometry.contains(F.col("_coords"), F.col("x"), F.col("y")))
    depth = pairs.groupBy("row_id", F.col("_own").alias(ident)).agg(F.count(F.lit(1)).alias("_depth"), F.min(F.struct("_area", (-F.col("_around")).alias("_minus"))).alias("_parent"))
    placed = known.join(depth, ["row_id", ident], "left").withColumn("hole", F.coalesce(F.col("_depth") % 2 == 1, F.lit(False)))
    placed = placed.withColumn("_shell", F.when(F.col("hole"), -F.col("_parent._minus")).otherwise(F.col(ident)))
    placed = placed.withColumn("poly", F.dense_rank().over(Window.partitionBy("row_id").orderBy("_shell")) - 1)
    placed = placed.withColumn("ring", F.row_number().over(Window.partitionBy("row_id", "poly").orderBy("hole", ident)) - 1)
    return placed.select(*[f"`{c}`" for c in rings.columns if c not in ("poly", "ring", "hole")], "poly", "ring", "hole")


def as_components(assembled: DataFrame) -> DataFrame:
    """Rings with poly, ring and hole as components of their rows' areas: kind, part_idx, member and type beside them."""
    order = F.row_number().over(Window.partitionBy("row_id").orderBy("poly", "ring")) - 1
    several = F.max("poly").over(Window.partitionBy("row_id")) > 0
    return assembled.withColumns({"kind": F.lit("AREA"), "part_idx": order, "member": F.lit(0), "type": F.when(several, "MULTIPOLYGON").otherwise("POLYGON")})
