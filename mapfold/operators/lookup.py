"""Lookups: the nearest object to a click, and an object's geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from . import grid
from .raster import Viewport

#: Ranks of kinds at equal distance: a point beats a line.
POINT_RANK, LINE_RANK = 0, 1


def near_points(points: DataFrame, x: float, y: float, rad: float) -> DataFrame:
    """(row_id, d, hit_x, hit_y, kind_rank) of points in the click square and nearer than rad; dx, dy are used if there."""
    px, py = (F.col("dx"), F.col("dy")) if "dx" in points.columns else (F.col("x"), F.col("y"))
    inside = px.between(x - rad, x + rad) & py.between(y - rad, y + rad)
    d = geometry.distance(px, py, F.lit(float(x)), F.lit(float(y)))
    return points.where(inside).select("row_id", d.alias("d"), px.alias("hit_x"), py.alias("hit_y"), F.lit(POINT_RANK).alias("kind_rank")).where(F.col("d") < rad)


def line_click(kind: Column, coords: Column, x: Column, y: Column, rad: float) -> Column:
    """struct<d, x, y>: how far a line or ring is from a click, and where it is hit. Inside an area it is a quarter of rad, however near its border is, and hits the click itself."""
    inside = F.coalesce((kind == "AREA") & geometry.contains(coords, x, y), F.lit(False))
    foot = geometry.project_on(x, y, coords)
    edge = F.when(foot["d"] < geometry.TOUCH, F.lit(0.0)).otherwise(foot["d"])
    return F.when(inside, F.struct(F.lit(rad / 4).alias("d"), x.alias("x"), y.alias("y"))).otherwise(F.struct(edge.alias("d"), foot["x"].alias("x"), foot["y"].alias("y")))


def near_lines(lines: DataFrame, x: float, y: float, rad: float) -> DataFrame:
    """The same of lines and areas, by line_click()."""
    near = lines.where((F.col("minx") <= x + rad) & (F.col("maxx") >= x - rad) & (F.col("miny") <= y + rad) & (F.col("maxy") >= y - rad))
    hit = near.select("row_id", line_click(F.col("kind"), F.col("coords"), F.lit(float(x)), F.lit(float(y)), rad).alias("h"))
    return hit.select("row_id", F.col("h.d").alias("d"), F.col("h.x").alias("hit_x"), F.col("h.y").alias("hit_y"), F.lit(LINE_RANK).alias("kind_rank")).where(F.col("d") < rad)


def nearest(points: DataFrame, lines: DataFrame, x: float, y: float, rad: float, k: int = 1) -> DataFrame:
    """The k nearest objects; ties go to points, then to the smaller row."""
    found = near_points(points, x, y, rad).unionByName(near_lines(lines, x, y, rad))
    return found.orderBy("d", "kind_rank", "row_id").limit(k)


def nearest_of_many(clicks: DataFrame, points: DataFrame, ox: float, oy: float) -> DataFrame:
    """(click, row_id, d): nearest point of each click (click, x, y, rad), ties to the smaller row; clicks without a point in reach have no row.

    Equal clicks are looked up once. Points in the click's square are found by grid keys, and one aggregation takes the nearest.
    """
    sites = clicks.select(F.struct("x", "y", "rad").alias("site")).distinct()
    boxes = sites.select("site", *[(F.col(f"site.{a}") + s * F.col("site.rad")).alias(f"{m}{a}") for m, s in (("min", -1), ("max", 1)) for a in "xy"])
    found = grid.join_boxes(points.select("row_id", "x", "y"), boxes, "site", ox, oy)
    found = found.withColumn("d", geometry.distance(F.col("x"), F.col("y"), F.col("site.x"), F.col("site.y"))).where(F.col("d") < F.col("site.rad"))
    best = found.groupBy("site").agg(F.min(F.struct("d", "row_id")).alias("b"))
    return clicks.select("click", F.struct("x", "y", "rad").alias("site")).join(best, "site").select("click", "b.row_id", "b.d")


def visible_points(displaced: DataFrame, view: Viewport) -> DataFrame:
    """Candidates of a click while spirals are shown: all whose base is in view."""
    return displaced.where(view.holds(F.col("x"), F.col("y")))


def geometry_of(objects: DataFrame, row_id: int, rad: float) -> DataFrame:
    """(part_idx, kind, hole, ring, poly, member, type, coords) of one row, lines and rings simplified by a tenth of rad."""
    return geometries_of(objects.where(F.col("row_id") == row_id), rad).drop("row_id")


def geometries_of(objects: DataFrame, rad: float) -> DataFrame:
    """(row_id, part_idx, kind, hole, ring, poly, member, type, coords) of all objects, lines and rings simplified by a tenth of rad."""
    parts = objects.where(F.col("kind") != "NONE")
    lines = F.when(F.col("kind") != "POINT", F.col("coords"))
    simple = geometry.by_weights(F.col("coords"), F.col("weights"), rad / 10) if "weights" in objects.columns else F.coalesce(geometry.simplify(lines, rad / 10), F.col("coords"))
    return parts.select("row_id", "part_idx", "kind", "hole", "ring", "poly", "member", "type", simple.alias("coords"))


def argmin(df: DataFrame, by: Column, ident: str) -> DataFrame:
    """The one row of smallest value, ties to the smaller id; rows without a value take no part, and without any row both are null."""
    return df.select(by.alias("d"), F.col(ident).alias("id")).where("d is not null").select(F.min(F.struct("d", "id")).alias("b")).select("b.id", "b.d")
