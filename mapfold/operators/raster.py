"""Rasters: objects to weighted pixels at three levels of detail, and pixels to colours.

A viewport's resolution picks the plan. Under 200 units a pixel objects are drawn exactly; above, points go by
object and lines by sub-cell; from 26214.4 on, where a cell is one pixel or less, whole cells are drawn at their
lower left corner. Every raster is a table (px, py, weight), summed with partial sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from . import grid

#: Fixed limits of the levels of detail.
EXACT_UNDER, CELL_PIXEL = 200.0, 2.5
#: Fixed colours: objects, and the stops of the heat ramp from weak to strong.
OBJECT_RGB = (51, 136, 255)
HEAT_STOPS = ((94, 79, 162), (50, 136, 189), (102, 194, 165), (171, 221, 164), (230, 245, 152), (254, 224, 139), (253, 174, 97), (244, 109, 67), (213, 62, 79), (158, 1, 66))


@dataclass(frozen=True)
class Viewport:
    """A box in Mercator units on width x height pixels."""

    x1: float
    y1: float
    x2: float
    y2: float
    width: int
    height: int

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0 or self.x2 <= self.x1 or self.y2 <= self.y1:
            raise ValueError("a viewport needs positive extents")

    @classmethod
    def parse(cls, bbox: str, width: int | str, height: int | str) -> Viewport:
        parts = bbox.split(",")
        if len(parts) != 4:
            raise ValueError("bbox needs four numbers")
        return cls(*map(float, parts), int(width), int(height))

    @property
    def resolution(self) -> float:
        return (self.y2 - self.y1) / self.height

    @property
    def level(self) -> str:
        """exact, grid or cell."""
        if self.resolution < EXACT_UNDER:
            return "exact"
        return "cell" if math.ceil(grid.CELL / (CELL_PIXEL * self.resolution)) == 1 else "grid"

    def holds(self, x: Column, y: Column) -> Column:
        return x.between(self.x1, self.x2) & y.between(self.y1, self.y2)

    def meets(self, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
        return (minx <= self.x2) & (maxx >= self.x1) & (miny <= self.y2) & (maxy >= self.y1)

    def pixels(self, df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """df with px and py, cut off to whole pixels; what falls off the raster goes."""
        fx = (F.col(x) - self.x1) / F.lit(self.x2 - self.x1) * F.lit(float(self.width))
        fy = F.lit(float(self.height)) - (F.col(y) - self.y1) / F.lit(self.y2 - self.y1) * F.lit(float(self.height))
        out = df.withColumns({"_fx": fx, "_fy": fy}).where(F.col("_fx").between(-1, self.width + 1) & F.col("_fy").between(-1, self.height + 1))
        out = out.withColumns({"px": F.col("_fx").cast("int"), "py": F.col("_fy").cast("int")}).drop("_fx", "_fy")
        return out.where((F.col("px") >= 0) & (F.col("px") < self.width) & (F.col("py") >= 0) & (F.col("py") < self.height))


def weigh(pixels: DataFrame, n: Column | None = None) -> DataFrame:
    """(px, py, weight): counts, or sums of n."""
    return pixels.groupBy("px", "py").agg((F.count(F.lit(1)) if n is None else F.sum(n)).cast("double").alias("weight"))


def points_exact(points: DataFrame, view: Viewport) -> DataFrame:
    """Points inside the view; cluster members at their base."""
    return weigh(view.pixels(points.where(view.holds(F.col("x"), F.col("y")))))


def cells_in_view(df: DataFrame, view: Viewport, ox: float, oy: float) -> DataFrame:
    """Rows (cell_x, cell_y) whose cell the view covers: literal bounds, no join."""
    bound = lambda v, o: max(0, math.floor((v - o) / grid.CELL))
    return df.where(F.col("cell_x").between(bound(view.x1, ox), bound(view.x2, ox)) & F.col("cell_y").between(bound(view.y1, oy), bound(view.y2, oy)))


def points_by_grid(points: DataFrame, view: Viewport, ox: float, oy: float) -> DataFrame:
    """Points of all cells in view, each by itself."""
    return weigh(view.pixels(cells_in_view(grid.with_cells(points, ox, oy), view, ox, oy)))


def points_by_cell(points: DataFrame, view: Viewport, ox: float, oy: float) -> DataFrame:
    """Cells in view, each at its lower left corner with its number of points."""
    return cells_at_corners(grid.count_cells(points, ox, oy), view, ox, oy)


def cells_at_corners(counted: DataFrame, view: Viewport, ox: float, oy: float) -> DataFrame:
    cells = cells_in_view(counted, view, ox, oy)
    corners = cells.withColumns({"x": grid.cell_start(F.col("cell_x"), ox), "y": grid.cell_start(F.col("cell_y"), oy)})
    return weigh(view.pixels(corners), F.col("n"))


def lines_exact(lines: DataFrame, view: Viewport) -> DataFrame:
    """Outlines of the lines with a segment in view, with vertices a pixel apart; of a line, only what lies around the view is made."""
    near = lines.where(view.meets(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
    meets = lambda s: geometry.segment_meets_box(s, view.x1, view.y1, view.x2, view.y2)
    seen = near.where(F.exists(geometry.segments(F.col("coords")), meets))
    wide, high = 2 * (view.x2 - view.x1) / view.width, 2 * view.resolution  # two pixels around
    dense = geometry.densify_within(F.col("coords"), view.resolution, view.x1 - wide, view.y1 - high, view.x2 + wide, view.y2 + high)
    dense = seen.select(F.explode(dense).alias("c")).select("c.x", "c.y")
    return weigh(view.pixels(dense))


def lines_by_sub_cell(sub_cells: DataFrame, view: Viewport, ox: float, oy: float) -> DataFrame:
    """Sub-cells (cell_x, cell_y, sub_x, sub_y, n) in view, at their lower left corners."""
    cells = cells_in_view(sub_cells, view, ox, oy)
    at = lambda a, o: grid.cell_start(F.col(f"cell_{a}"), o) + F.col(f"sub_{a}") * F.lit(grid.SUB)
    return weigh(view.pixels(cells.withColumns({"x": at("x", ox), "y": at("y", oy)})), F.col("n"))


def lines_by_cell(sub_cells: DataFrame, view: Viewport, ox: float, oy: float) -> DataFrame:
    cells = cells_in_view(sub_cells, view, ox, oy).groupBy("cell_x", "cell_y").agg(F.sum("n").alias("n"))
    return weigh(view.pixels(cells.withColumns({"x": grid.cell_start(F.col("cell_x"), ox), "y": grid.cell_start(F.col("cell_y"), oy)})), F.col("n"))


def merge(*rasters: DataFrame) -> DataFrame:
    """Weights are additive: the sum of rasters."""
    out = rasters[0]
    for r in rasters[1:]:
        out = out.unionByName(r)
    return out.groupBy("px", "py").agg(F.sum("weight").alias("weight"))


def squares(raster: DataFrame, view: Viewport) -> DataFrame:
    """Points as objects: squares of 4 x 4 pixels, from two before to one after; each pixel once."""
    out = raster.select("px", "py")
    for a in ("x", "y"):
        out = out.withColumn(f"p{a}", F.explode(F.sequence(F.col(f"p{a}") - 2, F.col(f"p{a}") + 1)))
    return out.where((F.col("px") >= 0) & (F.col("px") < view.width) & (F.col("py") >= 0) & (F.col("py") < view.height)).distinct().withColumn("weight", F.lit(1.0))


def clusters_as_objects(displaced: DataFrame, view: Viewport) -> DataFrame:
    """Squares of displaced members whose base is in view."""
    seen = displaced.where(view.holds(F.col("x"), F.col("y"))).drop("x", "y")
    return squares(view.pixels(seen, "dx", "dy").select("px", "py").distinct(), view)


def leaders(displaced: DataFrame, view: Viewport) -> DataFrame:
    """Pixels of the lines from bases to displaced members, one step along the longer axis each."""
    seen = displaced.where(view.holds(F.col("x"), F.col("y")) & (F.col("cl_tot") > 1))
    unit_x, unit_y = view.width / (view.x2 - view.x1), view.height / (view.y2 - view.y1)
    ends = seen.select(*[((F.col(c) - view.x1) * F.lit(unit_x)).alias(f"{c}_") for c in ("x", "dx")], *[(F.lit(float(view.height)) - (F.col(c) - view.y1) * F.lit(unit_y)).alias(f"{c}_") for c in ("y", "dy")])
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("dx_") - F.col("x_")), F.abs(F.col("dy_") - F.col("y_"))))).cast("int")
    step = ends.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a: F.floor(F.col(f"{a}_") + (F.col(f"d{a}_") - F.col(f"{a}_")) * F.col("k") / F.col("n")).cast("int").alias(f"p{a}")
    return step.select(at("x"), at("y")).where((F.col("px") >= 0) & (F.col("px") < view.width) & (F.col("py") >= 0) & (F.col("py") < view.height)).distinct()


def stamp(raster: DataFrame, view: Viewport, radius: int = 3) -> DataFrame:
    """Each pixel's weight spread over a disc that falls off linearly; the disc is a literal of fixed size."""
    disc = [(x, y, 1 - math.hypot(x, y) / (radius + 1)) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if math.hypot(x, y) <= radius]
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w")) for x, y, w in disc])
    spread = raster.select("px", "py", "weight", F.explode(cells).alias("s"))
    spread = spread.select((F.col("px") + F.col("s.x")).alias("px"), (F.col("py") + F.col("s.y")).alias("py"), (F.col("weight") * F.col("s.w")).alias("weight"))
    spread = spread.where((F.col("px") >= 0) & (F.col("px") < view.width) & (F.col("py") >= 0) & (F.col("py") < view.height))
    return spread.groupBy("px", "py").agg(F.sum("weight").alias("weight"))


def normalise(raster: DataFrame) -> DataFrame:
    """Weights by the greatest: one aggregate row joins back as a scalar."""
    most = raster.agg(F.max("weight").alias("most"))
    return raster.join(F.broadcast(most)).select("px", "py", F.try_divide("weight", "most").alias("share"))


def colour_heat(shares: DataFrame) -> DataFrame:
    """(px, py, r, g, b, a): the heat ramp's colour of a share in (0, 1]."""
    stop = F.least(F.lit(len(HEAT_STOPS) - 1), F.floor(F.col("share") * len(HEAT_STOPS))).cast("int")
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("rgb", rgb, strict=True)]) for rgb in HEAT_STOPS])
    return shares.where("share > 0").withColumn("c", F.get(table, stop)).select("px", "py", "c.r", "c.g", "c.b", F.lit(255).alias("a"))


def colour_objects(raster: DataFrame) -> DataFrame:
    """(px, py, r, g, b, a): one colour, as opaque as the weight, saturated at 1, in ten steps."""
    alpha = F.round(F.ceil(F.least(F.lit(1.0), "weight") * 10) / 10 * 255).cast("int")
    return raster.where("weight > 0").select("px", "py", *[F.lit(v).alias(c) for c, v in zip("rgb", OBJECT_RGB, strict=True)], alpha.alias("a"))


def levels_of(objects: DataFrame, ox: float, oy: float) -> dict[str, DataFrame]:
    """What maps above the exact level draw, whatever the view; each level adds up to the next.

    spots: (cell_x, cell_y, x, y, n), points of one place. cells: (cell_x, cell_y, n), points of a cell. subs: (cell_x, cell_y, sub_x,
    sub_y, n), vertices of lines and areas by sub-cell. line_cells: (cell_x, cell_y, n), the same by cell.
    """
    points, lines = objects.where("kind = 'POINT'"), objects.where("kind in ('LINE', 'AREA')").select(F.col("row_id").alias("obj"), "coords")
    spots = grid.with_cells(points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), ox, oy).select("cell_x", "cell_y", "x", "y", "n")
    return {"spots": spots, "subs": grid.vertex_histogram(grid.line_sub_cells_of(lines, ox, oy)), **coarser(spots, None)}


def coarser(spots: DataFrame | None, subs: DataFrame | None) -> dict[str, DataFrame]:
    """cells of spots and line_cells of subs."""
    by_cell = lambda df: df.groupBy("cell_x", "cell_y").agg(F.sum("n").alias("n"))
    return {name: by_cell(df) for name, df in (("cells", spots), ("line_cells", subs)) if df is not None}


def heatmap(objects: DataFrame, view: Viewport, ox: float, oy: float, levels: dict[str, DataFrame] | None = None) -> DataFrame:
    """The weights of all objects in view, at the view's level of detail; levels: levels_of(), where they are kept: then no map but an exact one reads objects."""
    if view.level == "exact":
        return merge(points_exact(objects.where("kind = 'POINT'"), view), lines_exact(objects.where("kind in ('LINE', 'AREA')"), view))
    levels = levels or levels_of(objects, ox, oy)
    if view.level == "grid":
        return merge(weigh(view.pixels(cells_in_view(levels["spots"], view, ox, oy)), F.col("n")), lines_by_sub_cell(levels["subs"], view, ox, oy))
    line_cells = levels.get("line_cells", levels["subs"])
    return merge(cells_at_corners(levels["cells"], view, ox, oy), lines_by_cell(line_cells, view, ox, oy))
