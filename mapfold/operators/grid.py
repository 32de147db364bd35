"""Grid keys as columns to join and group by: uniform cells of 65536 Mercator units and sub-cells of 256; levels of cells for joins.

A join of points or boxes with boxes is an equi-join on cells, with the exact test after it. Each box is keyed at the level of
its own extent, where it covers at most three cells a side, so neither small nor large boxes bring many cells or candidates. A cell
that holds more points than a task should is split: a quadtree over a sample of its points gives it leaves of like
numbers, points go to their leaf and boxes to the leaves they meet. Leaves of one place, which no tree splits, are split by a hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed sizes of a cell and a sub-cell.
CELL, SUB = 65536.0, 256.0
#: Side of a cell of level 0; that of each further level is twice as long.
FINEST = 256.0
#: Points of a cell above which it is split, if it also holds more than one in MOST_SPLIT of all points: so many cells are split at most a level.
HOT, MOST_SPLIT = 50_000, 4096
#: Rows of a list of those in a box, or of boxes that are equal.
LISTED = 2048
#: Equal boxes whose pairs with a list of rows are made at once.
FEW = 16
#: Pairs of a task, about: so none is long, whatever the number of partitions in the session.
MADE = 1 << 25
#: Points sampled for all quadtrees together, and their depth.
SAMPLED, DEPTH = 100_000, 5


def _number(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def cell(v: Column, origin: Column | float, size: Column | float = CELL) -> Column:
    """Number of the cell from the grid's origin; what lies before it falls into cell 0."""
    return F.greatest(F.lit(0), F.floor((v - _number(origin)) / _number(size))).cast("int")


def cell_start(c: Column, origin: Column | float, size: Column | float = CELL) -> Column:
    return _number(origin) + c * _number(size)


def sub_cell(v: Column, origin: Column | float) -> Column:
    """Number of the sub-cell inside the cell, 0 to 255."""
    return F.floor((v - cell_start(cell(v, origin), origin)) / F.lit(SUB)).cast("int")


def morton(x: Column, y: Column, low: float = -20037508.342789244, side: float = 40075016.685578488) -> Column:
    """A place's number along a Z-shaped curve through 2^20 x 2^20 cells: places whose numbers are near lie near each other, mostly. Null has none."""

    def bits(v: Column) -> Column:
        v = F.when(v.isNotNull(), F.least(F.lit((1 << 20) - 1), F.greatest(F.lit(0), F.floor((v - F.lit(low)) / F.lit(side / (1 << 20)))))).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return bits(x).bitwiseOR(F.shiftleft(bits(y), 1))


def with_cells(points: DataFrame, ox: float, oy: float) -> DataFrame:
    return points.withColumns({"cell_x": cell(F.col("x"), ox), "cell_y": cell(F.col("y"), oy)})


def covered(boxes: DataFrame, ox: float, oy: float, size: Column | float = CELL) -> DataFrame:
    """A row for each cell that a row's box (minx, miny, maxx, maxy) covers."""
    for axis, origin in (("x", ox), ("y", oy)):
        boxes = boxes.withColumn(f"cell_{axis}", F.explode(F.sequence(cell(F.col(f"min{axis}"), origin, size), cell(F.col(f"max{axis}"), origin, size))))
    return boxes


def count_cells(points: DataFrame, ox: float, oy: float) -> DataFrame:
    """(cell_x, cell_y, n)."""
    return with_cells(points, ox, oy).groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"))


def level_of(box: dict[str, Column] | None = None) -> Column:
    """The level of a box: its longer side is less than two cells long there, if it is longer than a cell of level 0."""
    c = box or {n: F.col(n) for n in ("minx", "miny", "maxx", "maxy")}
    longest = F.greatest(c["maxx"] - c["minx"], c["maxy"] - c["miny"], F.lit(FINEST))
    return F.floor(F.log2(longest / F.lit(FINEST))).cast("int")


def level_size(level: Column) -> Column:
    return F.lit(FINEST) * F.pow(F.lit(2.0), level)


def _levels(boxes: DataFrame) -> list[int]:
    """The levels there are: a few dozen at most, by the bits of a coordinate's exponent."""
    return sorted(r[0] for r in boxes.select("level").distinct().collect() if r[0] is not None)


def _at_levels(levels: list[int], own: Column | None = None) -> Column:
    """A row for each of the levels; with an own level, for that and for those above it."""
    every = F.array(*map(F.lit, levels)).cast("array<int>")
    return F.explode(every if own is None else F.array_distinct(F.concat(F.array(own), F.filter(every, lambda x: x > own))))


def quadtree(x: np.ndarray, y: np.ndarray, limit: float, depth: int = DEPTH) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """A tree over points of the unit square: squares with more than `limit` of them are split, down to a depth.

    Gives the leaf of each square of the last depth, by rows, and the leaves as (depth, column, row, points).
    """
    side = 1 << depth
    of, leaves = np.zeros((side, side), np.int32), []
    bx, by = (np.clip((v * side).astype(np.int64), 0, side - 1) for v in (x, y))
    todo = [(0, 0, 0, np.arange(len(x)))]
    while todo:
        d, i, j, held = todo.pop()
        if len(held) <= limit or d == depth:
            w = side >> d
            of[j * w : (j + 1) * w, i * w : (i + 1) * w] = len(leaves)
            leaves.append((d, i, j, len(held)))
            continue
        right, up = bx[held] >> (depth - d - 1) & 1, by[held] >> (depth - d - 1) & 1
        todo += [(d + 1, 2 * i + r, 2 * j + u, held[(right == r) & (up == u)]) for r in (0, 1) for u in (0, 1)]
    return of.ravel(), leaves


def splits_of(keyed: DataFrame, ox: float, oy: float, hot: int = HOT) -> DataFrame | None:
    """(level, cell_x, cell_y, of, leaves) of the cells with more than `hot` of the points (level, cell_x, cell_y, x, y); None if there are none.

    The driver sees the cells to be split, at most MOST_SPLIT a level, and at most about SAMPLED points.
    """
    key = ["level", "cell_x", "cell_y"]
    counts = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("level"))  # a row for each cell, and a key for each of a few levels: only sums are made of them
    high = counts.withColumn("of", total).where((F.col("n") > hot) & (F.col("n") > F.col("of") / MOST_SPLIT)).collect() if counts.where(F.col("n") > hot).take(1) else []
    if not high:
        return None
    spark, of = keyed.sparkSession, {(r["level"], r["cell_x"], r["cell_y"]): r["n"] for r in high}
    cells = F.broadcast(spark.createDataFrame([(*k, n) for k, n in of.items()], "level int, cell_x int, cell_y int, n long"))
    part = min(1.0, SAMPLED / sum(of.values()))
    size = level_size(F.col("level"))
    place = lambda a, o: ((F.col(a) - cell_start(F.col(f"cell_{a}"), o, size)) / size).alias(a)
    sample = keyed.join(cells, key).sample(part, 5).select(*key, place("x", ox), place("y", oy)).toPandas()
    rows, inf = [], float("inf")
    for k, own in sample.groupby(key):
        level, cx, cy = k = tuple(map(int, k))
        side, rate = FINEST * 2.0**level, of[k] / len(own)
        slack = side * 1e-6  # for rounding at the edges; cell 0 holds what lies before the grid
        table, leaves = quadtree(own["x"].to_numpy(), own["y"].to_numpy(), max(1.0, hot / rate))
        made = []
        for d, i, j, n in leaves:
            w = side / (1 << d)
            x1, y1 = ox + cx * side + i * w, oy + cy * side + j * w
            salts = max(1, math.ceil(n * rate / hot)) if d == DEPTH else 1
            made.append((x1 - slack if cx or i else -inf, y1 - slack if cy or j else -inf, x1 + w + slack, y1 + w + slack, salts))
        rows.append((*k, table.tolist(), made))
    return F.broadcast(spark.createDataFrame(rows, "level int, cell_x int, cell_y int, of array<int>, leaves array<struct<minx:double,miny:double,maxx:double,maxy:double,salts:int>>")) if rows else None


def join_boxes(points: DataFrame, boxes: DataFrame, ident: str, ox: float, oy: float, hot: int = HOT, by: Sequence[str] = ()) -> DataFrame:
    """Points in boxes, for many boxes at once: (x, y and all columns of points, ident, minx, miny, maxx, maxy, cells of the box's level).

    by: columns of both that must be equal too; then no cell is split, as each holds the points of one value.
    """
    b = boxes.select(*by, ident, "minx", "miny", "maxx", "maxy").withColumn("level", level_of())
    levels, key = _levels(b), [*by, "level", "cell_x", "cell_y"]
    size = level_size(F.col("level"))
    p = points.withColumn("level", _at_levels(levels)).withColumns({f"cell_{a}": cell(F.col(a), o, size) for a, o in (("x", ox), ("y", oy))})
    b = covered(b, ox, oy, size)
    splits = splits_of(p, ox, oy, hot) if levels and not by else None
    if splits is not None:
        inner = lambda a, o: F.least(F.lit((1 << DEPTH) - 1), F.greatest(F.lit(0), F.floor((F.col(a) - cell_start(F.col(f"cell_{a}"), o, size)) / size * (1 << DEPTH)))).cast("int")
        p = p.join(splits, key, "left").withColumn("leaf", F.coalesce(F.get("of", inner("y", oy) * (1 << DEPTH) + inner("x", ox)), F.lit(-1)))
        salts = F.coalesce(F.get("leaves", F.greatest(F.col("leaf"), F.lit(0)))["salts"], F.lit(1))
        p = p.withColumn("salt", F.pmod(F.xxhash64(*points.columns), salts)).drop("of", "leaves")
        met = F.transform("leaves", lambda leaf, i: F.struct(i.alias("i"), leaf["salts"].alias("salts"), ((leaf["minx"] <= F.col("maxx")) & (leaf["maxx"] >= F.col("minx")) & (leaf["miny"] <= F.col("maxy")) & (leaf["maxy"] >= F.col("miny"))).alias("in")))
        each = F.flatten(F.transform(F.filter(met, lambda m: m["in"]), lambda m: F.transform(F.sequence(F.lit(0), m["salts"] - 1), lambda s: F.struct(m["i"].alias("leaf"), s.cast("long").alias("salt")))))
        whole = F.array(F.struct(F.lit(-1).alias("leaf"), F.lit(0).cast("long").alias("salt")))
        b = b.join(splits, key, "left").withColumn("_at", F.explode(F.when(F.col("of").isNotNull(), each).otherwise(whole)))
        b = b.select(*by, ident, "minx", "miny", "maxx", "maxy", *[c for c in key if c not in by], "_at.leaf", "_at.salt")
        key = [*key, "leaf", "salt"]
    inside = F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))
    return p.join(b, key).where(inside).drop("level", "leaf", "salt")


def box_pairs(points: DataFrame, boxes: DataFrame, row: str, ident: str, ox: float, oy: float) -> DataFrame:
    """(ident, row) of the points in boxes, neither of them null, for boxes of which many may be equal.

    Each distinct box is joined once. Its rows and the boxes equal to it are shuffled in lists of at most LISTED, and pairs are made only
    where two lists have met: so what is shuffled grows with the rows and not with the pairs, and a box or place that has very many is
    dealt out by its pairs of lists, over the more tasks the more pairs there are. For that, they are counted at once.
    """
    box, partitions = ["minx", "miny", "maxx", "maxy"], int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = boxes.groupBy(*box).agg(F.count(F.lit(1)).alias("_n")).withColumn("_site", F.struct(*box))
    held = join_boxes(points, same, "_site", ox, oy).select("_site", row)
    # lists are cut by hashes, so that no task collects all of a box
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) * 2 / LISTED)).cast("long")
    sizes = held.groupBy("_site").agg(F.count(row).alias("_m")).join(same.select("_site", "_n"), "_site")
    cut = sizes.select("_site", parts("_m").alias("_rows"), parts("_n").alias("_boxes"))
    partitions = max(partitions, math.ceil((sizes.agg(F.sum(F.col("_m").cast("double") * F.col("_n"))).first()[0] or 0) / MADE))

    def lists(df: DataFrame, c: str, n: str, part: str) -> DataFrame:
        return df.join(cut, "_site").groupBy("_site", F.pmod(F.xxhash64(c), n).alias(part)).agg(F.collect_list(c).alias(n))

    rows, equal = lists(held, row, "_rows", "_p"), lists(boxes.select(F.struct(*box).alias("_site"), ident), ident, "_boxes", "_q")
    met = rows.join(equal, "_site").repartition(partitions, "_site", "_p", "_q").where(F.size("_boxes") > 0)
    # A generated loop keeps what it makes of a row until the row is through: two whole lists would be millions of pairs. F.transform isn't
    # compiled, so few boxes at a time come to the loop over their pairs.
    few = F.transform(F.sequence(F.lit(0), F.floor((F.size("_boxes") - 1) / FEW).cast("int")), lambda i: F.slice("_boxes", i * FEW + 1, FEW))
    some = met.select(F.explode(few).alias("_few"), "_rows")
    return some.select(F.explode("_few").alias(ident), "_rows").select(ident, F.explode("_rows").alias(row))


def join_line_boxes(lines: DataFrame, boxes: DataFrame, ident: str, ox: float, oy: float) -> DataFrame:
    """(line, box) pairs whose boxes meet, once each.

    A pair meets at the higher of both levels, for which either side is also keyed at the other's levels above its own. There, a
    pair that shares several cells is kept in the first of them only, so no distinct is needed.
    """
    named = boxes.select(ident, *[F.col(f"{m}{c}").alias(f"b_{m}{c}") for m in ("min", "max") for c in "xy"])
    own = {f"{m}{c}": F.col(f"b_{m}{c}") for m in ("min", "max") for c in "xy"}
    a, b = lines.withColumn("level", level_of()), named.withColumn("level", level_of(own))
    a_levels, b_levels = _levels(a), _levels(b)
    size = level_size(F.col("level"))
    a = covered(a.withColumnRenamed("level", "a_level").withColumn("level", _at_levels(b_levels, F.col("a_level"))), ox, oy, size)
    b = b.withColumnRenamed("level", "b_level").withColumn("level", _at_levels(a_levels, F.col("b_level")))
    b = covered(b.withColumns(own), ox, oy, size).drop("minx", "miny", "maxx", "maxy")
    meets = (F.col("minx") <= F.col("b_maxx")) & (F.col("maxx") >= F.col("b_minx")) & (F.col("miny") <= F.col("b_maxy")) & (F.col("maxy") >= F.col("b_miny"))
    first = (F.col("cell_x") == cell(F.greatest("minx", "b_minx"), ox, size)) & (F.col("cell_y") == cell(F.greatest("miny", "b_miny"), oy, size))
    higher = F.col("level") == F.greatest("a_level", "b_level")
    return a.join(b, ["level", "cell_x", "cell_y"]).where(higher & meets & first).drop("level", "a_level", "b_level")


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The box two boxes share; inverted if they share none."""
    return {c: (F.greatest if c.startswith("min") else F.least)(a[c], b[c]) for c in ("minx", "miny", "maxx", "maxy")}


def line_sub_cells(vertices: DataFrame, ox: float, oy: float, order: str = "v") -> DataFrame:
    """Vertices (obj, v, x, y) with cells and sub-cells, without those in the sub-cell of the vertex before."""
    keyed = with_cells(vertices, ox, oy).withColumns({"sub_x": sub_cell(F.col("x"), ox), "sub_y": sub_cell(F.col("y"), oy)})
    place = F.struct("cell_x", "cell_y", "sub_x", "sub_y")
    before = F.lag(place).over(Window.partitionBy("obj").orderBy(order))
    return keyed.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != place)).drop("_before")


def line_sub_cells_of(lines: DataFrame, ox: float, oy: float, obj: str = "obj") -> DataFrame:
    """The same from a coords column, without shuffling vertices."""

    def place(c: Column) -> Column:
        return F.struct(cell(c["x"], ox).alias("cell_x"), cell(c["y"], oy).alias("cell_y"), sub_cell(c["x"], ox).alias("sub_x"), sub_cell(c["y"], oy).alias("sub_y"))

    placed = lines.withColumn("_p", F.transform("coords", place))
    kept = F.filter("_p", lambda p, i: (i == 0) | (p != F.get("_p", i - 1)))
    return placed.select(obj, F.explode(kept).alias("p")).select(obj, "p.*")


def vertex_histogram(sub_cells: DataFrame) -> DataFrame:
    """(cell_x, cell_y, sub_x, sub_y, n)."""
    return sub_cells.groupBy("cell_x", "cell_y", "sub_x", "sub_y").agg(F.count(F.lit(1)).alias("n"))
