"""Planar geometry on array<struct<x, y>> columns: built-in expressions, but for the weights that simplification filters by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Distances to lines under this are none.
TOUCH = 0.0001
#: Fixed values of the spiral: places of the first ring, and growth of each further one.
FIRST_RING, RING_GROWTH = 25, 6


def bbox(coords: Column) -> dict[str, Column]:
    axis = lambda f, a: f(F.transform(coords, lambda c: c[a]))
    return {"minx": axis(F.array_min, "x"), "miny": axis(F.array_min, "y"), "maxx": axis(F.array_max, "x"), "maxy": axis(F.array_max, "y")}


def segments(coords: Column) -> Column:
    """Neighbouring vertices as struct<ax, ay, bx, by>."""
    n = F.greatest(F.size(coords) - 1, F.lit(0))
    pair = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return F.zip_with(F.slice(coords, F.lit(1), n), F.slice(coords, F.lit(2), n), pair)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _foot(px: Column, py: Column, s: Column) -> tuple[Column, Column]:
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    t = F.coalesce(F.try_divide((px - s["ax"]) * dx + (py - s["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return s["ax"] + t * dx, s["ay"] + t * dy


def segment_distance(px: Column, py: Column, s: Column) -> Column:
    x, y = _foot(px, py, s)
    return distance(px, py, x, y)


def line_distance(px: Column, py: Column, coords: Column) -> Column:
    """Distance to the nearest segment, 0 if it touches."""
    d = F.array_min(F.transform(segments(coords), lambda s: segment_distance(px, py, s)))
    return F.when(d < TOUCH, F.lit(0.0)).otherwise(d)


def project_on(px: Column, py: Column, coords: Column) -> Column:
    """struct<d, x, y> of the nearest place on a line."""

    def at(s: Column) -> Column:
        x, y = _foot(px, py, s)
        return F.struct(distance(px, py, x, y).alias("d"), x.alias("x"), y.alias("y"))

    return F.array_min(F.transform(segments(coords), at))


def contains(coords: Column, px: Column, py: Column) -> Column:
    """Whether a closed ring holds the point, by the even-odd rule."""
    crosses = lambda s: ((s["ay"] > py) != (s["by"] > py)) & (px < (s["bx"] - s["ax"]) * F.try_divide(py - s["ay"], s["by"] - s["ay"]) + s["ax"])
    return F.size(F.filter(segments(coords), crosses)) % 2 == 1


def segment_meets_box(s: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Whether a segment and a closed box meet: their boxes do, and the corners aren't all on one side."""
    over = (F.least(s["ax"], s["bx"]) <= x2) & (F.greatest(s["ax"], s["bx"]) >= x1) & (F.least(s["ay"], s["by"]) <= y2) & (F.greatest(s["ay"], s["by"]) >= y1)
    side = lambda x, y: (s["bx"] - s["ax"]) * (F.lit(y) - s["ay"]) - (s["by"] - s["ay"]) * (F.lit(x) - s["ax"])
    sides = [side(x, y) for x in (x1, x2) for y in (y1, y2)]
    return over & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def densify(coords: Column, step: float) -> Column:
    """The line with vertices at most `step` apart: equal steps on each segment, its own vertices kept."""

    def along(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(distance(s["ax"], s["ay"], s["bx"], s["by"]) / F.lit(float(step)))).cast("int")
        at = lambda k: F.struct((s["ax"] + (s["bx"] - s["ax"]) * k / n).alias("x"), (s["ay"] + (s["by"] - s["ay"]) * k / n).alias("y"))
        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return F.concat(F.flatten(F.transform(segments(coords), along)), F.slice(coords, -1, 1))


def densify_within(coords: Column, step: float, x1: float, y1: float, x2: float, y2: float) -> Column:
    """The vertices of densify() along the parts of segments that lie in a box (and up to two more at either end).

    Each segment is clipped to the box first (Liang and Barsky, 1984), and the steps inside are counted from its start, so what is made
    grows with the box's size in steps, whatever the line's length. The line's last vertex always stays.
    """

    def inside(a: Column, b: Column, low: float, high: float) -> tuple[Column, Column]:
        """The part of [0, 1] along which one axis lies in its range; an empty one is turned round."""
        one, two = F.try_divide(F.lit(float(low)) - a, b - a), F.try_divide(F.lit(float(high)) - a, b - a)
        level = F.when(a.between(low, high), F.lit(0.0)).otherwise(F.lit(2.0))
        return F.coalesce(F.least(one, two), level), F.coalesce(F.greatest(one, two), F.lit(1.0))

    def clipped(s: Column) -> Column:
        n = F.greatest(F.lit(1.0), F.ceil(distance(s["ax"], s["ay"], s["bx"], s["by"]) / F.lit(float(step))).cast("double"))
        (a, b), (c, d) = inside(s["ax"], s["bx"], x1, x2), inside(s["ay"], s["by"], y1, y2)
        low, high = F.greatest(a, c, F.lit(0.0)), F.least(b, d, F.lit(1.0))
        first, last = F.greatest(F.lit(0.0), F.floor(low * n) - 1), F.least(n - 1, F.ceil(high * n) + 1)
        return F.struct(*[s[v].alias(v) for v in ("ax", "ay", "bx", "by")], n.alias("n"), F.when(low <= high, F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"))).alias("k"))

    def along(s: Column) -> Column:
        at = lambda k: F.struct((s["ax"] + (s["bx"] - s["ax"]) * k / s["n"]).alias("x"), (s["ay"] + (s["by"] - s["ay"]) * k / s["n"]).alias("y"))
        return F.transform(F.sequence(s["k"]["a"], s["k"]["b"]), at)

    kept = F.filter(F.transform(segments(coords), clipped), lambda s: s["k"].isNotNull() & (s["k"]["a"] <= s["k"]["b"]))
    return F.concat(F.flatten(F.transform(kept, along)), F.slice(coords, -1, 1))


def ring_area(coords: Column) -> Column:
    """Area of a closed ring, whichever way round."""
    first = F.get(coords, 0)  # near the ring, so that products stay small
    twice = lambda s: (s["ax"] - first["x"]) * (s["by"] - first["y"]) - (s["bx"] - first["x"]) * (s["ay"] - first["y"])
    return F.abs(F.aggregate(segments(coords), F.lit(0.0), lambda a, s: a + twice(s))) / 2


def spiral(x: Column, y: Column, num: Column, tot: Column, res: Column) -> tuple[Column, Column]:
    """Where member `num` (from 0) of `tot` equal points is drawn; at the point itself for res < 0 or one member."""
    a, b = float(FIRST_RING), float(RING_GROWTH)
    num_, tot_ = num.cast("double"), tot.cast("double")
    two_pi = F.lit(6.283185307179586)
    shift = a + b / 2
    row = F.floor((F.sqrt(F.lit(shift * shift) + 2 * b * F.greatest(F.lit(0.0), num_ - a + 2)) - shift) / b).cast("double")
    before = b * (row * row + row) / 2
    inside = num_ - (a * row + before - row * b)
    small = tot_ <= a
    radius = F.when(small, 2.0 * tot_ * res).otherwise((50.0 + 13.0 * row) * res)
    angle = F.when(small, num_ * two_pi / tot_).otherwise(inside * two_pi / (a + row * b))
    apart = (res >= 0) & (tot_ > 1)
    return F.when(apart, x + radius * F.sin(angle)).otherwise(x), F.when(apart, y + radius * F.cos(angle)).otherwise(y)


def douglas_peucker_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each vertex of a line, the tolerance from which simplification leaves it out: the vertices of weight over eps are Douglas and Peucker's line.

    The vertex furthest from the chord of a stretch splits it, at whatever tolerance; it is kept if it and all splits before it are further off
    than the tolerance. Ends always stay.
    """
    weights = np.full(len(x), np.inf)
    todo = [(0, len(x) - 1, np.inf)]
    while todo:
        a, b, most = todo.pop()
        if b - a < 2:
            continue
        dx, dy, u, v = x[b] - x[a], y[b] - y[a], x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        size = dx * dx + dy * dy
        t = np.clip((u * dx + v * dy) / size, 0, 1) if size else 0.0
        far = np.hypot(u - t * dx, v - t * dy)
        i = int(far.argmax())
        most = min(most, far[i])
        weights[a + 1 + i] = most
        todo += [(a, a + 1 + i, most), (a + 1 + i, b, most)]
    return weights


@F.arrow_udf(ArrayType(DoubleType()))
def vertex_weights(lines: pa.Array) -> pa.Array:
    """Weights of lines' vertices (array<struct<x, y>>), null for null: made once, they make any simplification a filter."""
    vertices = lines.flatten()
    x, y = (vertices.field(c).to_numpy(zero_copy_only=False) for c in "xy")
    ends = np.cumsum([0, *lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
    made = [douglas_peucker_weights(x[a:b], y[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0), *made])))
    return pc.if_else(lines.is_null(), pa.scalar(None, out.type), out) if lines.null_count else out


def by_weights(coords: Column, weights: Column, eps: Column | float) -> Column:
    """The vertices of a weight over eps; all of them, where there are no weights."""
    eps = eps if isinstance(eps, Column) else F.lit(float(eps))
    kept = F.transform(F.filter(F.zip_with(coords, weights, lambda c, w: F.struct(c.alias("c"), w.alias("w"))), lambda z: z["w"] > eps), lambda z: z["c"])
    return F.when(weights.isNull(), coords).otherwise(kept)


def simplify(coords: Column, eps: Column | float) -> Column:
    """Douglas-Peucker simplification of lines whose weights aren't kept: these are made in Python, on Arrow arrays."""
    return by_weights(coords, vertex_weights(coords), eps)
