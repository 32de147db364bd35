"""A result's rows meet their geometries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mercator


def match(result: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Components of the result's rows: an inner join on qid, many to many. Spark picks broadcast or sort-merge by size."""
    return result.join(dictionary, "qid")


def unmatched(result: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows whose id the dictionary doesn't have and that hold no point themselves."""
    return result.where(~mercator.is_folded(F.col("qid"))).join(dictionary.select("qid").distinct(), "qid", "left_anti")


def folded_points(result: DataFrame) -> DataFrame:
    """(row_id, qid, x, y) of the rows whose id is a point."""
    folded = result.where(mercator.is_folded(F.col("qid")))
    xy = {"x": mercator.x_of(mercator.folded_lng(F.col("qid"))), "y": mercator.y_of(mercator.folded_lat(F.col("qid")))}
    return folded.withColumns(xy).where(mercator.finite(F.col("x"), F.col("y")))


def as_components(points: DataFrame) -> DataFrame:
    """Points (x, y) as components of their rows, with boxes."""
    fixed = {"part_idx": F.lit(0), "kind": F.lit("POINT"), "hole": F.lit(False), "ring": F.lit(0), "poly": F.lit(0), "member": F.lit(0), "type": F.lit("POINT"), "coords": F.array(F.struct("x", "y"))}
    return points.withColumns(fixed | {f"{m}{a}": F.col(a) for m in ("min", "max") for a in "xy"})


def all_objects(result: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Matched components and folded points as one table (a bag)."""
    return match(result, dictionary).unionByName(as_components(folded_points(result)), allowMissingColumns=True)


def count_objects(objects: DataFrame) -> DataFrame:
    """One row, num_objects: result rows with a geometry; the parts of one count once."""
    return objects.agg(F.countDistinct("row_id").alias("num_objects"))


def bounds(objects: DataFrame, pad: float = 1.0) -> DataFrame:
    """One row: the box of all objects, grown on each side; nulls if there is none."""
    lit = F.lit(float(pad))
    return objects.where(F.col("kind") != "NONE").agg((F.min("minx") - lit).alias("minx"), (F.min("miny") - lit).alias("miny"), (F.max("maxx") + lit).alias("maxx"), (F.max("maxy") + lit).alias("maxy"))


def bounds_by_family(objects: DataFrame, pad: float = 1.0) -> DataFrame:
    """The boxes of points and of lines and areas, each grown; one aggregation."""
    lit = F.lit(float(pad))
    family = F.when(F.col("kind") == "POINT", "points").otherwise("lines")
    return objects.where(F.col("kind") != "NONE").groupBy(family.alias("family")).agg((F.min("minx") - lit).alias("minx"), (F.min("miny") - lit).alias("miny"), (F.max("maxx") + lit).alias("maxx"), (F.max("maxy") + lit).alias("maxy"))


def with_rows(hits: DataFrame, result: DataFrame) -> DataFrame:
    """Hits with their rows' attributes."""
    return hits.join(result, "row_id")


def row_of(result: DataFrame, row_id: int) -> DataFrame:
    """The row of that id, with its attributes."""
    return result.where(F.col("row_id") == row_id)


def reassemble(objects: DataFrame) -> DataFrame:
    """(row_id, n_parts, parts): the components of each row, in order."""
    part = F.struct("part_idx", "kind", "hole", "coords")
    return objects.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sort_array(F.collect_list(part)).alias("parts"))


def centroids(objects: DataFrame) -> DataFrame:
    """(row_id, n, x, y): mean position of each row's points."""
    return objects.where("kind = 'POINT'").groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
