"""Geometry dictionary: WKT rows to projected components with boxes.

Equal WKT texts are decoded once; equal components share geom_id, a hash of their coordinates. A row whose geometry
can't be read keeps one component of kind NONE. Vertices that don't project to finite coordinates are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, mercator, wkt


def spread(rows: DataFrame, per_task: int) -> DataFrame:
    """rows dealt out to tasks of about `per_task` rows, however few files they come from: before long texts are made of them or decoded."""
    return rows.repartition(max(1, math.ceil(rows.count() / per_task)))


def decode(rows: DataFrame, qid: str = "qid", text: str = "wkt") -> DataFrame:
    """(qid, part_idx, kind, hole, ring, poly, member, type, coords): one row per component, in degrees; NONE for rows without any."""
    read = wkt.with_components(rows.select(F.col(qid).alias("qid"), F.col(text).alias("_wkt")), "_wkt", "_parts")
    parts = read.select("qid", F.posexplode_outer("_parts").alias("part_idx", "c"))
    return parts.select("qid", F.coalesce("part_idx", F.lit(0)).alias("part_idx"), F.coalesce("c.kind", F.lit("NONE")).alias("kind"), F.coalesce("c.hole", F.lit(False)).alias("hole"), *[F.coalesce(f"c.{c}", F.lit(0)).alias(c) for c in ("ring", "poly", "member")], F.coalesce("c.type", F.lit("NONE")).alias("type"), F.col("c.coords").alias("coords"))


def project(parts: DataFrame) -> DataFrame:
    """Components with coords in Mercator units, x and y of points, and the box; vertices that aren't finite go, and components left empty."""
    point, first = F.col("kind") == "POINT", F.get("coords", 0)
    out = parts.withColumns({"x": F.when(point, mercator.x_of(first["x"])), "y": F.when(point, mercator.y_of(first["y"]))})
    # points, the most common kind, do without functions over arrays
    moved = F.transform("coords", lambda c: F.struct(mercator.x_of(c["x"]).alias("x"), mercator.y_of(c["y"]).alias("y")))
    moved = F.filter(moved, lambda c: mercator.finite(c["x"], c["y"]))
    out = out.withColumn("coords", F.when(point, F.array(F.struct("x", "y"))).otherwise(moved))
    out = out.where(F.when(point, mercator.finite(F.col("x"), F.col("y"))).otherwise((F.col("kind") == "NONE") | (F.size("coords") > 0)))
    return out.withColumns({c: F.when(point, F.col(c[-1])).otherwise(e) for c, e in geometry.bbox(F.col("coords")).items()})


def weights_of() -> Column:
    """Weights of the vertices of lines and rings, by which clicks simplify them."""
    return geometry.vertex_weights(F.when(F.col("kind").isin("LINE", "AREA"), F.col("coords")))


def build_dictionary(rows: DataFrame, qid: str = "qid", text: str = "wkt", known: DataFrame | None = None) -> DataFrame:
    """Projected components of (qid, WKT) rows: each qid once, each text decoded once, with the text's hash (text_1, text_2).

    Repeated qids keep the row of smallest text, a rule that doesn't depend on arrival. Equal texts meet in a partial
    aggregation by their 128-bit hash and are decoded as one; the ids, which travel without texts, join their components.
    Equal components share geom_id and geom_id_2, 128 bits of hash of their coordinates.

    known: a dictionary made before, of the same or of other rows. Texts it has aren't decoded again: their components are taken from it.
    """
    once = first_texts(rows, qid, text).withColumns({"text_1": F.xxhash64("wkt"), "text_2": F.xxhash64(F.lit("second"), "wkt")})
    key = ["text_1", "text_2"]
    texts = once.groupBy(*key).agg(F.first("wkt").alias("wkt"))
    if known is not None:
        texts = texts.join(known.select(*key).distinct(), key, "left_anti")
    parts = project(decode(texts.select(F.struct(*key).alias("h"), "wkt"), "h", "wkt")).select(F.col("qid.text_1").alias("text_1"), F.col("qid.text_2").alias("text_2"), "*").drop("qid")
    parts = parts.withColumns({"weights": weights_of(), "geom_id": F.xxhash64("coords"), "geom_id_2": F.xxhash64(F.lit("second"), "coords")})
    if known is not None:
        wanted = known.join(once.select(*key).distinct(), key, "left_semi")
        own = [c for c in parts.columns if c not in (*key, "part_idx")]
        parts = parts.unionByName(wanted.groupBy(*key, "part_idx").agg(*[F.first(c).alias(c) for c in own]))
    return once.select("qid", *key).join(parts, key)


def first_texts(rows: DataFrame, qid: str = "qid", text: str = "wkt") -> DataFrame:
    """(qid, wkt): each qid once, with its smallest text."""
    return rows.select(F.col(qid).alias("qid"), F.col(text).alias("wkt")).groupBy("qid").agg(F.min("wkt").alias("wkt"))


def geometry_ids(rows: DataFrame, qid: str = "qid", text: str = "wkt") -> DataFrame:
    """(qid, geom_id): rows of equal text share a dense id, in the order of the texts' first qid.

    The distinct texts are numbered without one task sorting them all: by rank inside a hash part, after the sizes
    of the parts before it. There are as many parts as shuffle partitions.
    """
    firsts = rows.groupBy(text).agg(F.min(qid).alias("first"))
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = firsts.withColumn("part", F.pmod(F.xxhash64(text), F.lit(n_parts)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first", text)) - 1
    ids = parts.withColumn("rank", rank).join(starts, "part").select(text, (F.col("start") + F.col("rank")).alias("geom_id"))
    return rows.join(ids, rows[text].eqNullSafe(ids[text])).select(rows[qid].alias("qid"), "geom_id")


def duplicate_counts(rows: DataFrame, qid: str = "qid", text: str = "wkt") -> DataFrame:
    """One row: rows with a geometry, distinct qids, repeated ids, distinct texts."""
    return rows.agg(
        F.count(text).alias("n_geometries"),
        F.countDistinct(qid).alias("n_ids"),
        (F.count(F.lit(1)) - F.countDistinct(qid)).alias("n_duplicates"),
        F.countDistinct(text).alias("n_unique"),
    )


def vertices_to_lines(vertices: DataFrame, kind: str = "LINE", ring: str | None = None) -> DataFrame:
    """Components from a table with a row for each vertex: (row_id, qid, [ring,] v, lng, lat)."""
    keys = ["row_id", "qid"] + ([ring] if ring else [])
    made = vertices.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", F.col("lng").alias("x"), F.col("lat").alias("y")))).alias("vs"))
    coords = F.transform("vs", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    whole = {"POINT": "MULTIPOINT", "LINE": "LINESTRING", "AREA": "POLYGON"}[kind]
    rings = [(F.col(ring) > 0).alias("hole"), F.col(ring).alias("ring")] if ring else [F.lit(False).alias("hole"), F.lit(0).alias("ring")]
    return made.select("row_id", "qid", F.lit(kind).alias("kind"), *rings, F.lit(0).alias("poly"), F.lit(0).alias("member"), F.lit(whole).alias("type"), (wkt.closed(coords) if kind == "AREA" else coords).alias("coords"))


def last_column(result: DataFrame) -> str:
    """The geometry of a result: its last column."""
    return result.columns[-1]
