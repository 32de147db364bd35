"""Sinks: GeoJSON, JSON answers, TSV and CSV, PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mercator, text, wkt


def position(x: Column, y: Column, digits: int = 6) -> Column:
    return F.concat(F.lit("["), text.number(x, digits), F.lit(","), text.number(y, digits), F.lit("]"))


def coordinates(coords: Column, digits: int = 6) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(coords, lambda c: position(c["x"], c["y"], digits)), ","), F.lit("]"))


def unproject(coords: Column) -> Column:
    return F.transform(coords, lambda c: F.struct(mercator.lng_of(c["x"]).alias("x"), mercator.lat_of(c["y"]).alias("y")))


#: GeoJSON's names of what components were part of, alone and with others.
GEOJSON_NAMES = {"POINT": ("Point", "MultiPoint"), "LINE": ("LineString", "MultiLineString"), "AREA": ("Polygon", "MultiPolygon")}


def geometry(parts: Column, digits: int = 6) -> Column:
    """The GeoJSON geometry of an array of components (kind, ring, poly, member, type, coords), in degrees and in order; null of none.

    Components of a member are put together by its type: rings of a polygon, polygons, lines and points of a multi-geometry. Members of
    a collection are its geometries. Each component writes its own piece and what stands between it and its neighbours, so the text
    grows with the geometry.
    """
    n = F.size(parts)

    def piece(p: Column, i: Column) -> Column:
        before, after = F.get(parts, i - 1), F.get(parts, i + 1)
        opens, closes = (i == 0) | (before["member"] != p["member"]), (i == n - 1) | (after["member"] != p["member"])
        area = p["kind"] == "AREA"
        # a polygon of several, however the type was written; points and lines that aren't alone
        many = p["type"].startswith("MULTI") | (~area & ~(opens & closes))
        name = F.lit("")
        for kind, (one, more) in GEOJSON_NAMES.items():
            name = F.when(p["kind"] == kind, F.when(many, more).otherwise(one)).otherwise(name)
        own = F.when(p["kind"] == "POINT", position(F.get(p["coords"], 0)["x"], F.get(p["coords"], 0)["y"], digits)).otherwise(coordinates(p["coords"], digits))
        head = F.concat(F.when(i > 0, ",").otherwise(""), F.lit('{"type":"'), name, F.lit('","coordinates":'), F.when(many, "[").otherwise(""), F.when(area, "[").otherwise(""))
        between = F.when(area & (before["poly"] != p["poly"]), "],[").otherwise(",")
        tail = F.when(closes, F.concat(F.when(area, "]").otherwise(""), F.when(many, "]}").otherwise("}"))).otherwise("")
        return F.concat(F.when(opens, head).otherwise(between), own, tail)

    text = F.array_join(F.transform(parts, piece), "")
    several = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), text, F.lit("]}"))
    return F.when(n > 0, F.when(F.get(parts, 0)["member"] > 0, several).otherwise(text))


def geojson_of_parts(parts: DataFrame, properties: Column | None = None) -> DataFrame:
    """One row, feature: a row's components (part_idx, kind, ring, poly, member, type, coords, degrees) as a Feature."""
    one = parts.agg(_gathered()).select(geometry(F.col("all")).alias("g"))
    return one.select(feature(F.coalesce("g", F.lit("null")), properties if properties is not None else F.lit("{}")).alias("feature"))


def geojson_by_row(parts: DataFrame) -> DataFrame:
    """(row_id, feature): the same for each row_id of parts, without properties."""
    return parts.groupBy("row_id").agg(_gathered()).select("row_id", feature(geometry(F.col("all")), F.lit("{}")).alias("feature"))


def _gathered() -> Column:
    return F.sort_array(F.collect_list(F.struct("part_idx", "kind", "ring", "poly", "member", "type", "coords"))).alias("all")


def feature(geometry: Column, properties: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}"))


def features(result: DataFrame, digits: int = 6) -> DataFrame:
    """(feature): every row of a result whose last column is WKT that can be read, other columns as properties, nulls too."""
    *attributes, geom = result.columns
    parts = wkt.with_components(result, geom, "_c").withColumn("_g", geometry(F.col("_c"), digits))
    properties = F.to_json(F.struct(*[f"`{c}`" for c in attributes]), {"ignoreNullFields": "false"}) if attributes else F.lit("{}")
    # rows without a geometry have no feature; exploding drops them without a filter, which would parse the text once more
    return parts.select(F.explode(F.array_compact(F.array(feature(F.col("_g"), properties)))).alias("feature"))


def write_geojson(result: DataFrame, path: str) -> None:
    """A FeatureCollection as text files of one Feature a line (newline-delimited GeoJSON), written in parallel."""
    features(result).write.mode("overwrite").text(path)


def query_json(session: str, box: Sequence[float | None], num_objects: int, threshold: int) -> dict:
    return {"qid": session, "bounds": [list(box[:2]), list(box[2:])], "numobjects": num_objects, "autothreshold": threshold}


def write_delimited(result: DataFrame, path: str, sep: str = "\t") -> None:
    result.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def png(pixels: Sequence[tuple], width: int, height: int) -> bytes:
    """An RGBA PNG of (px, py, r, g, b, a) pixels; all others are clear. A raster is at most width x height rows."""
    image = np.zeros((height, 1 + 4 * width), np.uint8)
    for x, y, *rgba in pixels:
        image[y, 1 + 4 * x : 5 + 4 * x] = rgba

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(image.tobytes(), 7)) + chunk(b"IEND", b"")
