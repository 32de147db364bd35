"""WKT to geometry components, by columns.

A literal may be quoted and carry a datatype: "POINT(7.8 48)"^^<...>. Types are matched in any case, with or without
Z, M or ZM; of a vertex the first two numbers count. A component is a point, a line or a ring of an area; the members
of multi-geometries and of a geometry collection become components of their own, nested collections are skipped
(nested_collections() counts them). A component knows what it was part of, so that the geometry can be put together again:
the type as written, its member of a collection (from 1; 0 outside of one), its polygon in the member and its ring in the
polygon (0 is the outer one). What can't be read has no components.

Brackets are matched by possessive patterns: they loop rather than recurse, so a task's stack holds a line of any
length and an area of any number of rings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENT = "array<struct<kind:string,hole:boolean,ring:int,poly:int,member:int,type:string,coords:array<struct<x:double,y:double>>>>"
#: A collection's members may hold brackets so deep.
DEPTH = 12
_INNER = r"\(([^()]*+)\)"
_POLYGON = r"\(((?:\s*+\([^()]*+\)\s*+,?+)++)\)"
_MEMBER = r"(?i)\b([a-z]+?)\s*+(?:zm|z|m)?\s*+"


def _brackets(depth: int = DEPTH) -> str:
    inner = r"\([^()]*+\)"
    for _ in range(depth):
        inner = rf"\((?:[^()]++|{inner})*+\)"
    return inner


def literal(wkt: Column) -> Column:
    """The text of a literal, without quotes and datatype; white space is blanks."""
    # long texts mostly have neither: a search for bytes is much faster than either function
    has = lambda text, chars: reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in chars])
    blanks = F.when(has(wkt, "\t\n\r\f\v"), F.translate(wkt, "\t\n\r\f\v", "     ")).otherwise(wkt)
    bare = F.regexp_replace(blanks, r'^ *+"|" *+(?:\^\^<[^>]*+>|\^\^\S++|@[A-Za-z-]++)? *+$', "")
    return F.trim(F.when(has(wkt, '"'), bare).otherwise(blanks))


def _kind(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"(?i)^([a-z]+?) *+(?:zm|z|m)? *+(?:\(|empty|$)", 1))


def wkt_type(wkt: Column) -> Column:
    return _kind(literal(wkt))


def _vertices(path: Column) -> Column:
    parts = F.transform(F.split(path, ","), lambda t: F.split(F.trim(t), " +"))
    xy = F.transform(parts, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("x"), F.get(p, 1).try_cast("double").alias("y")))
    return F.filter(xy, lambda v: v["x"].isNotNull() & v["y"].isNotNull())


def component(kind: str, coords: Column, type_: Column, member: Column | None = None, ring: Column | None = None, poly: Column | None = None) -> Column:
    number = lambda c, name: (F.lit(0) if c is None else c.cast("int")).alias(name)
    hole = F.lit(False) if ring is None else ring > 0
    return F.struct(F.lit(kind).alias("kind"), hole.alias("hole"), number(ring, "ring"), number(poly, "poly"), number(member, "member"), type_.alias("type"), coords.alias("coords"))


def closed(coords: Column) -> Column:
    """A ring whose last vertex is its first."""
    open_ = (F.size(coords) > 0) & (F.get(coords, 0) != F.element_at(coords, -1))
    return F.when(open_, F.concat(coords, F.slice(coords, 1, 1))).otherwise(coords)


def _of_member(kind: Column, body: Column, member: Column | None = None) -> Column:
    paths = lambda text: F.regexp_extract_all(text, F.lit(_INNER), F.lit(1))
    rings = lambda text, j=None: F.transform(F.transform(paths(text), _vertices), lambda v, i: component("AREA", closed(v), kind, member, i, j))
    points = F.transform(F.flatten(F.transform(paths(body), _vertices)), lambda v: component("POINT", F.array(v), kind, member))
    lines = F.transform(paths(body), lambda p: component("LINE", _vertices(p), kind, member))
    areas = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(_POLYGON), F.lit(1)), rings))
    found = (
        F.when(kind.isin("POINT", "MULTIPOINT"), points)
        .when(kind.isin("LINESTRING", "MULTILINESTRING"), lines)
        .when(kind == "POLYGON", rings(body))
        .when(kind == "MULTIPOLYGON", areas)
        .otherwise(F.array().cast(COMPONENT))
    )
    return F.filter(found, lambda c: F.size(c["coords"]) > 0)


def with_components(rows: DataFrame, wkt: str, name: str) -> DataFrame:
    """rows with array<struct<kind, hole, ring, poly, member, type, coords>> of a WKT column: kind is POINT, LINE or AREA; coords are as written.

    Text, type and body are columns of their own, each used more than once by the next, so that each is made once a row.
    """
    text, kind, body = (f"_{name}_{c}" for c in ("text", "kind", "body"))
    out = rows.withColumn(text, literal(F.col(wkt)))
    out = out.withColumns({kind: _kind(F.col(text)), body: F.regexp_extract(text, r"(?is)^[a-z]+ *+(?:zm|z|m)? *+(\(.*\))$", 1)})
    inside = F.substr(body, F.lit(2), F.length(body) - 2)
    member = lambda group: F.regexp_extract_all(inside, F.lit(f"{_MEMBER}({_brackets()})"), F.lit(group))
    read = F.zip_with(member(1), member(2), lambda k, b: F.struct(F.upper(k).alias("k"), b.alias("b")))
    several = F.transform(read, lambda m, i: _of_member(m["k"], m["b"], i + 1))
    found = F.when(F.col(kind) == "GEOMETRYCOLLECTION", F.flatten(several)).otherwise(_of_member(F.col(kind), F.col(body)))
    # a plain point, the most common geometry, does without functions over arrays
    xy = f"_{name}_xy"
    plain = (F.col(kind) == "POINT") & F.get(xy, 0).isNotNull() & F.get(xy, 1).isNotNull()
    point = F.array(component("POINT", F.array(F.struct(F.get(xy, 0).alias("x"), F.get(xy, 1).alias("y"))), F.lit("POINT")))
    numbers = F.split(F.trim(F.when(F.col(kind) == "POINT", inside)), " +")
    out = out.withColumn(xy, numbers).withColumn(xy, F.when(F.size(xy) >= 2, F.array(F.get(xy, 0).try_cast("double"), F.get(xy, 1).try_cast("double"))))
    return out.withColumn(name, F.coalesce(F.when(plain, point).otherwise(found), F.array().cast(COMPONENT))).drop(text, kind, body, xy)


def nested_collections(wkt: Column) -> Column:
    """How many collections a collection holds itself: they are skipped."""
    return F.greatest(F.lit(0), F.regexp_count(F.upper(wkt), F.lit("GEOMETRYCOLLECTION[ ZM]*+\\(")) - 1)
