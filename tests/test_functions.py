import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapfold.functions import geometry, mercator, text, wkt
from mapfold.operators import ingest, raster
from mapfold.sources import packed, registry, sinks


def parts(spark, literal):
    df = spark.createDataFrame([(1, literal)], "qid long, wkt string")
    return [(r["kind"], r["hole"], r["ring"], [tuple(c) for c in r["coords"] or []]) for r in ingest.decode(df).orderBy("part_idx").collect()]


@pytest.mark.parametrize(
    "literal,want",
    [
        ('"POINT(7.8 48)"^^<http://www.opengis.net/ont/geosparql#wktLiteral>', [("POINT", False, 0, [(7.8, 48.0)])]),
        ("  point ( 7.8   48 ) ", [("POINT", False, 0, [(7.8, 48.0)])]),
        ("POINT EMPTY", [("NONE", False, 0, [])]),
        ("JUNK", [("NONE", False, 0, [])]),
        ("", [("NONE", False, 0, [])]),
        (None, [("NONE", False, 0, [])]),
        ("MULTIPOINT(1 2,3 4)", [("POINT", False, 0, [(1, 2)]), ("POINT", False, 0, [(3, 4)])]),
        ("MULTIPOINT((1 2),(3 4))", [("POINT", False, 0, [(1, 2)]), ("POINT", False, 0, [(3, 4)])]),
        ("LINESTRING(1 2, 3 4, 5e0 -6)", [("LINE", False, 0, [(1, 2), (3, 4), (5, -6)])]),
        ("POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1),(3 1,3.5 1,3 2))", [("AREA", False, 0, [(0, 0), (4, 0), (4, 4), (0, 0)]), ("AREA", True, 1, [(1, 1), (2, 1), (2, 2), (1, 1)]), ("AREA", True, 2, [(3, 1), (3.5, 1), (3, 2), (3, 1)])]),
        ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5),(5.1 5.1,5.2 5.1,5.2 5.2,5.1 5.1)))", [("AREA", False, 0, [(0, 0), (1, 0), (1, 1), (0, 0)]), ("AREA", False, 0, [(5, 5), (6, 5), (6, 6), (5, 5)]), ("AREA", True, 1, [(5.1, 5.1), (5.2, 5.1), (5.2, 5.2), (5.1, 5.1)])]),
        ("GEOMETRYCOLLECTION(POINT(1 2),GEOMETRYCOLLECTION(POINT(3 4)),LINESTRING(0 0,1 1))", [("POINT", False, 0, [(1, 2)]), ("LINE", False, 0, [(0, 0), (1, 1)])]),
        ("POINT(x y)", [("NONE", False, 0, [])]),
        ("POINT Z (1 2 3)", [("POINT", False, 0, [(1, 2)])]),
        ("pointzm(1 2 3 4)", [("POINT", False, 0, [(1, 2)])]),
        ("LINESTRING M(1 2 9,\n\t3 4 9)", [("LINE", False, 0, [(1, 2), (3, 4)])]),
        ("GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(MULTIPOLYGON(((0 0,1 1,1 0))))),POINT Z (5 6 7))", [("POINT", False, 0, [(5, 6)])]),
        ("POLYGON((0 0,1 1", [("NONE", False, 0, [])]),
    ],
)
def test_wkt(spark, literal, want):
    assert parts(spark, literal) == want


def test_geometries_of_any_size(spark):
    """Lines of 100,000 vertices and areas of 10,000 rings, alone and in collections; brackets without an end."""
    line = "LINESTRING(" + ",".join(f"{i % 180} {i % 80}" for i in range(100_000)) + ")"
    rings = ",".join(f"({i % 170} 0,{i % 170 + 1} 0,{i % 170 + 1} 1)" for i in range(10_000))
    members = ",".join(["((0 0,1 0,1 1),(0 0,1 0,1 1,0 0))"] * 10_000)
    literals = [line, f"GEOMETRYCOLLECTION(POINT(1 1),{line})", f"MULTIPOLYGON(({rings}))", f"MULTIPOLYGON({members})", f"GEOMETRYCOLLECTION(MULTIPOLYGON(({rings})),POINT(2 2))", "(" * 100_000, "GEOMETRYCOLLECTION(" * 5_000, "GEOMETRYCOLLECTION" + "(" * 5_000]
    out = ingest.project(ingest.decode(spark.createDataFrame(list(enumerate(literals)), "qid long, wkt string")))
    got = {(r["qid"], r["kind"]): (r["n"], r["v"]) for r in out.groupBy("qid", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("coords")).alias("v")).collect()}
    want = {(0, "LINE"): (1, 100_000), (1, "LINE"): (1, 100_000), (1, "POINT"): (1, 1), (2, "AREA"): (10_000, 40_000), (3, "AREA"): (20_000, 80_000), (4, "AREA"): (10_000, 40_000), (4, "POINT"): (1, 1)}
    assert got == want | {(i, "NONE"): (1, None) for i in (5, 6, 7)}
    assert one(spark, wkt.nested_collections(F.lit("GEOMETRYCOLLECTION(POINT(1 1), geometrycollection z (POINT(1 1)))"))) == 1


def test_equal_texts_are_one_geometry_and_odd_vertices_go(spark):
    rows = [(1, "LINESTRING(0 0, 1 -90, 2 NaN, 3 3)"), (2, "LINESTRING(0 0, 1 -90, 2 NaN, 3 3)"), (3, "MULTIPOINT(1 1, 2 -90)"), (4, "LINESTRING(0 -90, 1 -90)")]
    out = ingest.build_dictionary(spark.createDataFrame(rows, "qid long, wkt string")).collect()
    by = {r["qid"]: r for r in out}
    assert len(out) == 3 and set(by) == {1, 2, 3} and by[1]["geom_id"] == by[2]["geom_id"] != by[3]["geom_id"]
    assert len(by[1]["coords"]) == 2 and abs(by[1]["miny"]) < 1e-6 and by[1]["maxx"] > 333_000


def test_points_that_do_not_project_go(spark):
    df = spark.createDataFrame([(1, "POINT(0 -90)"), (2, "POINT(10 50)"), (3, "JUNK"), (2, "POINT(11 51)"), (4, "POINT(NaN 1)")], "qid long, wkt string")
    out = {r["qid"]: r for r in ingest.build_dictionary(df).collect()}
    assert set(out) == {2, 3} and out[3]["kind"] == "NONE" and out[3]["minx"] is None
    assert abs(out[2]["x"] - 10 * 20037508.342789244 / 180) < 1e-6


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def line(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def test_projection_is_its_own_inverse(spark):
    for lng, lat in ((0, 0), (7.8, 48), (-179.9, -80), (180, 85)):
        assert abs(one(spark, mercator.lng_of(mercator.x_of(F.lit(float(lng))))) - lng) < 1e-9
        assert abs(one(spark, mercator.lat_of(mercator.y_of(F.lit(float(lat))))) - lat) < 1e-9
    assert not one(spark, mercator.finite(F.lit(float("nan")))) and not one(spark, mercator.finite(F.lit(None).cast("double")))


def test_lines(spark):
    l = line((0, 0), (10, 0), (10, 10))
    d = lambda x, y: one(spark, geometry.line_distance(F.lit(float(x)), F.lit(float(y)), l))
    assert (d(5, 3), d(5, 0.00005), d(13, 14)) == (3, 0, 5)
    foot = one(spark, geometry.project_on(F.lit(12.0), F.lit(5.0), l))
    assert (foot["d"], foot["x"], foot["y"]) == (2, 10, 5)
    assert [tuple(c) for c in one(spark, geometry.densify(line((0, 0), (10, 0), (10, 1)), 5.0))] == [(0, 0), (5, 0), (10, 0), (10, 1)]
    assert one(spark, F.size(geometry.segments(line((1, 1))))) == 0
    ring = line((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    assert one(spark, geometry.contains(ring, F.lit(1.0), F.lit(3.0))) and not one(spark, geometry.contains(ring, F.lit(5.0), F.lit(3.0)))


def test_segment_and_box(spark):
    meets = lambda a, b: one(spark, F.exists(geometry.segments(line(a, b)), lambda s: geometry.segment_meets_box(s, 0.0, 0.0, 10.0, 10.0)))
    assert meets((-5, 5), (15, 6))  # crosses with no vertex inside
    assert meets((1, 1), (2, 2)) and meets((10, 10), (20, 20)) and not meets((-5, 8), (3, 30)) and not meets((11, 0), (12, 9))


def test_simplify(spark):
    df = spark.createDataFrame([(1, [(float(i), 0.01 * (i % 2)) for i in range(50)] + [(50.0, 30.0)]), (2, [(0.0, 0.0)])], "i int, coords array<struct<x:double,y:double>>")
    out = {r["i"]: r["c"] for r in df.select("i", geometry.simplify(F.col("coords"), 1.0).alias("c")).collect()}
    assert [(c["x"], c["y"]) for c in out[1]] == [(0, 0), (49, 0.01), (50, 30)] and len(out[2]) == 1


def test_spiral(spark):
    def at(num, tot, res):
        dx, dy = geometry.spiral(F.lit(0.0), F.lit(0.0), F.lit(num), F.lit(tot), F.lit(float(res)))
        return one(spark, dx), one(spark, dy)

    assert at(3, 5, -1) == (0, 0) and at(0, 1, 2) == (0, 0)
    assert abs(math.hypot(*at(3, 10, 2)) - 40) < 1e-9 and abs(math.hypot(*at(0, 100, 1)) - 50) < 1e-9
    rings = {round(math.hypot(*at(n, 100, 1)), 6) for n in range(100)}
    assert rings == {50, 63, 76}  # 25, 31 and 44 places


def test_text(spark):
    assert text.params("a=1&b=x%20y&c=", "b=2") == {"a": "1", "b": "2", "c": ""}
    assert text.hidden_columns(["a", "image", "x_image", "flag", "g"]) == ["image", "x_image", "flag", "g"]
    assert one(spark, text.shown(F.lit('"Bär"@de'))) == "Bär" and one(spark, text.shown(F.lit(None).cast("string"))) == "---"
    assert one(spark, text.json_string(F.lit('a"b\n'))) == '"a\\"b\\n"'
    assert one(spark, wkt.wkt_type(F.lit('"multipoint(1 2)"^^x:y'))) == "MULTIPOINT"


def test_views():
    v = raster.Viewport.parse("0,0,80000,60000", "800", "600")
    assert v.resolution == 100 and v.level == "exact"
    assert raster.Viewport(0, 0, 240000, 180000, 800, 600).level == "grid"
    assert raster.Viewport(0, 0, 26214.4 * 800, 26214.4 * 600, 800, 600).level == "cell"
    for bad in ("1,2,3", "0,0,0,5"):
        with pytest.raises(ValueError):
            raster.Viewport.parse(bad, 10, 10)


def test_png():
    data = sinks.png([(0, 0, 1, 2, 3, 4), (2, 1, 9, 8, 7, 6)], 3, 2)
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunks[kind] = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + chunks[kind])
        at += 12 + n
    raw = zlib.decompress(chunks[b"IDAT"])
    assert len(raw) == 2 * 13 and raw[1:5] == bytes([1, 2, 3, 4]) and raw[13 + 9 : 13 + 13] == bytes([9, 8, 7, 6])


def test_registry_and_ids(spark, tmp_path):
    r = registry.Registry()
    r.register("", lambda s: 0)
    r.register("wiki", lambda s: 1)
    r.register("wikidata", lambda s: 2)
    assert r.resolve("wikidata-x")(None) == 2 and r.resolve("wikipedia")(None) == 1 and r.resolve("osm")(None) == 0
    ids = [1, (8 << 60) | 5, (1 << 63) - 1, (1 << 64) - 1]
    (tmp_path / "ids.bin").write_bytes(b"".join(struct.pack("<Q", i) for i in ids) + b"xx")
    got = [x["qid"] for x in packed.read_ids(spark, str(tmp_path / "ids.bin")).orderBy("position").collect()]
    assert [g % (1 << 64) for g in got] == ids
    more = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 200_000, dtype=np.int64, endpoint=False)
    (tmp_path / "pages").mkdir()
    more.tofile(tmp_path / "pages" / "0.bin")
    more[:50].tofile(tmp_path / "pages" / "1.bin")
    (tmp_path / "pages" / "2.bin").write_bytes(more[:7].tobytes() + b"abc")
    rows = packed.read_ids(spark, str(tmp_path / "pages")).collect()
    assert len(rows) == 200_057 and all(more[x["position"]] == x["qid"] for x in rows)
    assert len({(x["path"], x["position"]) for x in rows}) == len(rows)
    (tmp_path / "rows.tsv").write_text("a\tgeometry\n1\tPOINT(1 2)\n")
    assert registry.read_tsv(spark, str(tmp_path / "rows.tsv")).collect()[0].asDict() == {"a": "1", "geometry": "POINT(1 2)"}
