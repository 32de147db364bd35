"""Joins by levels and quadtrees, clipped lines and polygons from rings, against brute force."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapfold.functions import geometry, wkt
from mapfold.operators import grid, ingest, lookup, raster, rings
from mapfold.plans import catalog
from mapfold.sources import sinks


def boxes_of(r, n, sides):
    side = r.choice(sides, n)
    x, y = r.uniform(-1e6, 1e6, (2, n)).round(2)
    return [(i, float(a), float(b), float(a + s * f), float(b + s)) for i, (a, b, s, f) in enumerate(zip(x, y, side, r.uniform(0, 1, n), strict=True))]


@pytest.mark.parametrize("hot", [50_000, 20])
def test_points_in_boxes_of_all_sizes(spark, hot):
    """Boxes from nothing to the whole, some before the grid's origin; with few points a cell, most cells are split."""
    r = np.random.default_rng(1)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([r.uniform(-1e6, 1e6, (300, 2)).round(2), r.normal(5000, 300, (300, 2)).round(2), [[7.25, 7.25]] * 60]))]
    b = boxes_of(r, 150, [0.0, 1.0, 300.0, 70_000.0, 3e6]) + [(900, 7.25, 7.25, 7.25, 7.25), (901, -1e9, -1e9, 1e9, 1e9), (902, None, None, None, None)]
    points = spark.createDataFrame(p, "row_id long, x double, y double").repartition(3)
    found = grid.join_boxes(points, spark.createDataFrame(b, "box int, minx double, miny double, maxx double, maxy double"), "box", -900_000.0, -900_000.0, hot)
    got = sorted((x["row_id"], x["box"]) for x in found.collect())
    assert got == sorted((i, k) for i, x, y in p for k, x1, y1, x2, y2 in b if x1 is not None and x1 <= x <= x2 and y1 <= y <= y2)
    assert grid.join_boxes(points, found.select("box", "minx", "miny", "maxx", "maxy").where("false"), "box", 0.0, 0.0, hot).count() == 0


def test_boxes_that_meet(spark):
    r = np.random.default_rng(2)
    a, b = boxes_of(r, 120, [0.0, 200.0, 5000.0, 600_000.0]), boxes_of(r, 120, [0.0, 900.0, 80_000.0, 2e6])
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} int, minx double, miny double, maxx double, maxy double")
    got = grid.join_line_boxes(make(a, "row_id"), make(b, "box"), "box", -1e6, -1e6).select("row_id", "box").collect()
    want = [(i, k) for i, p1, q1, p2, q2 in a for k, x1, y1, x2, y2 in b if p1 <= x2 and p2 >= x1 and q1 <= y2 and q2 >= y1]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_no_task_holds_a_hot_cell(spark):
    """A million points in one cell, half of them on one place: every join task gets a small part of them."""
    n = 1_000_000
    at = lambda k: F.when(F.col("id") % 2 == 0, F.lit(70.5)).otherwise(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 100)
    points = spark.range(n).select(F.col("id").alias("row_id"), at(1).alias("x"), at(2).alias("y"))
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 50.0), (2, 70.0, 70.0, 71.0, 71.0), (3, -9e6, -9e6, 9e6, 9e6)], "box int, minx double, miny double, maxx double, maxy double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = grid.join_boxes(points, boxes, "box", 0.0, 0.0)
        held = found.where("box = 3").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        counts = {r["box"]: r["count"] for r in found.groupBy("box").count().collect()}
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert held.sum() == n == counts[3] and held.max() < n / 4 and len(held) > 10
    p = points.toPandas()
    assert counts[1] == ((p.x <= 50) & (p.y <= 50)).sum() and counts[2] == (p.x.between(70, 71) & p.y.between(70, 71)).sum()


def test_quadtree_leaves_are_the_points():
    r = np.random.default_rng(3)
    xy = np.concatenate([r.uniform(0, 1, (500, 2)), r.normal(0.3, 0.001, (500, 2)), [[1.0, 1.0]] * 50])
    of, leaves = grid.quadtree(xy[:, 0], xy[:, 1], 20)
    side = 1 << grid.DEPTH
    at = of[np.minimum((xy[:, 1] * side).astype(int).clip(0), side - 1) * side + np.minimum((xy[:, 0] * side).astype(int).clip(0), side - 1)]
    assert np.bincount(at, minlength=len(leaves)).tolist() == [n for *_, n in leaves] and sum(n for *_, n in leaves) == len(xy)
    assert all(n <= 20 or d == grid.DEPTH for d, _, _, n in leaves) and sum(0.25**d for d, *_ in leaves) == 1 and len(leaves) % 3 == 1


def test_nearest_of_many(spark):
    r = np.random.default_rng(4)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.uniform(0, 1000, (200, 2)))] + [(300, 5.0, 5.0), (299, 5.0, 5.0)]
    c = [(i, float(a), float(b), float(s)) for i, (a, b, s) in enumerate(zip(*r.uniform(0, 1000, (2, 50)), r.choice([0.5, 40.0, 5000.0], 50), strict=True))] + [(90, 5.0, 5.0, 1.0), (91, 5.0, 5.0, 1.0), (92, 5.0, 5.0, 0.0)]
    got = {x["click"]: (x["row_id"], x["d"]) for x in lookup.nearest_of_many(spark.createDataFrame(c, "click int, x double, y double, rad double"), spark.createDataFrame(p, "row_id int, x double, y double"), 0.0, 0.0).collect()}
    want = {}
    for k, x, y, rad in c:
        d, i = min((((a - x) ** 2 + (b - y) ** 2) ** 0.5, i) for i, a, b in p)
        if d < rad:
            want[k] = (i, d)
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want) and got[90][0] == 299


def lines_of(spark, rows):
    df = spark.createDataFrame(rows, "row_id int, coords array<struct<x:double,y:double>>")
    return df.withColumns(geometry.bbox(F.col("coords")))


def test_clipped_lines_draw_the_same_pixels(spark):
    r = np.random.default_rng(5)
    rows = [(i, [tuple(map(float, v)) for v in np.cumsum(r.normal(0, s, (r.integers(1, 12), 2)), axis=0)]) for i, s in enumerate(np.repeat([3.0, 60.0, 900.0], 60))]
    rows += [(500, [(-1e3, 7.0), (1e3, 7.0)]), (501, [(5.0, -1e3), (5.0, 1e3)]), (502, [(1.0, 1.0), (1.0, 1.0)]), (503, [(2.0, 2.0)]), (504, [(-50.0, -40.0), (50.0, 40.0)]), (505, [(51.0, 0.0), (51.0, 9.0)])]
    lines = lines_of(spark, rows)
    for view in (raster.Viewport(-50.0, -40.0, 50.0, 40.0, 100, 80), raster.Viewport(-5.3, -4.1, 7.7, 6.4, 40, 30), raster.Viewport(-900.0, -800.0, 1000.0, 700.0, 60, 50)):
        meets = lambda s: geometry.segment_meets_box(s, view.x1, view.y1, view.x2, view.y2)  # noqa: B023, E731
        whole = lines.where(F.exists(geometry.segments(F.col("coords")), meets)).select(F.explode(geometry.densify(F.col("coords"), view.resolution)).alias("c")).select("c.x", "c.y")
        assert sorted(map(tuple, raster.lines_exact(lines, view).collect())) == sorted(map(tuple, raster.weigh(view.pixels(whole)).collect()))


def test_a_line_costs_what_is_seen_of_it(spark):
    """Across the whole map, at 0.6 and 0.01 units a pixel: a view's length in steps and a few more."""
    line = lines_of(spark, [(1, [(-2e7, -3000.0), (2e7, 3000.0)])])
    for half in (240.0, 4.0):
        view = raster.Viewport(-half, -0.75 * half, half, 0.75 * half, 800, 600)
        made = line.select(F.size(geometry.densify_within(F.col("coords"), view.resolution, view.x1, view.y1, view.x2, view.y2)).alias("n")).first()["n"]
        assert 800 <= made <= 810
        assert 800 <= raster.lines_exact(line, view).count() <= 802


def square(x, y, s, turned=False):
    ring = [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    return [tuple(map(float, v)) for v in (ring[::-1] if turned else ring)]


def test_rings_without_order(spark):
    """An island in a lake of an island, holes that touch their shell at a vertex, equal rings, rows of their own."""
    rows = [
        (1, 0, square(4, 4, 2)), (1, 1, square(0, 0, 10)), (1, 2, square(2, 2, 6, True)), (1, 3, square(20, 20, 5)), (1, 4, square(4.5, 4.5, 0.5)), (1, 5, square(21, 21, 1)), (1, 6, square(23, 23, 1)),
        (2, 0, square(20, 20, 2)), (2, 1, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)]), (2, 2, [(0.0, 0.0), (4.0, 2.0), (4.0, 1.0), (0.0, 0.0)]),
        (3, 7, square(0, 0, 1)), (3, 9, square(0, 0, 1)),
    ]
    df = spark.createDataFrame(rows, "row_id int, ring_id int, coords array<struct<x:double,y:double>>").withColumns(geometry.bbox(F.col("coords"))).repartition(3)
    made = rings.assemble(df)
    got = {(r["row_id"], r["ring_id"]): (r["poly"], r["ring"], r["hole"]) for r in made.collect()}
    assert got == {
        (1, 0): (0, 0, False), (1, 4): (0, 1, True), (1, 1): (1, 0, False), (1, 2): (1, 1, True), (1, 3): (2, 0, False), (1, 5): (2, 1, True), (1, 6): (2, 2, True),
        (2, 0): (0, 0, False), (2, 1): (1, 0, False), (2, 2): (1, 1, True), (3, 7): (0, 0, False), (3, 9): (0, 1, True),
    }
    shown = {r["row_id"]: json.loads(r["feature"])["geometry"] for r in sinks.geojson_by_row(rings.as_components(made)).collect()}
    assert shown[1]["type"] == "MultiPolygon" and [len(p) for p in shown[1]["coordinates"]] == [2, 2, 3] and shown[3]["type"] == "Polygon"
    assert shown[2]["coordinates"][1][1] == [list(v) for v in rows[9][2]]


@pytest.mark.parametrize(
    "wkt,want",
    [
        ("POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))", ("Polygon", [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]])),
        ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]]])),
        ("MULTIPOLYGON(((0 0,1 0,1 1,0 0),(0 0,1 0,1 1,0 0)),((5 5,6 5,6 6)))", ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]] * 2, [[[5, 5], [6, 5], [6, 6], [5, 5]]]])),
        ("MULTIPOINT(1 2)", ("MultiPoint", [[1, 2]])),
        ("POINT(1 2, 3 4)", ("MultiPoint", [[1, 2], [3, 4]])),
        ("MULTILINESTRING((0 0,1 1))", ("MultiLineString", [[[0, 0], [1, 1]]])),
        ("LINESTRING(0 0,1 1)", ("LineString", [[0, 0], [1, 1]])),
        ("GEOMETRYCOLLECTION(POINT(1 1))", ("GeometryCollection", [("Point", [1, 1])])),
        ("GEOMETRYCOLLECTION(POINT(1 1),POINT(1 1),MULTIPOINT(1 1,2 2),POINT EMPTY,LINESTRING(0 0,1 1))", ("GeometryCollection", [("Point", [1, 1]), ("Point", [1, 1]), ("MultiPoint", [[1, 1], [2, 2]]), ("LineString", [[0, 0], [1, 1]])])),
    ],
)
def test_geometries_keep_their_types(spark, wkt, want):
    """In the export, and put together again from components that were projected and shuffled."""
    rows = spark.createDataFrame([(1, None, "x", wkt), (2, 5, "y", "JUNK")], "id int, n int, `a b` string, wkt string")
    out = [json.loads(r["feature"]) for r in sinks.features(rows).collect()]
    shown = lambda g: (g["type"], [shown(x) for x in g["geometries"]] if "geometries" in g else g["coordinates"])
    assert len(out) == 1 and shown(out[0]["geometry"]) == want and out[0]["properties"] == {"id": 1, "n": None, "a b": "x"}
    parts = ingest.project(ingest.decode(rows.where("id = 1"), "id")).withColumn("coords", sinks.unproject(F.col("coords"))).repartition(3).withColumnRenamed("qid", "row_id")
    again = json.loads(sinks.geojson_by_row(parts).first()["feature"])
    assert shown(again["geometry"]) == want


def test_a_click_in_an_area_is_a_quarter_off(spark):
    area = lines_of(spark, [(1, square(0, 0, 100_000))]).withColumn("kind", F.lit("AREA"))
    hit = lookup.near_lines(area, 1000.0, 50_000.0, 20_000.0).first()
    assert (hit["d"], hit["hit_x"], hit["hit_y"]) == (5000.0, 1000.0, 50_000.0)
    assert lookup.near_lines(area, -1000.0, 50_000.0, 20_000.0).first()["d"] == 1000.0


def test_no_map_query_is_a_nested_loop(spark, sf):
    """But for the scalar that rasters are normalised by."""
    from mapfold.plans import catalog

    for name, query in catalog.QUERIES.items():
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        if name not in ("normalised_raster", "coloured_heatmap"):
            assert not re.search("NestedLoop|Cartesian", plan), name


def test_nearest_point_is_in_the_square_and_has_a_place(spark, tmp_path):
    """A nearest point outside of the click's square isn't found, and one without a place isn't nearest."""
    orders = lambda keys: spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    orders([0])
    assert [tuple(r) for r in catalog.nearest_point(spark, str(tmp_path)).collect()] == [(None, None)]
    orders([46258, 0, 190258])
    assert catalog.nearest_point(spark, str(tmp_path)).first()["id"] == 46258
    rows = spark.createDataFrame([(1, None), (3, 2.0), (2, 2.0), (4, 5.0)], "row_id long, v double")
    assert tuple(lookup.argmin(rows, F.col("v"), "row_id").first()) == (2, 2.0)


def test_long_texts_are_dealt_out(spark, tmp_path):
    """Texts to be decoded of one file, or of one row group, are read by several tasks, however many there are."""
    for name, key, n, tasks in (("customer", "c_custkey", 4100, 3), ("supplier", "s_suppkey", 250, 3)):
        spark.range(n).select(F.col("id").alias(key)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        made = {"customer": catalog.decode_collections, "supplier": catalog.decode_large_multipolygons}[name](spark, str(tmp_path))
        assert f"RoundRobinPartitioning({tasks})" in made._jdf.queryExecution().executedPlan().toString()
    literals = [('"POINT(1 2)"^^<x>', "POINT(1 2)"), ("POINT(1\t2)\n", "POINT(1 2)"), (' "POINT(1\r2)"@en ', "POINT(1 2)"), ("POINT(1 2) ", "POINT(1 2)"), (None, None)]
    got = spark.createDataFrame(literals, "wkt string, want string").select(wkt.literal(F.col("wkt")).alias("got"), "want").collect()
    assert [x["got"] for x in got] == [x["want"] for x in got]


def test_equal_boxes_are_joined_once(spark, monkeypatch):
    """Pairs of points and boxes, many of them equal, are those of brute force; only distinct boxes meet points, and lists stay short."""
    monkeypatch.setattr(grid, "LISTED", 8)
    r = np.random.default_rng(7)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.uniform(0, 1000, (120, 2)))] + [(7, 500.0, 500.0)]
    kinds = [(400.0, 300.0, 600.0, 700.0), (0.0, 0.0, 1000.0, 1000.0), (5000.0, 5000.0, 6000.0, 6000.0), (500.0, 500.0, 500.0, 500.0)]
    b = [(i, *kinds[i % 4]) for i in range(90)] + [(1, *kinds[1])]
    points, boxes = spark.createDataFrame(p, "row_id int, x double, y double"), spark.createDataFrame(b, "box int, minx double, miny double, maxx double, maxy double")
    pairs = grid.box_pairs(points, boxes, "row_id", "box", 0.0, 0.0)
    want = sorted((k, i) for k, x1, y1, x2, y2 in b for i, x, y in p if x1 <= x <= x2 and y1 <= y <= y2)
    assert sorted(map(tuple, pairs.collect())) == want and len(want) > 2000
    assert grid.box_pairs(points, boxes.where("false"), "row_id", "box", 0.0, 0.0).count() == 0
    plan = catalog.points_in_boxes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(box" in plan and "collect_list(row_id" in plan


def test_pairs_are_made_a_few_at_a_time(spark, monkeypatch):
    """The first pair of 500 points and 500 equal boxes is passed on before all pairs are made; the others follow."""
    n = 500
    points = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") / n).alias("x"), F.lit(0.5).alias("y"))
    boxes = spark.range(n).select(F.col("id").alias("box"), *[F.lit(v).alias(c) for c, v in zip(("minx", "miny", "maxx", "maxy"), (0.0, 0.0, 1.0, 1.0), strict=True)])
    pairs = grid.box_pairs(points, boxes, "row_id", "box", 0.0, 0.0)
    plan = pairs._jdf.queryExecution().executedPlan()
    assert len(plan.executeTake(1)) == 1
    todo, made = [plan.executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Generate":
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
    assert 1 <= max(made) <= grid.FEW * grid.LISTED and max(made) < n * n / 10
    assert pairs.count() == pairs.distinct().count() == n * n
    uneven = grid.box_pairs(points.where("row_id % 2 = 0"), boxes.where(f"box < {grid.FEW + 1}"), "row_id", "box", 0.0, 0.0)
    assert sorted(r["box"] for r in uneven.select("box").distinct().collect()) == list(range(grid.FEW + 1)) and uneven.count() == (grid.FEW + 1) * n // 2
    monkeypatch.setattr(grid, "MADE", 10_000)
    dealt = grid.box_pairs(points, boxes, "row_id", "box", 0.0, 0.0)
    assert dealt.rdd.getNumPartitions() == n * n // 10_000
