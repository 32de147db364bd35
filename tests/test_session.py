import json

import pytest

from mapfold.operators import raster
from mapfold.plans import fixtures
from mapfold.plans.session import Config, MapEngine, NotReady, TooLarge
from mapfold.sources import registry
from mapfold.streaming import raster_stream


@pytest.fixture(scope="module")
def engine(spark, sf, tmp_path_factory):
    source = tmp_path_factory.mktemp("source")
    fixtures.result(spark, sf).select("qid", "wkt").write.mode("overwrite").parquet(str(source))
    fills = registry.Registry()
    fills.register("orders", lambda s: s.read.parquet(str(source)))
    fixtures.result(spark, sf).createOrReplaceTempView("found")
    fixtures.folded(spark, sf).createOrReplaceTempView("folded_rows")
    return MapEngine(spark, Config(cache_dir=str(tmp_path_factory.mktemp("cache")), auto_threshold=100), fills)


def test_query_by_id_with_folded_points(engine):
    q = "SELECT row_id, o_totalprice, qid FROM found WHERE row_id < 200 UNION ALL SELECT row_id + 5000, 0.0, qid FROM folded_rows WHERE row_id BETWEEN 1 AND 10"
    a = engine.query(q, "orders")
    assert a["numobjects"] == 210 and a["autothreshold"] == 100 and engine.query(q, "orders")["qid"] == a["qid"]
    (x1, y1), (x2, y2) = a["bounds"]
    assert x1 < x2 and y1 < y2
    status = engine.load_status("orders")
    assert (status["percent"], status["stage"]) == (100.0, 4) and status["components"] > 1000 > status["unreadable"] > 0
    assert engine.load_status("unknown") == {"percent": 0.0, "stage": 0}
    assert engine.style(a["qid"], 10) == "heatmap" and engine.style(a["qid"], 16) == "objects"


def test_dictionary_comes_from_the_cache(spark, engine):
    before = engine.load("orders")
    again = MapEngine(spark, engine.config, engine.fills)
    assert again.load("orders").count() == before.count()


def test_query_by_wkt(engine, tmp_path):
    a = engine.query("SELECT row_id, o_orderpriority, wkt FROM found WHERE row_id BETWEEN 1 AND 60")
    s = a["qid"]
    assert a["numobjects"] == 60  # rows whose geometry can't be read count
    view = raster.Viewport(-20037509.0, -15538712.0, 20037509.0, 15538712.0, 80, 60)
    assert engine.heatmap_png(s, f"{view.x1},{view.y1},{view.x2},{view.y2}", 80, 60)[1:4] == b"PNG"
    hit = engine.get(s).objects.where("row_id = 7").first()
    near = engine.nearest(s, hit["x"] + 10, hit["y"], 100.0)
    assert near[0]["id"] == 7 and near[0]["geom"]["geometry"]["type"] == "Point" and ["o_orderpriority", engine.row(s, 7)["o_orderpriority"]] in near[0]["attrs"]
    assert engine.nearest(s, hit["x"], hit["y"] + 1e6, 1.0) == []
    local = raster.Viewport(hit["x"] - 4000.3, hit["y"] - 3000.3, hit["x"] + 4000.3, hit["y"] + 3000.3, 800, 600)
    pixels = engine.raster(s, local, "objects").collect()
    assert len(pixels) == 16
    assert engine.nearest(s, hit["x"], hit["y"], 100.0, local, "objects")[0]["id"] == 7
    f = json.loads(engine.geojson(s, 7, 10.0, export=True))
    assert f["properties"] == {"o_orderpriority": engine.row(s, 7)["o_orderpriority"]}
    engine.export(s, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    assert len(lines) == 58 and {x["type"] for x in lines} == {"Feature"}
    engine.export(s, str(tmp_path / "tsv"), "tsv")
    assert any("\t" in p.read_text() for p in (tmp_path / "tsv").glob("part*"))


def test_all_kinds_and_levels(spark, engine):
    rows = [(1, "POINT(8 48)"), (2, "LINESTRING(7 47, 9 49)"), (3, "POLYGON((7 47,9 47,9 49,7 49,7 47))"), (4, "MULTIPOINT(8 48, 8.5 48.5)"), (5, "POINT(8 48)"), (6, "GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(1 1,2 2))")]
    df = spark.createDataFrame(rows, "row_id long, wkt string")
    s = engine.query(df)["qid"]
    x, y = 8 * 20037508.342789244 / 180, 6106854.834885074
    for half in (20000, 200000, 15000000):
        view = raster.Viewport(x - 4 * half, y - 3 * half, x + 4 * half, y + 3 * half, 800, 600)
        assert engine.raster(s, view).count() > 0 and engine.raster(s, view, "objects").count() > 0
    inside = engine.nearest(s, x + 150000, y - 1000, 30000.0)
    assert inside == [] or inside[0]["id"] in (2, 3)
    c = {r["row_id"]: r for r in engine.clusters(s, 10.0).collect()}
    assert c[1]["cl_tot"] == c[5]["cl_tot"] == 2 and c[4]["cl_tot"] == 0
    assert json.loads(engine.geojson(s, 6, 1.0))["geometry"]["type"] == "GeometryCollection"


def test_coarse_maps_read_kept_counts(engine):
    s = engine.query("SELECT row_id, wkt FROM found WHERE row_id < 500")["qid"]
    view = raster.Viewport(-20037509.0, -15538712.0, 20037509.0, 15538712.0, 400, 300)
    first = {tuple(r) for r in engine.raster(s, view).collect()}
    kept = engine.levels(s)
    assert {tuple(r) for r in engine.raster(s, view).collect()} == first and engine.levels(s) is kept
    ox, oy = engine.get(s).box[:2]
    fresh = raster.heatmap(engine.get(s).objects, view, ox, oy)
    assert {tuple(r) for r in raster.heatmap(engine.get(s).objects, view, ox, oy, kept).collect()} == {tuple(r) for r in fresh.collect()}


def test_row_ids_are_kept_and_clicks_answer_all_hits(spark, engine):
    """Rows without ids get some that don't change; a click's hits come with attributes and geometry."""
    df = spark.createDataFrame([("a", "POINT(8 48)"), ("b", "LINESTRING(7.9 48, 8.1 48.001)"), ("c", "POLYGON((7 47,9 47,9 49,7 49))")], "name string, wkt string").repartition(3)
    s = engine.query(df)["qid"]
    ids = [{r["name"]: r["row_id"] for r in engine.get(s).result.collect()} for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0].values())) == 3
    hits = engine.nearest(s, 8 * 20037508.342789244 / 180, 6106854.834885074, 5000.0, k=3)
    assert [dict(map(tuple, h["attrs"]))["name"] for h in hits] == ["a", "b", "c"] and [h["id"] for h in hits] == [ids[0][n] for n in "abc"]
    assert [h["geom"]["geometry"]["type"] for h in hits] == ["Point", "LineString", "Polygon"] and all(abs(h["ll"]["lng"] - 8) < 0.1 for h in hits)
    path = engine.get(s).objects._kept_at
    engine.clear(s)
    import os

    assert not os.path.exists(path)


def test_sessions_end(engine):
    s = engine.query("SELECT row_id, wkt FROM found WHERE row_id = 3")["qid"]
    r1 = engine.query("SELECT row_id, rand() AS r, wkt FROM found WHERE row_id = 3")["qid"]
    assert r1 != engine.query("SELECT row_id, rand() AS r, wkt FROM found WHERE row_id = 3")["qid"]
    engine.clear(s)
    with pytest.raises(NotReady):
        engine.get(s)
    engine.evict(now=4e12)
    assert not engine.sessions
    small = MapEngine(engine.spark, Config(most_objects=2))
    with pytest.raises(TooLarge):
        small.query("SELECT row_id, wkt FROM found WHERE row_id < 10")


def test_streamed_raster_is_the_batch_raster(spark, sf, tmp_path):
    from mapfold.plans.catalog import WORLD, points

    p = points(spark, sf).select("x", "y")
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    raster_stream.keep_raster(stream, WORLD, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = {tuple(r) for r in raster.points_exact(p, WORLD).select("px", "py", "weight").collect()}
    assert {tuple(r) for r in raster_stream.total_raster(spark, str(tmp_path / "out")).select("px", "py", "weight").collect()} == want
