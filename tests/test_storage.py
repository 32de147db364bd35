"""Dictionaries in versions, sessions that engines share, admission, levels and the layout of objects."""

import json
import os
import re
import threading

import pytest
from pyspark.sql import functions as F

from mapfold.operators import grid, ingest, match, raster
from mapfold.plans.session import Config, MapEngine, NotReady, TooLarge
from mapfold.sources import dictionary, registry, tables
from mapfold.sources.sessions import Sessions
from mapfold.sources.store import Store

ROWS = [(1, "POINT(1 2)"), (2, "LINESTRING(0 0, 1 1)"), (3, "POINT(1 2)"), (4, "MULTIPOINT(1 1, 2 2)"), (5, "JUNK"), (6, None)]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "qid long, wkt string")


def shown(df):
    return sorted(str(r) for r in df.select("qid", "part_idx", "kind", "geom_id", "coords").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store(spark, tmp_path):
    store, at = Store(spark), f"{tmp_path}/deep/file"
    assert store.read(at) is None and store.names(str(tmp_path / "deep")) == []
    assert store.create(at, "one\ntwo") and not store.create(at, "other") and store.read(at) == "one\ntwo"
    assert store.names(str(tmp_path / "deep")) == ["file"] and store.age(at) < 60
    store.delete(at)
    assert not store.exists(at)


def test_versions(spark, tmp_path):
    v = dictionary.Versions(spark, f"{tmp_path}/d", buckets=4)
    assert v.read() is None and v.current() is None
    built = ingest.build_dictionary(rows_of(spark, ROWS))
    first = v.save(built, "a")
    assert shown(first) == shown(built) and shown(v.read("a")) == shown(built) and v.read("b") is None
    other = dictionary.Versions(spark, f"{tmp_path}/d", buckets=4)
    second = other.save(ingest.build_dictionary(rows_of(spark, ROWS[:2])), "b")
    assert shown(first) == shown(built)  # a reader of the version before still has its files
    assert second.count() == 2 and v.current().number == 2 and v.read("a") is None
    assert v.vacuum(older_s=3600) == [] and len(v.vacuum(older_s=0)) == 2
    assert shown(v.read("b")) == shown(second) and len(Store(spark).names(f"{tmp_path}/d")) == 2


def test_killed_between_data_and_manifest(spark, tmp_path):
    """What a killed engine has written is no version; the one before stays, and a later one is published over it."""
    v = dictionary.Versions(spark, f"{tmp_path}/d", buckets=2)
    v.save(ingest.build_dictionary(rows_of(spark, ROWS)), "a")
    before = shown(v.read("a"))
    lost = v.write_data(ingest.build_dictionary(rows_of(spark, [(9, "POINT(9 9)")])))  # killed here
    again = dictionary.Versions(spark, f"{tmp_path}/d", buckets=2)
    assert shown(again.read()) == before and again.current().version == "a"
    again.save(ingest.build_dictionary(rows_of(spark, [(8, "POINT(8 8)")])), "b")
    assert again.read("b").first()["qid"] == 8 and lost.data in again.vacuum(older_s=0)


def test_two_engines_publish_at_once(spark, tmp_path):
    """The same version: both end up with one's files. Others: both are published, one after the other."""
    folder = f"{tmp_path}/d"
    one, two, three = (dictionary.Versions(spark, folder, buckets=2) for _ in range(3))
    made = [v.write_data(ingest.build_dictionary(rows_of(spark, ROWS))) for v in (one, two, three)]
    found = {}

    def publish(v, m, version):
        found[m.data] = v.publish(m, version).inputFiles()[0]

    threads = [threading.Thread(target=publish, args=x) for x in zip((one, two, three), made, ("same", "same", "other"), strict=True)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    names = Store(spark).names(folder)
    published = [json.loads(Store(spark).read(f"{folder}/{n}"))["version"] for n in names if n.startswith("manifest")]
    assert sorted(set(published)) == ["other", "same"] and len(found) == 3
    assert shown(one.read(one.current().version)) == shown(ingest.build_dictionary(rows_of(spark, ROWS)))


def test_a_merge_decodes_what_is_new(spark, tmp_path):
    """Changed, new and gone rows, and texts that move to other ids."""
    v = dictionary.Versions(spark, f"{tmp_path}/d", buckets=2)
    v.save(ingest.build_dictionary(rows_of(spark, ROWS)), "a")
    after = [(1, "POINT(3 4)"), (2, "LINESTRING(0 0, 1 1)"), (7, "MULTIPOINT(1 1, 2 2)"), (8, "POINT(1 2)"), (9, "POINT(5 5)"), (5, "JUNK")]
    # a text that the old version knows isn't read: here it has been tampered with, and its components stay as they were
    known = v.read().withColumn("geom_id", F.lit(77).cast("long"))
    merged = {(r["qid"], r["part_idx"]): r["geom_id"] for r in ingest.build_dictionary(rows_of(spark, after), known=known).collect()}
    fresh = {(r["qid"], r["part_idx"]): r["geom_id"] for r in ingest.build_dictionary(rows_of(spark, after)).collect()}
    assert set(merged) == set(fresh) and {k for k, g in merged.items() if g != 77} == {(1, 0), (9, 0)} and merged[1, 0] == fresh[1, 0]
    assert shown(v.update(rows_of(spark, after), "b")) == shown(ingest.build_dictionary(rows_of(spark, after))) and v.current().version == "b"


def test_the_dictionary_side_of_a_join_is_not_shuffled(spark, tmp_path):
    v = dictionary.Versions(spark, f"{tmp_path}/d", buckets=4)
    made = v.save(ingest.build_dictionary(rows_of(spark, [(i, f"POINT({i % 90} {i % 80})") for i in range(500)])), "a")
    result = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("qid"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = match.match(result, made)
        text = plan(joined)
        assert joined.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1 and re.search(r"Bucketed: true", text)


@pytest.fixture(scope="module")
def fills(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("fill"))
    rows_of(spark, [(i, f"POINT({i % 170} {i % 80})") for i in range(3000)]).write.mode("overwrite").parquet(at)
    made = registry.Registry()
    made.register("", lambda s: s.read.parquet(at))
    return made


def engine(spark, tmp_path, fills=None, **config):
    made = MapEngine(spark, Config(cache_dir=f"{tmp_path}/cache", buckets=4, **config), fills)
    made.shared = Sessions(spark, f"{tmp_path}/sessions")
    return made


def test_sessions_outlive_their_engine(spark, tmp_path, fills):
    spark.range(100).selectExpr("id AS row_id", "concat('n', id) AS name", "id AS qid").createOrReplaceTempView("asked")
    one, two = engine(spark, tmp_path, fills), engine(spark, tmp_path, fills)
    q = "SELECT * FROM asked"
    a = one.query(q, "osm")
    view = raster.Viewport(-20037509.0, -15538712.0, 20037509.0, 15538712.0, 400, 300)
    want = sorted(map(tuple, one.raster(a["qid"], view).collect()))
    del one  # the engine is lost
    assert two.query(q, "osm") == a and two.row(a["qid"], 7) == {"name": "n7", "qid": 7}
    assert sorted(map(tuple, two.raster(a["qid"], view).collect())) == want
    assert two.levels(a["qid"])["spots"]._kept_at == engine(spark, tmp_path, fills).levels(a["qid"])["spots"]._kept_at
    three = engine(spark, tmp_path, fills)
    three.get(a["qid"])
    two.clear(a["qid"])
    with pytest.raises(NotReady):
        three.get(a["qid"])
    assert not os.path.exists(f"{tmp_path}/sessions/{a['qid']}")
    assert three.query(q, "osm")["qid"] != a["qid"]  # and the query runs anew
    again = engine(spark, tmp_path, fills, lifetime_min=60.0)
    os.makedirs(f"{tmp_path}/sessions/123/objects-x")  # of an engine that was killed before it was done
    again.evict()
    assert len(list(again.shared.names())) == 2
    again.evict(now=4e12)
    assert list(again.shared.names()) == []


def test_large_queries_are_refused_before_they_are_joined(spark, tmp_path, fills, monkeypatch):
    """By a sketch of the matched ids of a sample; no objects are written, and nothing is left."""
    written = []
    monkeypatch.setattr(tables, "keep", lambda df, name, *a, _keep=tables.keep, **k: written.append(name) or _keep(df, name, *a, **k))
    monkeypatch.setattr("mapfold.plans.session.ADMITTED", 500)
    spark.range(20_000).selectExpr("id AS row_id", "id AS qid").createOrReplaceTempView("many")
    small = engine(spark, tmp_path, fills, most_objects=1500)
    with pytest.raises(TooLarge, match="about"):
        small.query("SELECT * FROM many", "osm")
    assert written == ["result"] and list(small.shared.names()) == []
    with pytest.raises(TooLarge):
        small.query("SELECT row_id, concat('POINT(1 ', row_id % 80, ')') AS wkt FROM many")
    assert "objects" not in written and list(small.shared.names()) == []
    large = engine(spark, tmp_path, fills, most_objects=3000)
    assert large.query("SELECT * FROM many", "osm")["numobjects"] == 3000
    with pytest.raises(TooLarge, match="^2999"):  # within the sketch's error: counted
        engine(spark, tmp_path, fills, most_objects=2998).query("SELECT * FROM many WHERE row_id > 0", "osm")


def test_row_ids_must_differ(spark, tmp_path):
    with pytest.raises(ValueError, match="row_id"):
        engine(spark, tmp_path).query(spark.createDataFrame([(1, "POINT(1 1)"), (1, "POINT(2 2)")], "row_id long, wkt string"))
    assert engine(spark, tmp_path).query(spark.createDataFrame([((8 << 60) - (1 << 64) + (1 << 59) + 5,)], "qid long"))["numobjects"] == 1  # an id that is a point, without a dictionary


def test_maps_above_the_exact_level_do_not_read_objects(spark, tmp_path):
    rows = [(i, f"POINT({i % 170 + i / 5000} {i % 80})" if i % 3 else f"LINESTRING({i % 170} {i % 80}, {i % 170 + 1} {i % 80 + 1})") for i in range(2000)]
    e = engine(spark, tmp_path)
    s = e.query(spark.createDataFrame(rows, "row_id long, wkt string"))["qid"]
    session = e.get(s)
    for half in (300_000, 2_000_000, 9_000_000, 20_037_509):
        view = raster.Viewport(1e6 - half, 1e6 - 0.75 * half, 1e6 + half, 1e6 + 0.75 * half, 800, 600)
        assert view.level != "exact"
        kept = raster.heatmap(session.objects, view, *session.origin, e.levels(s))
        read = " ".join(kept.inputFiles())
        assert "/objects-" not in read and all(f"/{name}-" in read for name in (("spots", "subs") if view.level == "grid" else ("cells", "line_cells")))
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, raster.heatmap(session.objects, view, *session.origin).collect()))


def scanned_rows(df):
    """Rows that the file scans of a plan gave, after it has run."""
    df.collect()
    node, out, todo = None, 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "Scan" in node.nodeName():
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_a_click_reads_a_small_part_of_the_objects(spark, tmp_path):
    """Objects lie along a curve: pages that a click's box can't meet are left out."""
    n = 200_000
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40_000_000)) - 20_000_000.0
    made = match.as_components(spark.range(n).select(F.col("id").alias("row_id"), at(1).alias("x"), at(2).alias("y")))
    kept = tables.keep(made, "objects", str(tmp_path), along=grid.morton(F.col("x"), F.col("y")))
    loose = tables.keep(made.repartition(4, "row_id"), "loose", str(tmp_path))
    box = lambda df: df.where(F.col("x").between(1e6, 1.2e6) & F.col("y").between(-3e6, -2.8e6)).select("row_id", "x", "y")
    assert sorted(map(tuple, box(kept).collect())) == sorted(map(tuple, box(loose).collect()))
    assert scanned_rows(box(loose)) == n and scanned_rows(box(kept)) <= n / 8
    meets = lambda df: df.where((F.col("minx") <= 1.2e6) & (F.col("maxx") >= 1e6) & (F.col("miny") <= -2.8e6) & (F.col("maxy") >= -3e6)).select("row_id", "minx")
    assert scanned_rows(meets(kept)) <= n / 2


def test_morton_numbers(spark):
    rows = [(x, y) for x in range(8) for y in range(8)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in rows] + [(None, 1.0)], "x double, y double")
    got = {(r["x"], r["y"]): r["m"] for r in df.select("x", "y", grid.morton(F.col("x"), F.col("y"), 0.0, float(1 << 20)).alias("m")).collect()}
    assert got == {(x, y): sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(3)) for x, y in rows} | {(None, 1.0): None}


def test_fingerprints(spark, tmp_path):
    """Change with a file's path, size or time, and with the files there are; not with what else lies in the folder."""
    at = f"{tmp_path}/some folder"
    spark.range(10).repartition(3).write.parquet(at)
    read = lambda: registry.fingerprint(spark.read.parquet(at))
    first = read()
    open(f"{at}/_note", "w").write("x")
    assert read() == first and re.match(r"3-\d+-[0-9a-f]{32}$", first)
    assert registry.fingerprint(spark.read.parquet(*[f.removeprefix("file://").replace("%20", " ") for f in spark.read.parquet(at).inputFiles()[:2]])).startswith("2-")
    os.utime(next(f"{at}/{n}" for n in os.listdir(at) if n.startswith("part")), (1, 1))
    assert read() != first
    second = read()
    spark.range(5).write.mode("append").parquet(at)
    assert read() != second and registry.fingerprint(spark.range(3)).startswith("plan-")


def test_packed_ids_in_pages(spark, tmp_path):
    """Pages of one file are partitions; a range of records leaves out pages; what is written is read again."""
    import numpy as np

    from mapfold.sources import packed

    ids = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64, endpoint=False)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "0.ids").write_bytes(ids.tobytes() + b"odd")
    (tmp_path / "a" / "_skipped").write_bytes(b"12345678")
    (tmp_path / "a" / "1.ids").write_bytes(b"1234567")
    df = packed.read_ids(spark, str(tmp_path / "a"), 1000)
    assert df.rdd.getNumPartitions() == 5
    assert [r["qid"] for r in df.orderBy("position").collect()] == ids.tolist()
    part = packed.read_ids(spark, str(tmp_path / "a"), 1000, 2500, 2600)
    assert part.rdd.getNumPartitions() == 1 and [r["qid"] for r in part.orderBy("position").collect()] == ids[2500:2600].tolist()
    assert df.where("position = 4999").first()["qid"] == ids[4999] and packed.read_ids(spark, str(tmp_path / "a"), 1000, 5000).count() == 0
    out = str(tmp_path / "b")
    packed.write_ids(df.repartition(3, "position"), out)
    assert len(os.listdir(out)) == 3 and sorted(r["qid"] for r in packed.read_ids(spark, out).collect()) == sorted(ids.tolist())
    rows = packed.numbered(packed.read_ids(spark, out, 100))
    assert sorted(r["row"] for r in rows.collect()) == list(range(5000))
    assert packed._through_spark(spark, str(tmp_path / "a" / "0.ids")).count() == 5000
    assert packed.read_ids(spark, str(tmp_path / "nothing")).count() == 0


def test_simplified_lines_are_filters(spark):
    """The vertices of any tolerance from weights that were made once, as by Douglas and Peucker's recursion, and never further off than it."""
    import numpy as np

    from mapfold.functions import geometry
    from mapfold.operators import lookup

    def recursion(p, eps):
        if len(p) < 3:
            return p
        a, d = p[0], p[-1] - p[0]
        t = np.clip((p[1:-1] - a) @ d / (d @ d), 0, 1) if d @ d else np.zeros(len(p) - 2)
        far = np.hypot(*(p[1:-1] - a - t[:, None] * d).T)
        i = int(far.argmax()) + 1
        return np.concatenate([recursion(p[: i + 1], eps)[:-1], recursion(p[i:], eps)]) if far[i - 1] > eps else p[[0, -1]]

    r = np.random.default_rng(6)
    lines = {i: np.cumsum(r.normal(0, 10, (n, 2)), axis=0) for i, n in enumerate([1, 2, 3, 50, 400, 400])} | {6: np.array([[0, 0], [5, 5], [0, 0.0]])}
    rows = [(i, 0, "LINE", False, 0, 0, 0, "LINESTRING", [tuple(map(float, v)) for v in p]) for i, p in lines.items()] + [(9, 0, "POINT", False, 0, 0, 0, "POINT", [(1.0, 2.0)]), (10, 0, "NONE", False, 0, 0, 0, "NONE", None)]
    df = spark.createDataFrame(rows, "row_id int, part_idx int, kind string, hole boolean, ring int, poly int, member int, type string, coords array<struct<x:double,y:double>>")
    kept = tables.keep(df.withColumn("weights", ingest.weights_of()), "weighed")
    for eps in (0.0, 3.0, 40.0, 1e9):
        simple = lookup.geometries_of(kept, 10 * eps)
        assert not re.search("Python|Arrow", plan(simple))
        got = {r["row_id"]: np.array([tuple(c) for c in r["coords"]]) for r in simple.collect()}
        assert set(got) == {*lines, 9} and len(got[9]) == 1
        for i, p in lines.items():
            assert np.array_equal(got[i], recursion(p, eps))
            for v in p:  # no vertex is further off
                d = [geometry_distance(v, a, b) for a, b in zip(got[i][:-1], got[i][1:], strict=True)]
                assert len(p) == 1 or min(d) <= eps + 1e-9
        assert {r["row_id"]: len(r["coords"]) for r in lookup.geometries_of(df, 10 * eps).collect()} == {i: len(p) for i, p in got.items()}


def geometry_distance(v, a, b):
    d = b - a
    t = min(1, max(0, (v - a) @ d / (d @ d))) if d @ d else 0
    return ((v - a - t * d) @ (v - a - t * d)) ** 0.5


def test_small_pages_of_packed_ids_share_tasks(spark, tmp_path):
    """Tasks don't grow with the number of small pages, and every record is read once, from wherever reading starts."""
    import numpy as np

    from mapfold.sources import packed

    (tmp_path / "a").mkdir()
    for i, n in enumerate((50_000, 30_001, 0, 7)):
        (tmp_path / "a" / f"{i}.ids").write_bytes(np.arange(i * 100_000, i * 100_000 + n, dtype="<i8").tobytes())
    df = packed.read_ids(spark, str(tmp_path / "a"), 100)
    assert df.rdd.getNumPartitions() <= packed.MANY + 3
    want = [*range(50_000), *range(100_000, 130_001), *range(300_000, 300_007)]
    assert sorted(r["qid"] for r in df.select("qid").collect()) == want
    assert [r["qid"] for r in packed.numbered(df).orderBy("row").select("qid").collect()] == want
    part = packed.read_ids(spark, str(tmp_path / "a"), 100, 12_345, 29_999)
    assert part.rdd.getNumPartitions() <= packed.MANY + 3
    assert sorted(r["qid"] for r in part.select("qid").collect()) == [*range(12_345, 29_999), *range(112_345, 129_999)]
