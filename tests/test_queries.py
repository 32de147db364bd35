import glob
import os
import re
import pathlib

import pytest

import __spark_entry__ as entry
from mapfold.plans import catalog


@pytest.fixture(scope="module")
def db(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canonical(df):
    cols = sorted(df.columns)
    return df[cols].astype(str).replace({"None": "nan", "<NA>": "nan", "-0.0": "0.0"}).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, db, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = db.sql(catalog.ORACLES[name]).df()
        assert canonical(got).equals(canonical(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_query_is_a_nested_loop(spark, sf):
    for name in ("points_in_boxes", "lines_in_boxes", "nearest_of_many_clicks", "match_objects"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("NestedLoop|Cartesian", plan), name


def test_whole_tables_against_brute_force(spark):
    """Boxes and clicks of every row."""
    sf = "/root/testdata/sf0.01"
    p, d = (f(spark, sf).select("row_id", "x", "y").toPandas().sort_values("row_id") for f in (catalog.points, catalog.dup_points))
    held = {r["box"]: r for r in catalog.points_in_all_boxes(spark, sf).collect()}
    hit = {r["click"]: r for r in catalog.nearest_of_all_clicks(spark, sf).collect()}
    assert len(held) == len(d) > 200 and len(hit) > 120
    for i, x, y in d.itertuples(index=False):
        rows = p.row_id[(abs(p.x - x) <= 400000) & (abs(p.y - y) <= 300000)]
        assert held[i]["n"] == len(rows)
        assert not len(rows) or (held[i]["first_row"], held[i]["last_row"]) == (rows.min(), rows.max())
        far = ((p.x - x - 12345.6) ** 2 + (p.y - y + 23456.7) ** 2) ** 0.5
        assert (i in hit) == (far.min() < 500000)
        assert i not in hit or (hit[i]["row_id"] == p.row_id[far.idxmin()] and abs(hit[i]["d"] - far.min()) < 1e-2)
    assert catalog.click_radii_of_all(spark, sf).groupBy("row_id").count().where("count = 24").count() == len(p) > 10


def test_nothing_imports_the_llm_package():
    root = pathlib.Path(entry.__file__).parent
    for p in (root / "mapfold").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
