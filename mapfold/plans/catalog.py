"""The registered map queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, mercator, text, wkt
from ..operators import cluster, grid, ingest, lookup, match, raster, rings
from ..sources import packed, registry, sinks, tables
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "heatmap_points_exact"

#: Origin of the grids, and the views: the world, and a part of it with lines of several pixels a segment.
OX, OY = -20037509.0, -20037509.0
WORLD = raster.Viewport(-20037509.0, -15538712.0, 20037509.0, 15538712.0, 800, 600)
PART = raster.Viewport(-5009377.3, -3757033.7, 5009377.3, 3757033.7, 800, 600)
COARSE = raster.Viewport(-20037509.0, -15538712.0, 20037509.0, 15538712.0, 400, 300)
CLICK = (-1234567.8, 2345678.9, 900000.0)

X_SQL, Y_SQL = "lng*20037508.342789244/180", "6378137*ln(tan(pi()/4 + lat*pi()/360))"
P_SQL = f"SELECT row_id, qid, {X_SQL} AS x, {Y_SQL} AS y FROM ({fx.SQL['points']})"
D_SQL = f"SELECT row_id, qid, {X_SQL} AS x, {Y_SQL} AS y FROM ({fx.SQL['dup_points']})"
M_SQL = f"SELECT row_id, qid, part_idx, {X_SQL} AS x, {Y_SQL} AS y FROM ({fx.SQL['multi_points']})"
L_SQL = f"SELECT row_id, v, {X_SQL} AS x, {Y_SQL} AS y FROM ({fx.SQL['line_vertices']})"
A_SQL = f"SELECT row_id, ring_idx, v, {X_SQL} AS x, {Y_SQL} AS y FROM ({fx.SQL['area_vertices']})"
S_SQL = "SELECT row_id, v, x AS ax, y AS ay, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM ({v}) WINDOW w AS (PARTITION BY row_id ORDER BY v)"
DIST_SQL = "sqrt((px - ax - t*(qx-ax))*(px - ax - t*(qx-ax)) + (py - ay - t*(qy-ay))*(py - ay - t*(qy-ay)))"
T_SQL = "CASE WHEN (qx-ax)*(qx-ax)+(qy-ay)*(qy-ay) = 0 THEN 0 ELSE greatest(0, least(1, ((px-ax)*(qx-ax)+(py-ay)*(qy-ay)) / ((qx-ax)*(qx-ax)+(qy-ay)*(qy-ay)))) END"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def pixel_sql(view: raster.Viewport, source: str, x: str = "x", y: str = "y", n: str = "count(*)") -> str:
    px, py = f"trunc(({x} - ({view.x1})) / {view.x2 - view.x1!r} * {float(view.width)})", f"trunc({float(view.height)} - ({y} - ({view.y1})) / {view.y2 - view.y1!r} * {float(view.height)})"
    inside = f"({x} - ({view.x1})) / {view.x2 - view.x1!r} * {float(view.width)} > -1 AND {float(view.height)} - ({y} - ({view.y1})) / {view.y2 - view.y1!r} * {float(view.height)} > -1"
    return f"SELECT CAST({px} AS INT) AS px, CAST({py} AS INT) AS py, CAST({n} AS DOUBLE) AS weight FROM ({source}) WHERE {inside} AND {px} >= 0 AND {px} < {view.width} AND {py} >= 0 AND {py} < {view.height} GROUP BY 1, 2"


def cell_sql(v: str, o: float) -> str:
    return f"CAST(greatest(0, floor(({v} - ({o})) / 65536)) AS INT)"


def projected(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": mercator.x_of(F.col("lng")), "y": mercator.y_of(F.col("lat"))})


def points(spark: SparkSession, sf: str) -> DataFrame:
    return projected(fx.points(spark, sf)).select("row_id", "qid", "x", "y")


def dup_points(spark: SparkSession, sf: str) -> DataFrame:
    return projected(fx.dup_points(spark, sf)).select("row_id", "qid", "x", "y")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.project(ingest.vertices_to_lines(fx.line_vertices(spark, sf)))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.project(ingest.vertices_to_lines(fx.area_vertices(spark, sf), "AREA", "ring_idx"))


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Points of many parts, keyed by qid."""
    m = projected(fx.multi_points(spark, sf))
    return m.select("qid", "part_idx", F.lit("POINT").alias("kind"), "x", "y", F.col("x").alias("minx"), F.col("x").alias("maxx"), F.col("y").alias("miny"), F.col("y").alias("maxy"))


def whole(points: DataFrame) -> DataFrame:
    """Components of multipoints."""
    return points.withColumns({"hole": F.lit(False), "ring": F.lit(0), "poly": F.lit(0), "member": F.lit(0), "type": F.lit("MULTIPOINT"), "coords": F.array(F.struct("x", "y"))})


def r3(*columns: str) -> list:
    return [F.round(c, 3).alias(c) for c in columns]


# sources and result columns


@query(f"SELECT count(*) AS n FROM (SELECT 8 AS top FROM ({fx.SQL['folded']}) UNION ALL SELECT 0 FROM ({fx.SQL['points']})) WHERE top <> 8")
def scan_without_folded(spark, sf):
    both = fx.folded(spark, sf).unionByName(fx.points(spark, sf).select("row_id", "qid"))
    return registry.without_folded(both).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(nullif(wkt, 'JUNK')) AS n FROM ({fx.SQL['result']})")
def count_geometries(spark, sf):
    return registry.count(fx.result(spark, sf).select(F.nullif(F.col("wkt"), F.lit("JUNK")).alias("wkt")), "wkt")


@query(f"SELECT row_id, wkt FROM ({fx.SQL['result']}) ORDER BY row_id LIMIT 100 OFFSET 250")
def page_of_rows(spark, sf):
    return registry.page(fx.result(spark, sf).select("row_id", "wkt"), "row_id", 250, 100)


@query(f"SELECT CAST(floor(row_id / 400) AS BIGINT) AS page, count(*) AS n, min(row_id) AS first FROM ({fx.SQL['result']}) GROUP BY 1")
def page_ranges(spark, sf):
    return registry.pages(fx.result(spark, sf), "row_id", 400).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))


@query(f"SELECT row_id, wkt AS geometry FROM ({fx.SQL['result']})")
def last_column(spark, sf):
    df = fx.result(spark, sf)
    return df.select("row_id", F.col(ingest.last_column(df)).alias("geometry"))


@query(f"SELECT * FROM ({fx.SQL['result']}) WHERE row_id = 777")
def row_lookup(spark, sf):
    return match.row_of(fx.result(spark, sf), 777)


@query(f"SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '---' ELSE o_orderpriority END AS shown, upper(left(wkt, 3)) AS tag, CASE WHEN row_id % 3 = 0 THEN NULL ELSE concat('\"', o_orderpriority, '\\n\"') END AS js FROM ({fx.SQL['result']})")
def text_functions(spark, sf):
    df = fx.result(spark, sf).withColumn("lit", F.when(F.col("row_id") % 3 != 0, F.concat(F.lit('"'), "o_orderpriority", F.lit('"@en'))))
    raw = F.when(F.col("row_id") % 3 != 0, F.concat("o_orderpriority", F.lit("\n")))
    return df.select("row_id", text.shown(F.col("lit")).alias("shown"), F.upper(F.substring("wkt", 1, 3)).alias("tag"), text.json_string(raw).alias("js"))


# decoding and projection


@query(
    f"SELECT qid, 0 AS part_idx, CASE WHEN wkt = 'JUNK' OR wkt = 'POINT EMPTY' THEN 'NONE' ELSE 'POINT' END AS kind, round({X_SQL.replace('lng', 'a')}, 3) AS x, round({Y_SQL.replace('lat', 'b')}, 3) AS y FROM (SELECT *, TRY_CAST(regexp_extract(wkt, '\\((\\S+) (\\S+)\\)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(wkt, '\\((\\S+) (\\S+)\\)', 2) AS DOUBLE) AS b FROM ({fx.SQL['result']}))"
)
def decode_wkt(spark, sf):
    return ingest.project(ingest.decode(fx.result(spark, sf))).select("qid", "part_idx", "kind", *r3("x", "y"))


_MULTI_WKT = "CASE qid % 6 WHEN 0 THEN 'MULTIPOINT({p}, {q})' WHEN 1 THEN 'MULTIPOINT(({p}),({q}))' WHEN 2 THEN 'multilinestring(({p}, {q}),({q}, {p}, {q}))' WHEN 3 THEN 'POLYGON(({p}, {q}, 1 1),({p}, {q}, 2 2, {p}))' WHEN 4 THEN '\"MULTIPOLYGON((({p}, {q}, 1 1, {p})),(({p}, {q}, 3 3, {p}),({p}, 5 5, 6 6, {p})))\"^^<wkt>' ELSE 'GEOMETRYCOLLECTION(POINT({p}), LINESTRING({p}, {q}), GEOMETRYCOLLECTION(POINT(9 9)), POLYGON(({p}, {q}, 4 4, {p})))' END".replace("{p}", "1.5 2.5").replace("{q}", "3 4")
_MULTI_PARTS = [
    (0, "POINT", 0, 1, 1.5), (0, "POINT", 0, 1, 3.0), (1, "POINT", 0, 1, 1.5), (1, "POINT", 0, 1, 3.0), (2, "LINE", 0, 2, 1.5), (2, "LINE", 0, 3, 3.0),
    (3, "AREA", 0, 4, 1.5), (3, "AREA", 1, 4, 1.5), (4, "AREA", 0, 4, 1.5), (4, "AREA", 0, 4, 1.5), (4, "AREA", 1, 4, 1.5), (5, "POINT", 0, 1, 1.5), (5, "LINE", 0, 2, 1.5), (5, "AREA", 0, 4, 1.5),
]


@query("SELECT o_orderkey AS qid, kind, ring, n, x FROM orders JOIN (VALUES " + ", ".join(map(str, _MULTI_PARTS)) + ") t(k, kind, ring, n, x) ON o_orderkey % 6 = k")
def explode_multi(spark, sf):
    rows = fx.points(spark, sf).select("qid").withColumn("wkt", F.expr(_MULTI_WKT))
    return ingest.decode(rows).select("qid", "kind", "ring", F.size("coords").alias("n"), F.get("coords", 0)["x"].alias("x"))


_LONG = "concat({open}, array_join(transform(sequence(0, {n}), i -> concat({item})), ','), {close})"
#: Texts of some hundreds of vertices that a task makes and decodes; texts twenty times as long go by twentieths.
PER_TASK = 2000
_STEP = "CAST((qid + i) % 170 AS STRING), ' ', CAST(i % 80 AS STRING)"


@query("SELECT c_custkey AS qid, kind, n, CAST((c_custkey + k) % 170 AS DOUBLE) AS x FROM customer JOIN (VALUES ('POINT', 1, 5), ('LINE', 601, 0), ('AREA', 4, 0), ('POINT', 1, 9)) t(kind, n, k) ON true")
def decode_collections(spark, sf):
    """Collections of a line of 601 vertices, areas and points with further coordinates; a collection inside is skipped."""
    rows = ingest.spread(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("qid")), PER_TASK)
    line = _LONG.format(open="'GEOMETRYCOLLECTION Z (POINT Z (', CAST((qid + 5) % 170 AS STRING), ' 1 9), LINESTRING('", n=600, item=_STEP, close="'), GEOMETRYCOLLECTION(MULTIPOLYGON(((9 9, 8 8, 9 8))))'")
    rest = "concat(', POLYGON((', CAST(qid % 170 AS STRING), ' 1, 5 5, 6 6)), multipoint m ((', CAST((qid + 9) % 170 AS STRING), ' 3 4)))')"
    parts = ingest.decode(rows.withColumn("wkt", F.expr(f"concat({line}, {rest})")))
    return parts.select("qid", "kind", F.size("coords").alias("n"), F.get("coords", 0)["x"].alias("x"))


@query("SELECT s_suppkey AS qid, CAST(3001 AS BIGINT) AS n_rings, CAST(1000 AS BIGINT) AS n_holes, CAST(12004 AS BIGINT) AS n_vertices FROM supplier")
def decode_large_multipolygons(spark, sf):
    """Multipolygons of 2,001 members, the first with 1,000 holes, none of them closed."""
    rows = ingest.spread(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("qid")), PER_TASK // 20)
    ring = "'(', " + _STEP + ", ',1 1, 171 2)'"
    first = _LONG.format(open="'('", n=1000, item=ring, close="')'")
    others = _LONG.format(open="','", n=1999, item=f"'(', {ring}, ')'", close="''")
    parts = ingest.decode(rows.withColumn("wkt", F.expr(f"concat('MULTIPOLYGON(', {first}, {others}, ')')")))
    return parts.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rings"), F.count_if("hole").alias("n_holes"), F.sum(F.size("coords")).alias("n_vertices"))


@query(f"SELECT row_id, round(x, 3) AS x, round(y, 3) AS y, round(lng, 6) AS back_lng, round(lat, 6) AS back_lat FROM (SELECT *, {X_SQL} AS x, {Y_SQL} AS y FROM ({fx.SQL['points']}))")
def project_both_ways(spark, sf):
    p = projected(fx.points(spark, sf))
    return p.select("row_id", *r3("x", "y"), F.round(mercator.lng_of(F.col("x")), 6).alias("back_lng"), F.round(mercator.lat_of(F.col("y")), 6).alias("back_lat"))


@query(f"SELECT row_id, round(lo30/1073741823*360-180, 6) AS lng, round(hi30/1073741823*180-90, 6) AS lat FROM ({fx.SQL['folded']})")
def decode_folded(spark, sf):
    return fx.folded(spark, sf).where(mercator.is_folded(F.col("qid"))).select("row_id", F.round(mercator.folded_lng(F.col("qid")), 6).alias("lng"), F.round(mercator.folded_lat(F.col("qid")), 6).alias("lat"))


@query(f"SELECT row_id, trunc(x * 10) / 10 AS x, trunc(y * 10) / 10 AS y FROM ({P_SQL})")
def quantized(spark, sf):
    return points(spark, sf).select("row_id", mercator.quantize(F.col("x")).alias("x"), mercator.quantize(F.col("y")).alias("y"))


@query(f"SELECT row_id, n, round(minx, 3) AS minx, round(miny, 3) AS miny, round(maxx, 3) AS maxx, round(maxy, 3) AS maxy FROM (SELECT row_id, CAST(count(*) AS INT) AS n, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM ({L_SQL}) GROUP BY row_id)")
def line_boxes(spark, sf):
    return lines(spark, sf).select("row_id", F.size("coords").alias("n"), *r3("minx", "miny", "maxx", "maxy"))


@query(f"SELECT row_id, ring_idx AS ring, ring_idx > 0 AS hole, CAST(count(*) AS INT) AS n, round(min(x), 3) AS minx, round(max(y), 3) AS maxy FROM ({A_SQL}) GROUP BY row_id, ring_idx")
def area_rings(spark, sf):
    return areas(spark, sf).select("row_id", "ring", "hole", F.size("coords").alias("n"), *r3("minx", "maxy"))


@query(f"SELECT row_id, count(*) AS n, round(avg(x), 3) AS x, round(avg(y), 3) AS y FROM ({M_SQL}) GROUP BY row_id")
def multi_centroids(spark, sf):
    m = projected(fx.multi_points(spark, sf)).withColumn("kind", F.lit("POINT"))
    return match.centroids(m).select("row_id", "n", *r3("x", "y"))


@query(f"SELECT row_id, round(sqrt((x - ({CLICK[0]}))*(x - ({CLICK[0]})) + (y - {CLICK[1]})*(y - {CLICK[1]})), 3) AS d FROM ({P_SQL})")
def distances(spark, sf):
    return points(spark, sf).select("row_id", F.round(geometry.distance(F.col("x"), F.col("y"), F.lit(CLICK[0]), F.lit(CLICK[1])), 3).alias("d"))


@query(f"SELECT row_id, round(min({DIST_SQL}), 3) AS d FROM (SELECT *, {T_SQL} AS t FROM (SELECT *, {CLICK[0]} AS px, {CLICK[1]} AS py FROM ({S_SQL.format(v=L_SQL)}) WHERE qx IS NOT NULL)) GROUP BY row_id")
def line_distances(spark, sf):
    return lines(spark, sf).select("row_id", F.round(geometry.line_distance(F.lit(CLICK[0]), F.lit(CLICK[1]), F.col("coords")), 3).alias("d"))


@query(f"SELECT row_id, round(arg_min(ax + t*(qx-ax), d), 3) AS x, round(arg_min(ay + t*(qy-ay), d), 3) AS y FROM (SELECT *, {DIST_SQL} AS d FROM (SELECT *, {T_SQL} AS t FROM (SELECT *, {CLICK[0]} AS px, {CLICK[1]} AS py FROM ({S_SQL.format(v=L_SQL)}) WHERE qx IS NOT NULL))) GROUP BY row_id")
def snapped_to_line(spark, sf):
    foot = geometry.project_on(F.lit(CLICK[0]), F.lit(CLICK[1]), F.col("coords"))
    return lines(spark, sf).withColumn("f", foot).select("row_id", F.round("f.x", 3).alias("x"), F.round("f.y", 3).alias("y"))


_INSIDE_X = "(minx + (maxx - minx) * CASE WHEN row_id % 2 = 0 THEN 0.5 ELSE 1.25 END)"


@query(
    f"WITH a AS ({A_SQL}), b AS (SELECT row_id, ring_idx, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM a GROUP BY ALL), s AS (SELECT a.row_id, a.ring_idx, x AS ax, y AS ay, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM a WINDOW w AS (PARTITION BY row_id, ring_idx ORDER BY v)), c AS (SELECT row_id, ring_idx, {_INSIDE_X} AS px, (miny + maxy) / 2 AS py FROM b) SELECT row_id, ring_idx AS ring, count(*) FILTER ((ay > py) <> (qy > py) AND px < (qx - ax) * (py - ay) / (qy - ay) + ax) % 2 = 1 AS inside FROM s JOIN c USING (row_id, ring_idx) WHERE qx IS NOT NULL GROUP BY ALL"
)
def points_in_areas(spark, sf):
    return areas(spark, sf).select("row_id", "ring", geometry.contains(F.col("coords"), F.expr(_INSIDE_X), (F.col("miny") + F.col("maxy")) / 2).alias("inside"))


@query(f"SELECT row_id, CAST(unnest(range(1, 25)) AS INT) AS zoom, 100 * pow(2, 14 - unnest(range(1, 25))) AS rad FROM ({fx.SQL['points']})")
def click_radii(spark, sf):
    return fx.points(spark, sf).select("row_id", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("zoom")).select("row_id", "zoom", mercator.click_radius(F.col("zoom")).alias("rad"))


@query(ORACLES["click_radii"])
def click_radii_of_all(spark, sf):
    """The name click_radii had for every row while it took a few."""
    return click_radii(spark, sf)


_SEG = S_SQL.format(v=L_SQL)
_DENSE = "SELECT row_id, ax + (qx-ax)*k/n AS x, ay + (qy-ay)*k/n AS y FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, CAST(greatest(1, ceil(sqrt((ax-qx)*(ax-qx)+(ay-qy)*(ay-qy)) / {step})) AS BIGINT) AS n FROM ({seg}) WHERE qx IS NOT NULL)) UNION ALL SELECT row_id, ax, ay FROM ({seg}) WHERE qx IS NULL"


@query(f"SELECT row_id, count(*) AS n, round(sum(x), 1) AS sx, round(sum(y), 1) AS sy FROM ({_DENSE.format(step=5000.0, seg=_SEG)}) GROUP BY row_id")
def densified_lines(spark, sf):
    dense = lines(spark, sf).select("row_id", F.explode(geometry.densify(F.col("coords"), 5000.0)).alias("c"))
    return dense.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c.x"), 1).alias("sx"), F.round(F.sum("c.y"), 1).alias("sy"))


_EPS = 20000.0
_OFF = "sqrt((vx - t*dx)*(vx - t*dx) + (vy - t*dy)*(vy - t*dy))"
_SPLITS = f"""WITH RECURSIVE l AS (SELECT row_id, v, x, y FROM ({L_SQL})),
i(row_id, a, b) AS (SELECT row_id, 0, 31 FROM l WHERE v = 0 UNION ALL
  SELECT row_id, unnest([a, m]), unnest([m, b]) FROM (SELECT row_id, a, b, arg_max(v, d) AS m, max(d) AS d FROM (SELECT *, {_OFF} AS d FROM
    (SELECT *, CASE WHEN dx*dx + dy*dy = 0 THEN 0 ELSE greatest(0, least(1, (vx*dx + vy*dy) / (dx*dx + dy*dy))) END AS t FROM
      (SELECT i.row_id, i.a, i.b, v.v, v.x - p.x AS vx, v.y - p.y AS vy, q.x - p.x AS dx, q.y - p.y AS dy FROM i
        JOIN l v ON v.row_id = i.row_id AND v.v > i.a AND v.v < i.b JOIN l p ON p.row_id = i.row_id AND p.v = i.a JOIN l q ON q.row_id = i.row_id AND q.v = i.b))) GROUP BY ALL) WHERE d > {_EPS})"""


@query(f"{_SPLITS} SELECT row_id, 32 AS n, CAST(count(DISTINCT e) AS INT) AS n_kept, CAST(sum(DISTINCT e) AS BIGINT) AS places FROM (SELECT row_id, unnest([a, b]) AS e FROM i) GROUP BY row_id")
def simplified_lines(spark, sf):
    """How many vertices of each line are left, and the sum of their places."""
    l = lines(spark, sf).withColumn("weights", geometry.vertex_weights(F.col("coords")))
    kept = geometry.by_weights(F.transform("coords", lambda c, i: i.cast("long")), F.col("weights"), _EPS)
    return l.withColumn("kept", kept).select("row_id", F.size("coords").alias("n"), F.size("kept").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, i: a + i).alias("places"))


# joins


@query(f"SELECT l.l_orderkey AS row_id, m.qid, m.part_idx, round(m.x, 3) AS x FROM (SELECT l_orderkey, l_partkey FROM lineitem) l JOIN ({M_SQL}) m ON l.l_partkey = m.qid")
def match_objects(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("qid"))
    return match.match(rows, dictionary(spark, sf)).select("row_id", "qid", "part_idx", *r3("x"))


@query(f"SELECT row_id FROM ({fx.SQL['points']}) WHERE qid NOT IN (SELECT p_partkey FROM part)")
def unmatched_rows(spark, sf):
    return match.unmatched(fx.points(spark, sf).select("row_id", "qid"), dictionary(spark, sf)).select("row_id")


@query(
    f"SELECT b.row_id AS box, p.row_id FROM ({P_SQL}) p JOIN ({D_SQL}) b ON p.x BETWEEN b.x - 400000 AND b.x + 400000 AND p.y BETWEEN b.y - 300000 AND b.y + 300000"
)
def points_in_boxes(spark, sf):
    d = dup_points(spark, sf)
    boxes = d.select(F.col("row_id").alias("box"), (F.col("x") - 400000).alias("minx"), (F.col("x") + 400000).alias("maxx"), (F.col("y") - 300000).alias("miny"), (F.col("y") + 300000).alias("maxy"))
    return grid.box_pairs(points(spark, sf), boxes, "row_id", "box", OX, OY)


@query(f"SELECT b.row_id AS box, count(p.row_id) AS n, min(p.row_id) AS first_row, max(p.row_id) AS last_row FROM ({D_SQL}) b LEFT JOIN ({P_SQL}) p ON p.x BETWEEN b.x - 400000 AND b.x + 400000 AND p.y BETWEEN b.y - 300000 AND b.y + 300000 GROUP BY b.row_id")
def points_in_all_boxes(spark, sf):
    """(box, n, first_row, last_row): points_in_boxes for every row, summed up."""
    d = dup_points(spark, sf).select(F.col("row_id").alias("box"), "x", "y")
    sites = d.groupBy("x", "y").agg(F.min("box").alias("site"))
    boxes = sites.select("site", (F.col("x") - 400000).alias("minx"), (F.col("x") + 400000).alias("maxx"), (F.col("y") - 300000).alias("miny"), (F.col("y") + 300000).alias("maxy"))
    held = grid.join_boxes(points(spark, sf), boxes, "site", OX, OY).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
    found = sites.join(held, "site", "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), "first_row", "last_row")
    return d.join(found, ["x", "y"]).select("box", "n", "first_row", "last_row")


_LB = f"SELECT row_id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM ({L_SQL}) GROUP BY row_id"
_AB = f"SELECT row_id AS box, min(x) - 300000 AS minx, min(y) - 300000 AS miny, max(x) + 300000 AS maxx, max(y) + 300000 AS maxy FROM ({A_SQL}) WHERE ring_idx = 0 GROUP BY row_id"


@query(f"SELECT l.row_id, a.box FROM ({_LB}) l JOIN ({_AB}) a ON l.minx <= a.maxx AND l.maxx >= a.minx AND l.miny <= a.maxy AND l.maxy >= a.miny")
def lines_in_boxes(spark, sf):
    grow = lambda c, s: (F.col(c) + s * 300000.0).alias(c)
    boxes = areas(spark, sf).where("ring = 0").select(F.col("row_id").alias("box"), grow("minx", -1), grow("miny", -1), grow("maxx", 1), grow("maxy", 1))
    return grid.join_line_boxes(lines(spark, sf).select("row_id", "minx", "miny", "maxx", "maxy"), boxes, "box", OX, OY).select("row_id", "box")


@query(f"SELECT row_id, count(*) AS n_parts, string_agg(part_idx, ',' ORDER BY part_idx) AS parts FROM ({M_SQL}) GROUP BY row_id")
def reassembled(spark, sf):
    d = whole(dictionary(spark, sf)).withColumn("row_id", F.col("qid"))
    return match.reassemble(d).select("row_id", "n_parts", F.array_join(F.transform("parts", lambda p: p["part_idx"].cast("string")), ",").alias("parts"))


@query(f"SELECT r.row_id, o_orderpriority, o_totalprice FROM ({P_SQL}) p JOIN ({fx.SQL['result']}) r USING (row_id) WHERE x BETWEEN 0 AND 5000000 AND y BETWEEN 0 AND 5000000")
def attributes_of_hits(spark, sf):
    hits = points(spark, sf).where("x BETWEEN 0 AND 5000000 AND y BETWEEN 0 AND 5000000").select("row_id")
    return match.with_rows(hits, fx.result(spark, sf)).select("row_id", "o_orderpriority", "o_totalprice")


@query(f"SELECT kind, count(*) AS n, count(DISTINCT row_id) AS rows FROM (SELECT row_id, 'matched' AS kind FROM ({M_SQL}) UNION ALL SELECT row_id, 'folded' FROM ({fx.SQL['folded']}) WHERE hi30 > 0) GROUP BY kind")
def union_of_objects(spark, sf):
    folded = fx.folded(spark, sf)
    rows = folded.unionByName(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("qid")))
    objects = match.all_objects(rows, dictionary(spark, sf))
    kind = F.when(mercator.is_folded(F.col("qid")), "folded").otherwise("matched")
    return objects.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("rows"))


# aggregates, duplicates and clusters


@query("SELECT count(DISTINCT l_orderkey) AS num_objects FROM lineitem JOIN part ON l_partkey = p_partkey")
def num_objects(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("qid"))
    return match.count_objects(match.match(rows, dictionary(spark, sf).select("qid")))


@query(f"SELECT round(min(x) - 1, 3) AS minx, round(min(y) - 1, 3) AS miny, round(max(x) + 1, 3) AS maxx, round(max(y) + 1, 3) AS maxy FROM (SELECT x, y FROM ({P_SQL}) UNION ALL SELECT x, y FROM ({L_SQL}))")
def total_bounds(spark, sf):
    p = points(spark, sf).select(F.lit("POINT").alias("kind"), F.col("x").alias("minx"), F.col("x").alias("maxx"), F.col("y").alias("miny"), F.col("y").alias("maxy"))
    return match.bounds(p.unionByName(lines(spark, sf).select(*p.columns))).select(*r3("minx", "miny", "maxx", "maxy"))


@query(f"SELECT 'points' AS family, round(min(x) - 1, 3) AS minx, round(max(y) + 1, 3) AS maxy FROM ({P_SQL}) UNION ALL SELECT 'lines', round(min(x) - 1, 3), round(max(y) + 1, 3) FROM ({L_SQL})")
def bounds_by_family(spark, sf):
    p = points(spark, sf).select(F.lit("POINT").alias("kind"), F.col("x").alias("minx"), F.col("x").alias("maxx"), F.col("y").alias("miny"), F.col("y").alias("maxy"))
    return match.bounds_by_family(p.unionByName(lines(spark, sf).select(*p.columns))).select("family", *r3("minx", "maxy"))


@query(f"SELECT count(wkt) AS n_geometries, count(DISTINCT qid) AS n_ids, count(*) - count(DISTINCT qid) AS n_duplicates, count(DISTINCT wkt) AS n_unique FROM (SELECT row_id % 1000 AS qid, wkt FROM ({fx.SQL['result']}))")
def duplicate_counts(spark, sf):
    return ingest.duplicate_counts(fx.result(spark, sf).withColumn("qid", F.col("row_id") % 1000))


@query(f"SELECT qid, min(wkt) AS wkt FROM (SELECT row_id % 1000 AS qid, wkt FROM ({fx.SQL['result']})) GROUP BY qid")
def distinct_ids(spark, sf):
    rows = fx.result(spark, sf).withColumn("qid", F.col("row_id") % 1000)
    return ingest.first_texts(rows)


@query(f"SELECT count(*) AS n_rows, count(DISTINCT wkt) AS n_geoms, CAST(0 AS BIGINT) AS low, count(DISTINCT wkt) - 1 AS high FROM ({fx.SQL['result']})")
def shared_geometry_ids(spark, sf):
    ids = ingest.geometry_ids(fx.result(spark, sf))
    return ids.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("geom_id").alias("n_geoms"), F.min("geom_id").alias("low"), F.max("geom_id").alias("high"))


_CL = "row_number() OVER (PARTITION BY {by} ORDER BY row_id) - 1 AS cl_num, count(*) OVER (PARTITION BY {by}) AS cl_tot"


@query(f"SELECT row_id, qid, {_CL.format(by='qid')} FROM ({D_SQL})")
def clusters(spark, sf):
    return cluster.cluster(dup_points(spark, sf), ("qid",), span=400).select("row_id", "qid", "cl_num", "cl_tot")


@query(f"SELECT row_id, {_CL.format(by='x, y')} FROM ({D_SQL})")
def clusters_by_position(spark, sf):
    return cluster.cluster(dup_points(spark, sf), ("x", "y")).select("row_id", "cl_num", "cl_tot")


_ROW = "floor((sqrt(784.0 + 12.0 * greatest(0.0, cl_num - 25 + 2)) - 28.0) / 6.0)"
_SPIRAL = f"SELECT *, CASE WHEN cl_tot <= 25 THEN 2.0 * cl_tot * 100 ELSE (50.0 + 13.0 * rw) * 100 END AS rad, CASE WHEN cl_tot <= 25 THEN cl_num * 6.283185307179586 / cl_tot ELSE (cl_num - (25.0 * rw + 6.0 * (rw * rw + rw) / 2 - rw * 6.0)) * 6.283185307179586 / (25.0 + rw * 6.0) END AS ang FROM (SELECT *, {_ROW} AS rw FROM (SELECT *, {_CL.format(by='qid')} FROM ({D_SQL})))"


@query(f"SELECT row_id, round(CASE WHEN cl_tot > 1 THEN x + rad * sin(ang) ELSE x END, 3) AS dx, round(CASE WHEN cl_tot > 1 THEN y + rad * cos(ang) ELSE y END, 3) AS dy FROM ({_SPIRAL})")
def spiral_positions(spark, sf):
    return cluster.displaced(cluster.cluster(dup_points(spark, sf), ("qid",)), 100.0).select("row_id", *r3("dx", "dy"))


# grids


@query(f"SELECT {cell_sql('x', OX)} AS cell_x, {cell_sql('y', OY)} AS cell_y, count(*) AS n FROM ({P_SQL}) GROUP BY ALL")
def cell_counts(spark, sf):
    return grid.count_cells(points(spark, sf), OX, OY)


@query(f"SELECT row_id, CAST(unnest(range(c1, c2 + 1)) AS INT) AS cell_x, r1, r2 FROM (SELECT row_id, {cell_sql('minx', OX)} AS c1, {cell_sql('maxx', OX)} AS c2, {cell_sql('miny', OY)} AS r1, {cell_sql('maxy', OY)} AS r2 FROM ({_LB}))")
def covered_columns(spark, sf):
    c = grid.covered(lines(spark, sf).select("row_id", "minx", "miny", "maxx", "maxy"), OX, OY)
    return c.groupBy("row_id", "cell_x").agg(F.min("cell_y").alias("r1"), F.max("cell_y").alias("r2"))


_SUBS = f"SELECT row_id, v, cx, cy, CAST(floor((x - ({OX}) - cx * 65536) / 256) AS INT) AS sx, CAST(floor((y - ({OY}) - cy * 65536) / 256) AS INT) AS sy FROM (SELECT *, {cell_sql('x', OX)} AS cx, {cell_sql('y', OY)} AS cy FROM ({L_SQL}))"
_HIST = f"SELECT cx AS cell_x, cy AS cell_y, sx AS sub_x, sy AS sub_y, count(*) AS n FROM (SELECT *, lag((cx, cy, sx, sy)) OVER (PARTITION BY row_id ORDER BY v) AS prev FROM ({_SUBS})) WHERE prev IS NULL OR prev <> (cx, cy, sx, sy) GROUP BY ALL"


@query(_HIST)
def vertex_histogram(spark, sf):
    return grid.vertex_histogram(_subs(spark, sf))


@query(_HIST)
def vertex_histogram_by_window(spark, sf):
    v = projected(fx.line_vertices(spark, sf)).withColumnRenamed("row_id", "obj")
    return grid.vertex_histogram(grid.line_sub_cells(v, OX, OY))


def _subs(spark, sf):
    return grid.line_sub_cells_of(lines(spark, sf).withColumnRenamed("row_id", "obj"), OX, OY)


@query(f"SELECT row_id, round(greatest(minx, {PART.x1}), 3) AS minx, round(greatest(miny, {PART.y1}), 3) AS miny, round(least(maxx, {PART.x2}), 3) AS maxx, round(least(maxy, {PART.y2}), 3) AS maxy FROM ({_LB})")
def clipped_boxes(spark, sf):
    own = {c: F.col(c) for c in ("minx", "miny", "maxx", "maxy")}
    view = {"minx": F.lit(PART.x1), "miny": F.lit(PART.y1), "maxx": F.lit(PART.x2), "maxy": F.lit(PART.y2)}
    both = grid.box_overlap(own, view)
    return lines(spark, sf).select("row_id", *[F.round(e, 3).alias(c) for c, e in both.items()])


# rasters

_HEAT = pixel_sql(WORLD, P_SQL)


@query(_HEAT)
def heatmap_points_exact(spark, sf):
    return raster.points_exact(points(spark, sf), WORLD)


@query(pixel_sql(PART, f"SELECT * FROM (SELECT *, {cell_sql('x', OX)} AS cx, {cell_sql('y', OY)} AS cy FROM ({P_SQL})) WHERE cx BETWEEN floor(({PART.x1} - ({OX})) / 65536) AND floor(({PART.x2} - ({OX})) / 65536) AND cy BETWEEN floor(({PART.y1} - ({OY})) / 65536) AND floor(({PART.y2} - ({OY})) / 65536)"))
def heatmap_points_grid(spark, sf):
    return raster.points_by_grid(points(spark, sf), PART, OX, OY)


@query(pixel_sql(COARSE, f"SELECT {OX} + cx * 65536 AS x, {OY} + cy * 65536 AS y, n FROM (SELECT {cell_sql('x', OX)} AS cx, {cell_sql('y', OY)} AS cy, count(*) AS n FROM ({P_SQL}) GROUP BY ALL)", n="sum(n)"))
def heatmap_points_cell(spark, sf):
    return raster.points_by_cell(points(spark, sf), COARSE, OX, OY)


_SIDES = [f"((qx - ax) * ({y} - ay) - (qy - ay) * ({x} - ax))" for x in (PART.x1, PART.x2) for y in (PART.y1, PART.y2)]
_SEEN = f"SELECT DISTINCT row_id FROM ({_SEG}) WHERE qx IS NOT NULL AND least(ax, qx) <= {PART.x2} AND greatest(ax, qx) >= {PART.x1} AND least(ay, qy) <= {PART.y2} AND greatest(ay, qy) >= {PART.y1} AND least({', '.join(_SIDES)}) <= 0 AND greatest({', '.join(_SIDES)}) >= 0"


@query(pixel_sql(PART, f"SELECT x, y FROM ({_DENSE.format(step=repr(PART.resolution), seg=_SEG)}) WHERE row_id IN ({_SEEN})"))
def heatmap_lines_exact(spark, sf):
    return raster.lines_exact(lines(spark, sf), PART)


@query(pixel_sql(WORLD, f"SELECT {OX} + cell_x * 65536 + sub_x * 256 AS x, {OY} + cell_y * 65536 + sub_y * 256 AS y, n FROM ({_HIST})", n="sum(n)"))
def heatmap_lines_sub_cell(spark, sf):
    return raster.lines_by_sub_cell(grid.vertex_histogram(_subs(spark, sf)), WORLD, OX, OY)


@query(pixel_sql(COARSE, f"SELECT {OX} + cell_x * 65536 AS x, {OY} + cell_y * 65536 AS y, n FROM ({_HIST})", n="sum(n)"))
def heatmap_lines_cell(spark, sf):
    return raster.lines_by_cell(grid.vertex_histogram(_subs(spark, sf)), COARSE, OX, OY)


@query(f"SELECT px, py, CAST(sum(weight) AS DOUBLE) AS weight FROM ({_HEAT} UNION ALL {pixel_sql(WORLD, D_SQL)}) GROUP BY ALL")
def merged_rasters(spark, sf):
    return raster.merge(raster.points_exact(points(spark, sf), WORLD), raster.points_exact(dup_points(spark, sf), WORLD))


@query(f"SELECT px, py, round(weight / max(weight) OVER (), 9) AS share FROM ({_HEAT})")
def normalised_raster(spark, sf):
    return raster.normalise(raster.points_exact(points(spark, sf), WORLD)).select("px", "py", F.round("share", 9).alias("share"))


_SQUARE = "SELECT DISTINCT CAST(px + dx AS INT) AS px, CAST(py + dy AS INT) AS py, 1.0::DOUBLE AS weight FROM ({p}) CROSS JOIN (SELECT unnest(range(-2, 2)) AS dx) CROSS JOIN (SELECT unnest(range(-2, 2)) AS dy) WHERE px + dx BETWEEN 0 AND 799 AND py + dy BETWEEN 0 AND 599"


@query(_SQUARE.format(p=pixel_sql(WORLD, D_SQL)))
def object_squares(spark, sf):
    return raster.squares(raster.points_exact(dup_points(spark, sf), WORLD), WORLD)


@query(_SQUARE.format(p=pixel_sql(PART, f"SELECT CASE WHEN cl_tot > 1 THEN x + rad * 100 * sin(ang) ELSE x END AS dx, CASE WHEN cl_tot > 1 THEN y + rad * 100 * cos(ang) ELSE y END AS dy FROM ({_SPIRAL}) WHERE x BETWEEN {PART.x1} AND {PART.x2} AND y BETWEEN {PART.y1} AND {PART.y2}", "dx", "dy")))
def object_spirals(spark, sf):
    return raster.clusters_as_objects(cluster.displaced(cluster.cluster(dup_points(spark, sf), ("qid",)), 10000.0), PART)


_UX, _UY = f"{PART.width} / ({PART.x2} - ({PART.x1}))", f"{PART.height} / ({PART.y2} - ({PART.y1}))"
_ENDS = f"SELECT (x - ({PART.x1})) * ({_UX}) AS x0, (dx - ({PART.x1})) * ({_UX}) AS x1, {float(PART.height)} - (y - ({PART.y1})) * ({_UY}) AS y0, {float(PART.height)} - (dy - ({PART.y1})) * ({_UY}) AS y1 FROM (SELECT x, y, x + rad * 100 * sin(ang) AS dx, y + rad * 100 * cos(ang) AS dy FROM ({_SPIRAL}) WHERE cl_tot > 1 AND x BETWEEN {PART.x1} AND {PART.x2} AND y BETWEEN {PART.y1} AND {PART.y2})"


@query(f"SELECT DISTINCT px, py FROM (SELECT CAST(floor(x0 + (x1 - x0) * k / n) AS INT) AS px, CAST(floor(y0 + (y1 - y0) * k / n) AS INT) AS py FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, CAST(greatest(1, ceil(greatest(abs(x1 - x0), abs(y1 - y0)))) AS BIGINT) AS n FROM ({_ENDS})))) WHERE px BETWEEN 0 AND {PART.width - 1} AND py BETWEEN 0 AND {PART.height - 1}")
def object_leaders(spark, sf):
    return raster.leaders(cluster.displaced(cluster.cluster(dup_points(spark, sf), ("qid",)), 10000.0), PART)


_DISC = "SELECT dx, dy, 1 - sqrt(dx*dx + dy*dy) / 4 AS w FROM (SELECT unnest(range(-3, 4)) AS dx) CROSS JOIN (SELECT unnest(range(-3, 4)) AS dy) WHERE sqrt(dx*dx + dy*dy) <= 3"


@query(f"SELECT CAST(px + dx AS INT) AS px, CAST(py + dy AS INT) AS py, round(sum(weight * w), 6) AS weight FROM ({pixel_sql(WORLD, D_SQL)}) CROSS JOIN ({_DISC}) WHERE px + dx BETWEEN 0 AND 799 AND py + dy BETWEEN 0 AND 599 GROUP BY ALL")
def stamped_raster(spark, sf):
    return raster.stamp(raster.points_exact(dup_points(spark, sf), WORLD), WORLD).select("px", "py", F.round("weight", 6).alias("weight"))


_STOPS = [f"[{', '.join(str(c[i]) for c in raster.HEAT_STOPS)}][CAST(least(9, floor(share * 10)) AS INT) + 1]" for i in range(3)]


@query(f"SELECT px, py, {', '.join(f'CAST({s} AS INT) AS {c}' for s, c in zip(_STOPS, 'rgb', strict=True))}, 255 AS a FROM (SELECT px, py, weight / max(weight) OVER () AS share FROM ({_HEAT}))")
def coloured_heatmap(spark, sf):
    return raster.colour_heat(raster.normalise(raster.points_exact(points(spark, sf), WORLD)))


# lookups and sinks

_NEARP = f"SELECT row_id, sqrt((x - ({CLICK[0]}))*(x - ({CLICK[0]})) + (y - {CLICK[1]})*(y - {CLICK[1]})) AS d, 0 AS k, x AS hx, y AS hy FROM ({P_SQL}) WHERE abs(x - ({CLICK[0]})) <= {CLICK[2]} AND abs(y - {CLICK[1]}) <= {CLICK[2]}"
_NEARL = f"SELECT row_id, min(d) AS d, 1 AS k, arg_min(ax + t*(qx-ax), d) AS hx, arg_min(ay + t*(qy-ay), d) AS hy FROM (SELECT *, {DIST_SQL} AS d FROM (SELECT *, {T_SQL} AS t FROM (SELECT *, {CLICK[0]} AS px, {CLICK[1]} AS py FROM ({_SEG}) WHERE qx IS NOT NULL))) GROUP BY row_id"


@query(f"SELECT row_id, round(d, 3) AS d, k AS kind_rank, round(hx, 3) AS hit_x, round(hy, 3) AS hit_y FROM ({_NEARP} UNION ALL {_NEARL}) WHERE d < {CLICK[2]} ORDER BY d, k, row_id LIMIT 25")
def nearest_objects(spark, sf):
    found = lookup.nearest(points(spark, sf), lines(spark, sf), *CLICK, k=25)
    return found.select("row_id", F.round("d", 3).alias("d"), "kind_rank", F.round("hit_x", 3).alias("hit_x"), F.round("hit_y", 3).alias("hit_y"))


@query(f"SELECT arg_min(row_id, d) AS id, round(min(d), 3) AS d FROM ({_NEARP})")
def nearest_point(spark, sf):
    d = geometry.distance(F.col("x"), F.col("y"), F.lit(CLICK[0]), F.lit(CLICK[1]))
    near = (F.abs(F.col("x") - CLICK[0]) <= CLICK[2]) & (F.abs(F.col("y") - CLICK[1]) <= CLICK[2])
    return lookup.argmin(points(spark, sf).where(near), d, "row_id").select("id", F.round("d", 3).alias("d"))


_CLICKS = f"SELECT row_id AS click, x + 12345.6 AS cx, y - 23456.7 AS cy FROM ({D_SQL})"


@query(f"SELECT click, arg_min(row_id, d) AS row_id, round(min(d), 3) AS d FROM (SELECT click, p.row_id, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) AS d FROM ({P_SQL}) p JOIN ({_CLICKS}) c ON abs(x - cx) <= 500000 AND abs(y - cy) <= 500000) WHERE d < 500000 GROUP BY click")
def nearest_of_many_clicks(spark, sf):
    clicks = dup_points(spark, sf).select(F.col("row_id").alias("click"), (F.col("x") + 12345.6).alias("x"), (F.col("y") - 23456.7).alias("y"), F.lit(500000.0).alias("rad"))
    return lookup.nearest_of_many(clicks, points(spark, sf), OX, OY).select("click", "row_id", F.round("d", 3).alias("d"))


@query(ORACLES["nearest_of_many_clicks"])
def nearest_of_all_clicks(spark, sf):
    """nearest_of_many_clicks where many clicks are equal: each site is looked up once."""
    d = dup_points(spark, sf).select(F.col("row_id").alias("click"), (F.col("x") + 12345.6).alias("x"), (F.col("y") - 23456.7).alias("y"))
    sites = d.groupBy("x", "y").agg(F.min("click").alias("site"))
    found = lookup.nearest_of_many(sites.select(F.col("site").alias("click"), "x", "y", F.lit(500000.0).alias("rad")), points(spark, sf), OX, OY)
    found = sites.join(found, F.col("site") == F.col("click")).select("x", "y", "row_id", F.round("d", 3).alias("d"))
    return d.join(found, ["x", "y"]).select("click", "row_id", "d")


@query(f"SELECT row_id, part_idx, round(x, 3) AS x, round(y, 3) AS y FROM ({M_SQL}) WHERE row_id = 17")
def geometry_by_id(spark, sf):
    d = whole(dictionary(spark, sf)).withColumn("row_id", F.col("qid"))
    g = lookup.geometry_of(d, 17, 10.0)
    return g.select(F.lit(17).cast("long").alias("row_id"), "part_idx", F.round(F.get("coords", 0)["x"], 3).alias("x"), F.round(F.get("coords", 0)["y"], 3).alias("y"))


_FEATURE = "concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[', CAST(CAST(round(a, 6) AS DECIMAL(30,6)) AS VARCHAR), ',', CAST(CAST(round(b, 6) AS DECIMAL(30,6)) AS VARCHAR), ']},\"properties\":{\"row_id\":', row_id, ',\"o_orderpriority\":\"', o_orderpriority, '\"}}')"


@query(f"SELECT {_FEATURE} AS feature FROM (SELECT *, TRY_CAST(regexp_extract(wkt, '\\((\\S+) (\\S+)\\)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(wkt, '\\((\\S+) (\\S+)\\)', 2) AS DOUBLE) AS b FROM ({fx.SQL['result']})) WHERE a IS NOT NULL")
def geojson_features(spark, sf):
    return sinks.features(fx.result(spark, sf).select("row_id", "o_orderpriority", "wkt"))


_DEC = "CAST(CAST(round({v}, 6) AS DECIMAL(30,6)) AS VARCHAR)"


@query(f"SELECT concat('{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"LineString\",\"coordinates\":[', string_agg(concat('[', {_DEC.format(v='lng')}, ',', {_DEC.format(v='lat')}, ']'), ',' ORDER BY v), ']}},\"properties\":{{}}}}') AS feature FROM ({fx.SQL['line_vertices']}) WHERE row_id = 7")
def geojson_of_one(spark, sf):
    parts = lines(spark, sf).where("row_id = 7").select(F.lit(0).alias("part_idx"), "kind", "ring", "poly", "member", "type", sinks.unproject(F.col("coords")).alias("coords"))
    return sinks.geojson_of_parts(parts)


#: WKT and GeoJSON of the same geometries; {a} and {b} are whole numbers.
_SHAPES = [
    ("POLYGON(({a} {b}, 90 {b}, 90 85, {a} {b}),({a} 81, {a} 82, 89 82, {a} 81))", "Polygon", "[[[{a},{b}],[90,{b}],[90,85],[{a},{b}]],[[{a},81],[{a},82],[89,82],[{a},81]]]"),
    ("MULTIPOLYGON((({a} {b}, 90 {b}, 90 85)),((1 1, 2 1, {a} {b}, 1 1),(3 3, 4 3, 4 4, 3 3)))", "MultiPolygon", "[[[[{a},{b}],[90,{b}],[90,85],[{a},{b}]]],[[[1,1],[2,1],[{a},{b}],[1,1]],[[3,3],[4,3],[4,4],[3,3]]]]"),
    ("MULTIPOINT(({a} {b}),(3 4))", "MultiPoint", "[[{a},{b}],[3,4]]"),
    ("multilinestring(({a} {b}, 3 4),(5 6, 7 8, 9 9))", "MultiLineString", "[[[{a},{b}],[3,4]],[[5,6],[7,8],[9,9]]]"),
    ("MULTIPOLYGON((({a} {b}, 90 {b}, 90 85, {a} {b})))", "MultiPolygon", "[[[[{a},{b}],[90,{b}],[90,85],[{a},{b}]]]]"),
    ("GEOMETRYCOLLECTION(POINT({a} {b}), MULTIPOINT(1 2, 3 4), POLYGON((0 0, 5 0, {a} {b}, 0 0),(1 1, 2 1, 2 2, 1 1)))", "GeometryCollection",
     '[{{"type":"Point","coordinates":[{a},{b}]}},{{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}},{{"type":"Polygon","coordinates":[[[0,0],[5,0],[{a},{b}],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}}]'),
]


def _shape_sql() -> str:
    """The features' text by SQL: numbers get six decimals, and keys are put in."""
    import re

    whens = []
    for i, (_, kind, body) in enumerate(_SHAPES):
        numbers = re.sub(r"(?<![\w.])(\d+)(?=[,\]])", r"\1.000000", body)
        made = numbers.replace("{{", "{").replace("}}", "}").replace("{a}", "@a.000000").replace("{b}", "@b.000000")
        whens.append(f"WHEN {i} THEN '{{\"type\":\"{kind}\",\"{'geometries' if kind == 'GeometryCollection' else 'coordinates'}\":{made}}}'")
    shape = f"replace(replace(CASE c_custkey % {len(_SHAPES)} {' '.join(whens)} END, '@a', (11 + c_custkey % 79)::VARCHAR), '@b', (12 + c_custkey % 67)::VARCHAR)"
    named = "CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '\"' || c_name || '\"' END"
    return f"SELECT concat('{{\"type\":\"Feature\",\"geometry\":', {shape}, ',\"properties\":{{\"id\":', c_custkey, ',\"name\":', {named}, '}}}}') AS feature FROM customer"


@query(_shape_sql())
def geojson_areas(spark, sf):
    """Areas with holes, multi-geometries and collections, with null properties."""
    numbers = {"{a}": "CAST(11 + c_custkey % 79 AS STRING)", "{b}": "CAST(12 + c_custkey % 67 AS STRING)"}
    whens = [f"WHEN {i} THEN replace(replace('{w}', '{{a}}', {numbers['{a}']}), '{{b}}', {numbers['{b}']})" for i, (w, *_) in enumerate(_SHAPES)]
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    return sinks.features(rows.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name", f"CASE c_custkey % {len(_SHAPES)} {' '.join(whens)} END AS wkt"))


@query(f"SELECT row_id // 4 AS row_id, row_id * 2 + ring_idx AS ring_id, CAST(dense_rank() OVER (PARTITION BY row_id // 4 ORDER BY row_id) - 1 AS INT) AS poly, CAST(ring_idx AS INT) AS ring, ring_idx > 0 AS hole FROM (SELECT DISTINCT row_id, ring_idx FROM ({A_SQL}))")
def ring_forest(spark, sf):
    """Shells and holes of areas whose rings come without order, four areas a row."""
    r = areas(spark, sf).withColumns({"ring_id": F.col("row_id") * 2 + F.col("ring"), "row_id": F.expr("row_id div 4")})
    return rings.assemble(r.select("row_id", "ring_id", "coords", "minx", "miny", "maxx", "maxy"), ox=OX, oy=OY).select("row_id", "ring_id", "poly", "ring", "hole")


#: A view of 0.6 units a pixel, off the middle, so that no step falls on an edge between pixels.
CLOSE = raster.Viewport(-247.3, -171.9, 232.7, 188.1, 800, 600)
_LONG_SEG = f"SELECT row_id, 0 AS v, -20000000.0 - x AS ax, y / 1000 - 5000 AS ay, 20000000.0 + x AS qx, 5000 - y / 1000 AS qy FROM ({L_SQL}) WHERE v = 0"
_CLOSE_DENSE = f"SELECT row_id, ax + (qx - ax) * k / n AS x, ay + (qy - ay) * k / n AS y FROM (SELECT *, unnest(range(k0, k1 + 1)) AS k FROM (SELECT *, CAST(floor(n / 2 - 2000) AS BIGINT) AS k0, CAST(ceil(n / 2 + 2000) AS BIGINT) AS k1 FROM (SELECT *, CAST(greatest(1, ceil(sqrt((ax-qx)*(ax-qx)+(ay-qy)*(ay-qy)) / {CLOSE.resolution!r})) AS BIGINT) AS n FROM ({_LONG_SEG}))))"


@query(pixel_sql(CLOSE, _CLOSE_DENSE))
def heatmap_lines_close(spark, sf):
    """Lines across the whole map, each through the middle of the view, at 0.6 units a pixel: steps of a line are counted from its start, 30 million before the view."""
    first = lines(spark, sf).select("row_id", F.get("coords", 0).alias("c"))
    at = lambda s: F.struct((s * (F.lit(20000000.0) + F.col("c.x"))).alias("x"), (s * (F.lit(5000.0) - F.col("c.y") / 1000)).alias("y"))
    long = first.select("row_id", F.array(at(F.lit(-1.0)), at(F.lit(1.0))).alias("coords"))
    return raster.lines_exact(long.withColumns(geometry.bbox(F.col("coords"))), CLOSE)


# the dictionary, packed ids and sessions

_LNG_LAT = "TRY_CAST(regexp_extract(wkt, '\\((\\S+) (\\S+)\\)', 1) AS DOUBLE) AS lng, TRY_CAST(regexp_extract(wkt, '\\((\\S+) (\\S+)\\)', 2) AS DOUBLE) AS lat"
_READ = f"SELECT *, {_LNG_LAT} FROM ({fx.SQL['result']})"


@query(f"SELECT k AS qid, CASE WHEN lng IS NULL THEN 'NONE' ELSE 'POINT' END AS kind, round({X_SQL}, 3) AS x, round({Y_SQL}, 3) AS y, count(*) OVER (PARTITION BY lng, lat) AS n_same FROM (SELECT k, {_LNG_LAT} FROM (SELECT row_id % 1000 AS k, min(wkt) AS wkt FROM ({fx.SQL['result']}) GROUP BY k))")
def built_dictionary(spark, sf):
    """The dictionary of repeated ids, and how many ids share each geometry."""
    made = ingest.build_dictionary(fx.result(spark, sf).withColumn("qid", F.col("row_id") % 1000))
    same = made.groupBy("geom_id", "geom_id_2").agg(F.count(F.lit(1)).alias("n_same"))
    return made.join(same, ["geom_id", "geom_id_2"]).select("qid", "kind", *r3("x", "y"), "n_same")


@query("SELECT o_orderkey AS qid, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders")
def packed_ids(spark, sf):
    """Ids written as packed files, in order, and read again in pages of 1,000 records."""
    import uuid

    path = f"{tables.shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    ids = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("qid"))
    files = max(4, -(-ids.count() // 2_000_000))
    packed.write_ids(ids.repartitionByRange(files, "qid").sortWithinPartitions("qid"), path)
    return packed.numbered(packed.read_ids(spark, path, 1000)).select("qid", "row")


def _session(spark: SparkSession, sf: str, rows: DataFrame):
    from .session import MapEngine

    engine = MapEngine(spark)
    return engine, engine.query(rows)["qid"]


@query(f"SELECT row_id, CASE WHEN lng IS NULL THEN 'NONE' ELSE 'POINT' END AS kind, round({X_SQL}, 3) AS x, round({Y_SQL}, 3) AS y, o_orderpriority FROM ({_READ})")
def session_objects(spark, sf):
    """A session's objects with their rows' attributes."""
    engine, s = _session(spark, sf, fx.result(spark, sf).select("row_id", "o_orderpriority", "wkt"))
    session = engine.get(s)
    return match.with_rows(session.objects.select("row_id", "kind", "x", "y"), session.result).select("row_id", "kind", *r3("x", "y"), "o_orderpriority")


@query(f"SELECT CAST(row_id AS VARCHAR) AS row_id, o_orderpriority, wkt FROM ({fx.SQL['result']})")
def session_export(spark, sf):
    """All rows of a session as a tab-separated file, read again."""
    engine, s = _session(spark, sf, fx.result(spark, sf).selectExpr("row_id", "row_id AS id", "o_orderpriority", "wkt"))
    path = f"{engine.shared.at(s)}/export"
    engine.export(s, path, "tsv")
    return registry.read_tsv(spark, path).withColumnRenamed("id", "row_id")


_ORIGIN = f"SELECT min(x) - 1 AS ox, min(y) - 1 AS oy FROM ({P_SQL})"
_SESSION_CELLS = f"SELECT ox + cx * 65536 AS x, oy + cy * 65536 AS y, n FROM (SELECT ox, oy, CAST(floor((x - ox) / 65536) AS INT) AS cx, CAST(floor((y - oy) / 65536) AS INT) AS cy, count(*) AS n FROM ({P_SQL}), ({_ORIGIN}) GROUP BY ALL)"


@query(pixel_sql(COARSE, _SESSION_CELLS, n="sum(n)"))
def session_coarse_map(spark, sf):
    """The coarsest map of a session, from its levels."""
    engine, s = _session(spark, sf, points_as_wkt(spark, sf))
    session = engine.get(s)
    return raster.heatmap(session.objects, COARSE, *session.origin, engine.levels(s))


@query(pixel_sql(PART, f"SELECT p.* FROM ({P_SQL}) p, ({_ORIGIN}) o WHERE floor((x - ox) / 65536) BETWEEN floor(({PART.x1} - ox) / 65536) AND floor(({PART.x2} - ox) / 65536) AND floor((y - oy) / 65536) BETWEEN floor(({PART.y1} - oy) / 65536) AND floor(({PART.y2} - oy) / 65536)"))
def session_grid_map(spark, sf):
    """A map of a session at the middle level, from its levels."""
    engine, s = _session(spark, sf, points_as_wkt(spark, sf))
    session = engine.get(s)
    return raster.heatmap(session.objects, PART, *session.origin, engine.levels(s))


def points_as_wkt(spark: SparkSession, sf: str) -> DataFrame:
    return fx.points(spark, sf).select("row_id", F.concat(F.lit("POINT("), F.col("lng").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")).alias("wkt"))


#: A click in every area, a quarter of its side off its lower left corner.
_AREA_BOX = f"SELECT row_id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM ({A_SQL}) WHERE ring_idx = 0 GROUP BY row_id"
AREA_RAD = 400000.0


@query(f"SELECT row_id, ring_idx AS ring, inside, round(CASE WHEN inside THEN {AREA_RAD} / 4 ELSE d END, 3) AS d FROM (SELECT row_id, ring_idx, count(*) FILTER ((ay > py) <> (qy > py) AND px < (qx - ax) * (py - ay) / (qy - ay) + ax) % 2 = 1 AS inside, min({DIST_SQL}) AS d FROM (SELECT *, {T_SQL} AS t FROM (SELECT row_id, ring_idx, (minx * 3 + maxx) / 4 AS px, (miny * 3 + maxy) / 4 AS py, x AS ax, y AS ay, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM ({A_SQL}) JOIN ({_AREA_BOX}) USING (row_id) WINDOW w AS (PARTITION BY row_id, ring_idx ORDER BY v))) WHERE qx IS NOT NULL GROUP BY ALL)")
def clicks_in_areas(spark, sf):
    """How far a click in each area is from its rings: a quarter of the radius inside of one, the border's distance outside."""
    a = areas(spark, sf)
    box = a.where("ring = 0").select("row_id", *[((F.col(f"min{c}") * 3 + F.col(f"max{c}")) / 4).alias(f"c{c}") for c in "xy"])
    return a.join(box, "row_id").select("row_id", "ring", geometry.contains(F.col("coords"), F.col("cx"), F.col("cy")).alias("inside"), F.round(lookup.line_click(F.col("kind"), F.col("coords"), F.col("cx"), F.col("cy"), AREA_RAD)["d"], 3).alias("d"))
