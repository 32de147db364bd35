"""Map inputs derived from plain tables: the same views in Spark and, as SQL, for a second engine to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HUNDRED = "CAST(100 AS DOUBLE)"
_LNG, _LAT = "({k}*7919 % {a})/" + _HUNDRED + " - {b}", "({k}*104729 % {a})/" + _HUNDRED + " - {b}"
POINT_EXPR = [f"{_LNG.format(k='{k}', a=36000, b=180)} AS lng", f"{_LAT.format(k='{k}', a=16000, b=80)} AS lat"]
_WKT = "CASE WHEN o_orderkey % 97 = 13 THEN 'JUNK' WHEN o_orderkey % 97 = 14 THEN 'POINT EMPTY' ELSE concat('POINT(', CAST(CAST((o_orderkey*7919 % 36000)/CAST(100 AS DOUBLE) - 180 AS DECIMAL(10,2)) AS {s}), ' ', CAST(CAST((o_orderkey*104729 % 16000)/CAST(100 AS DOUBLE) - 80 AS DECIMAL(10,2)) AS {s}), ')') END"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique points: row_id, qid, lng, lat."""
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_id", "o_orderkey AS qid", *[e.format(k="o_orderkey") for e in POINT_EXPR])


def dup_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty sites with many rows each."""
    return _read(spark, sf_dir, "customer").selectExpr("c_custkey AS row_id", "c_custkey % 50 AS qid", *[e.format(k="(c_custkey % 50)") for e in POINT_EXPR])


def multi_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three points a row."""
    parts = _read(spark, sf_dir, "part").withColumn("part_idx", F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))))
    return parts.selectExpr("p_partkey AS row_id", "p_partkey AS qid", "part_idx", f"((p_partkey*7919 + part_idx*31) % 36000)/{_HUNDRED} - 180 AS lng", f"((p_partkey*104729 + part_idx*17) % 16000)/{_HUNDRED} - 80 AS lat")


def line_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 32 vertices, a row for each."""
    v = _read(spark, sf_dir, "embeddings").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(31))))
    at = lambda i: f"CAST(element_at(embedding, CAST(2*v+{i} AS INT)) AS DOUBLE)"
    return v.selectExpr("vec_id AS row_id", "vec_id AS qid", "v", f"(vec_id*7919 % 34000)/{_HUNDRED} - 170 + {at(1)} AS lng", f"(vec_id*104729 % 15000)/{_HUNDRED} - 75 + {at(2)} AS lat")


def area_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed square rings; every third area has a hole, ring 1."""
    v = _read(spark, sf_dir, "supplier").withColumn("ring_idx", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("ring_idx = 0 OR s_suppkey % 3 = 0")
    side = lambda ones: f"(CASE WHEN v IN {ones} THEN 1 ELSE -1 END)*(1 + s_suppkey % 5)*(CASE ring_idx WHEN 0 THEN 20 ELSE 10 END)/{_HUNDRED}"
    return v.selectExpr("s_suppkey AS row_id", "s_suppkey AS qid", "ring_idx", "v", f"(s_suppkey*7919 % 34000)/{_HUNDRED} - 170 + {side('(1,2)')} AS lng", f"(s_suppkey*104729 % 15000)/{_HUNDRED} - 75 + {side('(2,3)')} AS lat")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are points."""
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_id", "shiftleft(8L,60) | shiftleft(o_orderkey*104729 % 1073741824, 30) | (o_orderkey*7919 % 1073741824) AS qid")


def result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's result with attributes, its WKT last; some can't be read."""
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_id", "o_orderkey AS qid", "o_orderpriority", "o_totalprice", f"{_WKT.format(s='STRING')} AS wkt")


SQL = {
    "points": f"SELECT o_orderkey AS row_id, o_orderkey AS qid, {', '.join(e.format(k='o_orderkey') for e in POINT_EXPR)} FROM orders",
    "dup_points": f"SELECT c_custkey AS row_id, c_custkey % 50 AS qid, {', '.join(e.format(k='(c_custkey % 50)') for e in POINT_EXPR)} FROM customer",
    "multi_points": f"SELECT p_partkey AS row_id, p_partkey AS qid, CAST(part_idx AS INT) AS part_idx, ((p_partkey*7919 + part_idx*31) % 36000)/{_HUNDRED} - 180 AS lng, ((p_partkey*104729 + part_idx*17) % 16000)/{_HUNDRED} - 80 AS lat FROM part CROSS JOIN (SELECT unnest([0,1,2]) AS part_idx) t WHERE part_idx <= p_partkey % 3",
    "line_vertices": f"SELECT vec_id AS row_id, vec_id AS qid, CAST(v AS INT) AS v, (vec_id*7919 % 34000)/{_HUNDRED} - 170 + CAST(embedding[2*v+1] AS DOUBLE) AS lng, (vec_id*104729 % 15000)/{_HUNDRED} - 75 + CAST(embedding[2*v+2] AS DOUBLE) AS lat FROM embeddings CROSS JOIN (SELECT unnest(range(0,32)) AS v) t",
    "area_vertices": f"SELECT s_suppkey AS row_id, s_suppkey AS qid, CAST(ring_idx AS INT) AS ring_idx, CAST(v AS INT) AS v, (s_suppkey*7919 % 34000)/{_HUNDRED} - 170 + (CASE WHEN v IN (1,2) THEN 1 ELSE -1 END)*(1 + s_suppkey % 5)*(CASE ring_idx WHEN 0 THEN 20 ELSE 10 END)/{_HUNDRED} AS lng, (s_suppkey*104729 % 15000)/{_HUNDRED} - 75 + (CASE WHEN v IN (2,3) THEN 1 ELSE -1 END)*(1 + s_suppkey % 5)*(CASE ring_idx WHEN 0 THEN 20 ELSE 10 END)/{_HUNDRED} AS lat FROM supplier CROSS JOIN (SELECT unnest([0,1]) AS ring_idx) a CROSS JOIN (SELECT unnest(range(0,5)) AS v) b WHERE ring_idx = 0 OR s_suppkey % 3 = 0",
    "folded": "SELECT o_orderkey AS row_id, (o_orderkey*104729 % 1073741824) AS hi30, (o_orderkey*7919 % 1073741824) AS lo30 FROM orders",
    "result": f"SELECT o_orderkey AS row_id, o_orderkey AS qid, o_orderpriority, o_totalprice, {_WKT.format(s='VARCHAR')} AS wkt FROM orders",
}
