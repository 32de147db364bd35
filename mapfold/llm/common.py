"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Paths written by materialize(), by application.
_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="mapfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark's setting that shuffle files go when their query ends, and not once the driver's JVM has collected its plan.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors.

    free: the shuffle files of the write go as soon as the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    if free:
        before = spark.conf.get(FREE)
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize(), or one read from such a table alone, that nothing reads any more; any other is left alone."""
    made = {path.rsplit("/", 1)[1] for path in _made.get(df.sparkSession.sparkContext.applicationId, [])}
    for path in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
        if folder.getName() in made:  # names that no other table has
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def pair_hash(*cols: Column) -> list[Column]:
    """128 bits of hash as two longs, for keys that must not collide over billions of rows."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def clear(spark: SparkSession) -> None:
    """Deletes all tables of materialize() that are left: to be called when the results made from them have been written."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
