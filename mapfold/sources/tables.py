"""Tables a session keeps, in the folder all executors share: they survive lost executors, and their rows keep their ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of a row group and rows of a page: the least that a filter can leave out.
ROW_GROUP, PAGE_ROWS = 16 << 20, 5000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="mapfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def keep(df: DataFrame, name: str, folder: str | None = None, along: Column | None = None) -> DataFrame:
    """df, written and read again; in a folder of its own, or under the one given.

    along: an order that rows are written in. Files and their pages then hold rows that lie together, and tell by their least and greatest
    values what a filter can leave out.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df
    if along is not None:
        keyed = df.withColumn("_along", along)
        writer = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_along").sortWithinPartitions("_along").drop("_along")
    writer.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
    return kept(spark, path, schema)


def kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of keep(), by whomever."""
    found = spark.read.schema(schema).parquet(path)
    found._kept_at = path
    return found


def forget(df: DataFrame) -> None:
    """Deletes a table of keep()."""
    path = getattr(df, "_kept_at", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
