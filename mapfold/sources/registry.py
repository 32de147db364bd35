"""Sources: named geometry fills, a reader, counts, pages and fingerprints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mercator

Factory = Callable[[SparkSession], DataFrame]


@dataclass
class Registry:
    """Geometry fills by backend name: the longest registered prefix of a name decides, '' is the default."""

    fills: dict[str, Factory] = field(default_factory=dict)

    def register(self, prefix: str, factory: Factory) -> None:
        self.fills[prefix] = factory

    def resolve(self, name: str) -> Factory:
        fitting = [p for p in self.fills if name.startswith(p)]
        if not fitting:
            raise KeyError(name)
        return self.fills[max(fitting, key=len)]


def without_folded(df: DataFrame, qid: str = "qid") -> DataFrame:
    """Rows whose id isn't a point by itself."""
    return df.where(~mercator.is_folded(F.col(qid)))


def count(df: DataFrame, column: str) -> DataFrame:
    """One row, n: the values of a column that aren't null."""
    return df.agg(F.count(column).alias("n"))


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit in the order of a column."""
    return df.orderBy(order).offset(offset).limit(limit)


def pages(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with page: ranges of a whole-numbered key that can be read apart from each other, as many as needed."""
    return df.withColumn("page", F.floor(F.col(order) / F.lit(size)))


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a tab-separated file with a header; all columns are strings unless a schema is given."""
    reader = spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def fingerprint(df: DataFrame) -> str:
    """A version of a file-backed table: its files' paths, sizes and times; of the plan, if it has no files.

    Spark lists the files' folders and sums up a hash of each file: the driver has the files' names alone.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return f"plan-{df.semanticHash() & 0xFFFFFFFF:08x}"
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    wanted = spark.createDataFrame([(unquote(f),) for f in files], "file string").select(same(F.col("file")).alias("file"))
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    listed = spark.read.format("binaryFile").load([unquote(f) for f in folders]).select(same(F.col("path")).alias("file"), "length", "modificationTime")
    each = F.xxhash64("file", "length", "modificationTime")
    n, size, one, two = listed.join(wanted, "file", "left_semi").agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(each), F.bit_xor(F.xxhash64(each))).first()
    return f"{n}-{size or 0}-{(one or 0) & (1 << 64) - 1:016x}{(two or 0) & (1 << 64) - 1:016x}"
