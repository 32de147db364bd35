"""Packed ids: files of little-endian 8-byte ids, as a data source for reading in pages and for writing.

    spark.read.format("packed_ids").options(pageRows=, first=, after=).load(path)      path, position, qid
    df.select("qid").write.format("packed_ids").mode("append").save(path)   a file for each partition

A page is a range of records of one file and a partition of its own, whatever the file's length; only of more than MANY pages several
that follow each other in a file make a partition, of at most PAGE_ROWS records, so that many small pages don't become as many tasks. What is
left of a record at a file's end is ignored. A range of records is asked for by the options first and after, not by pushed-down conditions: with those, Spark 4.1 keeps what was pushed down for
further queries of the same DataFrame. Files are reached through pyarrow's file systems (local,
hdfs, s3, gs); read_ids() reads from others through Spark's own.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a packed id; records of a page and of a batch.
ID_BYTES, PAGE_ROWS, BATCH_ROWS = 8, 10_000_000, 100_000
#: Pages from which several make a partition.
MANY = 64
SCHEMA = "path string, position long, qid long"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file or of the files of a folder, by name; names that begin with _ or . aren't read."""
    fs, where = _at(path)
    info = fs.get_file_info(where)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(where, allow_not_found=True))
    base = path.rstrip("/")
    return sorted((f"{base}/{posixpath.basename(f.path)}", f.size) for f in found if f.type == pafs.FileType.File and not posixpath.basename(f.path).startswith(("_", ".")))


@dataclass
class Page(InputPartition):
    path: str
    first: int
    after: int


class IdReader(DataSourceReader):
    def __init__(self, path: str, page_rows: int, first: int, after: int):
        self.path, self.page_rows, self.low, self.high = path, page_rows, first, after

    def partitions(self) -> list[Page]:
        out, start = [], self.low // self.page_rows * self.page_rows
        files = [(path, min(size // ID_BYTES, self.high)) for path, size in files_of(self.path)]
        pages = sum(max(0, -(-(after - start) // self.page_rows)) for _, after in files)
        rows = self.page_rows * max(1, min(-(-pages // MANY), PAGE_ROWS // self.page_rows))
        for path, after in files:
            out += [Page(path, max(a, self.low), min(a + rows, after)) for a in range(start, after, rows)]
        return [p for p in out if p.first < p.after] or [Page("", 0, 0)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        if page.first >= page.after:
            return
        fs, where = _at(page.path)
        with fs.open_input_file(where) as f:
            for at in range(page.first, page.after, BATCH_ROWS):
                n = min(BATCH_ROWS, page.after - at)
                ids = np.frombuffer(f.read_at(n * ID_BYTES, at * ID_BYTES), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([page.path] * n), pa.array(np.arange(at, at + n)), pa.array(ids)], ["path", "position", "qid"])


@dataclass
class Written(WriterCommitMessage):
    part: str
    path: str


class IdWriter(DataSourceArrowWriter):
    """Each task writes a file under a name that isn't read; when all are through, the files get their names."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        fs, where = _at(self.path)
        fs.create_dir(where, recursive=True)
        name = f"part-{task.partitionId():06d}.ids"
        with fs.open_output_stream(f"{where}/_{name}-{task.taskAttemptId()}") as out:
            for batch in batches:
                out.write(np.ascontiguousarray(batch.column("qid").to_numpy(zero_copy_only=False), "<i8").tobytes())
        return Written(f"_{name}-{task.taskAttemptId()}", name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, where = _at(self.path)
        for m in messages:
            if m:
                fs.move(f"{where}/{m.part}", f"{where}/{m.path}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, where = _at(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{where}/{m.part}")


class PackedIds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IdReader:
        return IdReader(self.options["path"], *(int(self.options.get(k, v)) for k, v in (("pageRows", PAGE_ROWS), ("first", 0), ("after", 1 << 62))))

    def writer(self, schema, overwrite: bool) -> IdWriter:
        if overwrite:
            raise ValueError("packed ids are written to folders of their own: use mode append")
        return IdWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedIds)


def write_ids(ids: DataFrame, path: str) -> None:
    """A column qid as packed ids, a file for each partition, in its order."""
    register(ids.sparkSession)
    ids.select("qid").write.format("packed_ids").mode("append").save(path)


def read_ids(spark: SparkSession, path: str, page_rows: int = PAGE_ROWS, first: int = 0, after: int = 1 << 62) -> DataFrame:
    """(path, position, qid): packed ids of a file or a folder; position counts from 0 in each file. Only the records first to after - 1 are read."""
    try:
        _at(path)
    except pa.ArrowInvalid:  # a store that only Spark reads
        return _through_spark(spark, path).where(F.col("position").between(first, after - 1))
    register(spark)
    return spark.read.format("packed_ids").options(pageRows=page_rows, first=first, after=after).load(path)


def numbered(ids: DataFrame) -> DataFrame:
    """ids with row: positions counted through all files, in the order of their names. A row for each file is all that is sorted and sent to all tasks."""
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ids.groupBy("path").agg((F.max("position") + 1).alias("n")).select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return ids.join(F.broadcast(sizes), "path").withColumn("row", F.col("_base") + F.col("position")).drop("_base")


def _through_spark(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, each read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(data.as_buffer(), "<i8", len(data.as_buffer()) // ID_BYTES)
                for at in range(0, len(ids), BATCH_ROWS):
                    part = ids[at : at + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["path", "position", "qid"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
