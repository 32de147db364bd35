"""Saved geometry dictionaries: immutable versions under one folder, a chain of manifests, and merges that decode what is new.

    <folder>/data-<id>/            one version, bucketed and sorted by qid
    <folder>/manifest-00000007     version, data folder, buckets and schema; the highest number is the current one

A version's files are never changed. A manifest is written whole, after its data, and only if its number is free. So whoever is killed
between the two leaves the version before in force, and of two engines that build at once each finds a whole dictionary; the
one that is later takes the next number, or the other's work if it was the same. Versions that are no longer in force stay for readers that still use
them, until vacuum().
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ingest
from .store import Store

#: Files that a dictionary is bucketed into.
BUCKETS = 64
PREFIX = "manifest-"


@dataclass(frozen=True)
class Manifest:
    number: int
    version: str
    data: str
    buckets: int
    schema: str


class Versions:
    """The versions of one dictionary under a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets, self.store = spark, folder.rstrip("/"), buckets, Store(spark)

    def current(self) -> Manifest | None:
        for name in reversed([n for n in self.store.names(self.folder) if n.startswith(PREFIX)]):
            text = self.store.read(f"{self.folder}/{name}")
            if text:
                return Manifest(int(name[len(PREFIX) :]), **json.loads(text))
        return None

    def read(self, version: str | None = None) -> DataFrame | None:
        """The current dictionary, if it is of that version: a bucketed table, so joins on qid don't move it."""
        now = self.current()
        if now is None or version not in (None, now.version):
            return None
        return self._table(now)

    def _table(self, m: Manifest) -> DataFrame:
        name, path = f"mapfold_{m.data.replace('-', '_')}", f"{self.folder}/{m.data}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(m.schema)))
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (qid) SORTED BY (qid) INTO {m.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def write_data(self, dictionary: DataFrame) -> Manifest:
        """Writes a version's files, which no one reads yet."""
        data = f"data-{uuid.uuid4().hex}"
        # dealt out as it is bucketed, so that each bucket is one file
        dealt = dictionary.repartition(self.buckets, "qid")
        dealt.write.bucketBy(self.buckets, "qid").sortBy("qid").format("parquet").option("path", f"{self.folder}/{data}").saveAsTable(f"mapfold_{data.replace('-', '_')}")
        return Manifest(0, "", data, self.buckets, dictionary.schema.json())

    def publish(self, made: Manifest, version: str) -> DataFrame:
        """Puts a version in force and gives the dictionary that is: another engine's, if it has published the same meanwhile."""
        while True:
            now = self.current()
            if now and now.version == version:
                self._drop(made.data)
                return self._table(now)
            number = (now.number if now else 0) + 1
            text = json.dumps({"version": version, "data": made.data, "buckets": made.buckets, "schema": made.schema})
            if self.store.create(f"{self.folder}/{PREFIX}{number:08d}", text):
                return self._table(Manifest(number, version, made.data, made.buckets, made.schema))

    def save(self, dictionary: DataFrame, version: str) -> DataFrame:
        return self.publish(self.write_data(dictionary), version)

    def _drop(self, data: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS mapfold_{data.replace('-', '_')}")
        self.store.delete(f"{self.folder}/{data}")

    def vacuum(self, older_s: float = 86_400.0) -> list[str]:
        """Deletes the data and manifests of versions not in force, and data never published, that haven't changed for so long."""
        now, gone = self.current(), []
        for name in self.store.names(self.folder):
            kept = now and name in (now.data, f"{PREFIX}{now.number:08d}")
            if not kept and self.store.age(f"{self.folder}/{name}") >= older_s:
                self._drop(name) if name.startswith("data-") else self.store.delete(f"{self.folder}/{name}")
                gone.append(name)
        return gone

    def update(self, rows: DataFrame, version: str, qid: str = "qid", text: str = "wkt") -> DataFrame:
        """The dictionary of rows (qid, WKT) as it is now, with texts that the current version knows taken from it."""
        return self.save(ingest.build_dictionary(rows, qid, text, self.read()), version)
