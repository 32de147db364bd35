"""Sessions in shared storage: what one engine keeps, others find, use and end.

    <folder>/<session>/manifest      made last: paths and schemas of the tables, the numbers, and when it was made
    <folder>/<session>/levels        the same of the tables that coarse maps read, once they are made
    <folder>/<session>/<tables>
    <folder>/by-query/<digest>       the session of a query's text

A session whose engine is lost stays usable until its lifetime is over; then whichever engine looks next deletes it, as well as
folders that never got a manifest.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import tables
from .store import Store


class Sessions:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.store = spark, Store(spark)
        self.folder = folder or f"{tables.shared_dir(spark).rstrip('/')}/map-sessions"

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _described(self, made: dict[str, DataFrame]) -> dict:
        return {name: {"path": df._kept_at, "schema": df.schema.json()} for name, df in made.items()}

    def _tables(self, described: dict) -> dict[str, DataFrame]:
        return {name: tables.kept(self.spark, t["path"], StructType.fromJson(json.loads(t["schema"]))) for name, t in described.items()}

    def put(self, name: str, made: dict[str, DataFrame], **facts) -> bool:
        return self.store.create(f"{self.at(name)}/manifest", json.dumps({"tables": self._described(made), "made": time.time(), **facts}))

    def find(self, name: str) -> tuple[dict[str, DataFrame], dict] | None:
        """Tables and facts of a session, whoever made it."""
        text = self.store.read(f"{self.at(name)}/manifest")
        if not text:
            return None
        facts = json.loads(text)
        return self._tables(facts.pop("tables")), facts

    def put_levels(self, name: str, made: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The session's levels: these, or those of an engine that was first."""
        if not self.store.create(f"{self.at(name)}/levels", json.dumps(self._described(made))):
            for t in made.values():
                tables.forget(t)
        return self.find_levels(name)

    def find_levels(self, name: str) -> dict[str, DataFrame]:
        text = self.store.read(f"{self.at(name)}/levels")
        return self._tables(json.loads(text)) if text else {}

    def _by_query(self, key: tuple) -> str:
        return f"{self.folder}/by-query/{hashlib.sha256(json.dumps(key).encode()).hexdigest()}"

    def of_query(self, key: tuple) -> str | None:
        """The session of a query, if it hasn't ended."""
        name = self.store.read(self._by_query(key))
        return name if name and self.store.exists(f"{self.at(name)}/manifest") else None

    def remember(self, key: tuple, name: str) -> None:
        where = self._by_query(key)
        if not self.store.create(where, name) and self.of_query(key) is None:  # that one has ended
            self.store.delete(where)
            self.store.create(where, name)

    def end(self, name: str) -> None:
        """The manifest goes first, so that no one begins to use what is being deleted."""
        self.store.delete(f"{self.at(name)}/manifest")
        self.store.delete(self.at(name))

    def names(self) -> Iterator[str]:
        return (n for n in self.store.names(self.folder) if n != "by-query")

    def expired(self, lifetime_s: float, now: float | None = None) -> list[str]:
        """Sessions over their lifetime, and folders without a manifest that haven't changed for as long."""
        now, out = now or time.time(), []
        for name in self.names():
            text = self.store.read(f"{self.at(name)}/manifest")
            age = now - json.loads(text)["made"] if text else self.store.age(self.at(name)) + now - time.time()
            if age > lifetime_s:
                out.append(name)
        return out
