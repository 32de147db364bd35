"""Small files and folders in shared storage, by Hadoop's file systems: the state that engines share."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Paths of any file system Spark can write to. Files here hold a few lines each."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, sorted; [] if there is none."""
        fs, where = self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, path: str) -> str | None:
        """A file's text; None if it isn't there (any more)."""
        fs, where = self._at(path)
        try:
            stream = fs.open(where)
        except Exception as e:  # py4j wraps what Java throws
            if "FileNotFound" in str(e):
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file whole or not at all; False if there is one already, which stays.

        The text goes to a file of another name first, so no reader sees a part of it; renaming fails where the name is taken.
        """
        fs, where = self._at(path)
        if fs.exists(where):
            return False
        part = self.spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{self.spark._jvm.java.util.UUID.randomUUID()}")
        stream = fs.create(part, False)
        stream.write(text.encode())
        stream.close()
        # a rename doesn't replace on any of them but local ones, where the name is looked up once more
        done = not fs.exists(where) and fs.rename(part, where)
        if not done:
            fs.delete(part, False)
        return bool(done)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def age(self, path: str) -> float:
        """Seconds since a path last changed, by the clock of this machine."""
        fs, where = self._at(path)
        return self.spark._jvm.java.lang.System.currentTimeMillis() / 1000 - fs.getFileStatus(where).getModificationTime() / 1000
