"""Tables as versioned Parquet directories behind a pointer, and the rewrites that stand for upserts, updates and deletes.

A version is written in full before the pointer moves, so a reader sees the old table or the new one, never a mixture.
Pointer and directories are reached through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows that have no new one, and the new ones."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def without_stale(rows: DataFrame, documents: DataFrame, keep: DataFrame, document: str = "doc_id", key: str = "chunk_id") -> DataFrame:
    """The rows without those of the given documents whose key isn't kept."""
    stale = rows.join(documents, document, "left_semi").join(keep, key, "left_anti").select(key)
    return rows.join(stale, key, "left_anti")


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the changed columns of their key's change; other rows and columns stay."""
    names = [c for c in changes.columns if c != key]
    j = rows.join(changes.select(key, F.lit(True).alias("_changed"), *(F.col(c).alias(f"_{c}") for c in names)), key, "left")
    return j.select(*(F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns))


def prunable(snapshots: DataFrame, keep: int = 14) -> DataFrame:
    """Good snapshots beyond the newest ``keep`` by name: only the names that stay are looked for."""
    good = snapshots.where("state = 'SUCCESS'")
    newest = good.select("name").orderBy(F.col("name").desc()).limit(keep)
    return good.join(F.broadcast(newest), "name", "left_anti").select(*snapshots.columns)


class ConflictError(RuntimeError):
    """Another writer changed the table first."""


class VersionedTable:
    """A table at ``path``: directories ``v=…`` and pointers ``current-…``, of which the highest number is live.

    A pointer is written beside and renamed to a number that nobody has, so a reader sees a whole pointer at any time and
    of two writers that start from the same one the second is told.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")) if s.isDirectory())

    def _pointers(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(n for s in self._fs.listStatus(self._at("")) if (n := s.getPath().getName()).startswith("current-"))

    def pointer(self) -> int:
        """The live pointer's number, 0 before the first."""
        found = self._pointers()
        return int(found[-1].split("-")[1]) if found else 0

    def current(self) -> str | None:
        found = self._pointers()
        return json.loads(self.spark.read.text(f"{self.path}/{found[-1]}", wholetext=True).first()[0])["version"] if found else None

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise ValueError("the table has no version yet")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, rows: DataFrame, switch: bool = True) -> str:
        """Write a new version; ``switch`` makes it the live one."""
        last = self.versions()[-1:]
        version = f"v={int(last[0][2:10]) + 1 if last else 0:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{version}")
        if switch:
            self.switch(version)
        return version

    def switch(self, version: str, allow_empty: bool = True, expected: int | None = None) -> str | None:
        """Point at another version and return the one before; unknown and, unless allowed, empty ones are refused.

        With ``expected`` the live pointer must still have that number. The two newest pointers stay, for readers on their way.
        """
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        if not allow_empty and self.spark.read.parquet(f"{self.path}/{version}").isEmpty():
            raise ValueError(f"{version} is empty")
        number, before = self.pointer(), self.current()
        if expected is not None and number != expected:
            raise ConflictError(f"pointer {number} instead of {expected}")
        name = self._at(f"new-{uuid.uuid4().hex}")
        out = self._fs.create(name, True)
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(name.toUri(), context._jsc.hadoopConfiguration()) if name.toUri().getScheme() else hadoop.FileContext.getFileContext(context._jsc.hadoopConfiguration())
        try:
            files.rename(name, self._at(f"current-{number + 1:012d}"), context._gateway.new_array(hadoop.Options.Rename, 0))
        except Py4JJavaError as error:
            self._fs.delete(name, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise ConflictError(f"pointer {number + 1} was set by another writer") from error
            raise
        for old in self._pointers()[:-2]:
            self._fs.delete(self._at(old), False)
        return before

    def change(self, rows_of: Callable[[DataFrame], DataFrame], restarts: int = 5) -> str:
        """Write what ``rows_of`` makes of the live rows; if another writer came first it starts again, a few times."""
        for left in range(restarts, -1, -1):
            number = self.pointer()
            version = self.write(rows_of(self.read()), switch=False)
            try:
                self.switch(version, expected=number)
                return version
            except ConflictError:
                self._fs.delete(self._at(version), True)
                if not left:
                    raise
        raise AssertionError

    def drop(self, version: str, age_days: float, least_days: float = 14, force: bool = False) -> None:
        """Delete an old version; the live one is refused, and one younger than ``least_days`` unless forced."""
        if version == self.current():
            raise ValueError("the live version can't be dropped")
        if age_days < least_days and not force:
            raise ValueError(f"{version} is younger than {least_days} days")
        self._fs.delete(self._at(version), True)
