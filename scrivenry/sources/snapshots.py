"""Snapshots of versioned tables: the live versions are copied under one name, listed, pruned, and restored beside the live tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import VersionedTable, prunable

MANIFEST = "name string, tables array<string>, rows array<bigint>, state string, started_at timestamp"


class Snapshots:
    """Snapshots in ``path``: per snapshot a directory per table, and a manifest that is written last."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "search-", restored: str = "restored_"):
        self.spark, self.path, self.prefix, self.restored = spark, path.rstrip("/"), prefix, restored
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def list(self) -> DataFrame:
        """The manifests, newest first."""
        if not self._fs.exists(self._at("manifests")):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self.prefix}*").orderBy(F.col("name").desc())

    def create(self, tables: Mapping[str, VersionedTable], now: datetime | None = None) -> str:
        """Copy the live version of each table; a snapshot that breaks off is PARTIAL, and the error is raised."""
        if not tables or any(t.current() is None for t in tables.values()):
            raise ValueError("there is no live version to save")
        started = now or datetime.now(UTC)
        name = f"{self.prefix}{started:%Y%m%dt%H%M%Sz}"
        if self._fs.exists(self._at(f"manifests/{name}")):
            raise ValueError(f"snapshot {name} exists")
        saved: dict[str, int] = {}
        try:
            for table, source in tables.items():
                source.read().write.mode("overwrite").parquet(f"{self.path}/data/{name}/{table}")
                saved[table] = self._rows(name, table).count()
        finally:
            state = "SUCCESS" if len(saved) == len(tables) else "PARTIAL"
            row = [(name, list(saved), list(saved.values()), state, started)]
            self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        return name

    def _rows(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{name}/{table}")

    def prune(self, keep: int = 14) -> list[str]:
        """Delete good snapshots beyond the newest ``keep``; failed ones neither count nor go."""
        gone = sorted(r.name for r in prunable(self.list(), keep).select("name").collect())
        for name in gone:
            self._fs.delete(self._at(f"manifests/{name}"), True)
            self._fs.delete(self._at(f"data/{name}"), True)
        return gone

    def restore(self, name: str, root: str, tables: Sequence[str] | None = None) -> dict[str, VersionedTable]:
        """Tables of a snapshot as new ones under ``root``, named with the restore prefix; live ones are left alone."""
        found = self.list().where(F.col("name") == name).first()
        if found is None:
            raise ValueError(f"no snapshot {name}")
        wanted = list(tables or found.tables)
        if set(wanted) - set(found.tables):
            raise ValueError("the snapshot doesn't hold all of these tables")
        out = {f"{self.restored}{t}": VersionedTable(self.spark, f"{root}/{self.restored}{t}") for t in wanted}
        for t in wanted:
            out[f"{self.restored}{t}"].write(self._rows(name, t))
        return out


def counts(tables: Mapping[str, VersionedTable]) -> dict[str, int]:
    """Rows of each table, to compare what was restored with what was saved."""
    return {name: t.read().count() for name, t in tables.items()}
