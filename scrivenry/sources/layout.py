"""Tables laid out by ranges of their key, so that point reads and pages by key open few files and row groups.

A table is a folder of Parquet files, each with one range of keys in order and a Bloom filter on the key, and a manifest beside them
with each file's first and last key and its rows. The manifest is a table as well: only the lines that a read needs come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lay_out(rows: DataFrame, path: str, key: str, files: int) -> None:
    """Write ``rows`` with a key (not null) in about ``files`` ranges."""
    kept = rows.where(F.col(key).isNotNull()).repartitionByRange(files, key).sortWithinPartitions(key)
    kept.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/data")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/data").select(F.col(key).alias("key"), F.input_file_name().alias("file"))
    ranges = written.groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    ranges.repartitionByRange(max(1, files // 10_000), "first").sortWithinPartitions("first").write.parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/data").schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def point_read(spark: SparkSession, path: str, key: str, wanted: list) -> DataFrame:
    """The rows with one of the ``wanted`` keys (a request's, so few), from the files whose ranges can hold them."""
    manifest = spark.read.parquet(f"{path}/manifest")
    asked = F.array(*map(F.lit, wanted)) if wanted else F.array()
    files = manifest.where(F.exists(asked, lambda k: k.between(F.col("first"), F.col("last")))).select("file").collect() if wanted else []
    return _read(spark, path, [r.file for r in files]).where(F.col(key).isin(wanted))


def page_read(spark: SparkSession, path: str, key: str, after=None, size: int = 500) -> DataFrame:
    """The next ``size`` rows after the cursor, in order, from as many files as hold them; equal keys may be cut apart."""
    manifest = spark.read.parquet(f"{path}/manifest")
    left = manifest if after is None else manifest.where(F.col("last") > F.lit(after))
    files, found = [], 0
    # The first file may hold rows up to the cursor, so its rows don't count.
    for at, r in enumerate(left.orderBy("first", "file").limit(size + 2).toLocalIterator()):
        files.append(r.file)
        found += r.n if at or after is None else 0
        if found >= size:
            break
    rows = _read(spark, path, files)
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)
