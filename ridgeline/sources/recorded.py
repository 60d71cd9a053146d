"""Stores of recorded exchanges and of tiles: content-addressed, idempotent writes, and catalogues from file metadata alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.catalog import tile_catalog
from ridgeline.tables import write_down

#: Hexadecimal digits of the digest that name a partition.
FOLDER_DIGITS = 2


def addressed(exchanges: DataFrame) -> DataFrame:
    """Exchanges (key, body) with digest (of the key) and folder; one for each key, the one with the least body if they differ."""
    digest = F.sha2("key", 256)
    return exchanges.groupBy("key").agg(F.min("body").alias("body")).select(digest.alias("digest"), "key", "body", F.substring(digest, 1, FOLDER_DIGITS).alias("folder"))


def write_exchanges(exchanges: DataFrame, path: str) -> int:
    """Append what the store doesn't hold yet, by digest; what it holds is never changed. Returns how many were added: none if it is called again.

    Both sides of the anti-join are digests, and only the folders that new digests fall in are read.
    """
    spark, new = exchanges.sparkSession, addressed(exchanges)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        held = spark.read.schema(new.schema).parquet(path).select("folder", "digest")
        new = new.join(held, ["folder", "digest"], "left_anti")
    new = write_down(new, "exchanges")
    added = new.count()
    if added:
        new.repartition("folder").sortWithinPartitions("folder", "digest").write.partitionBy("folder").mode("append").parquet(path)
    return added


def read_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """key, body of all recorded exchanges."""
    return spark.read.schema("digest string, key string, body string, folder string").parquet(path).select("key", "body")


def terrain_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue rows of the tile files below a folder (see catalog.tile_catalog): names and lengths only, no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index(F.substring_index("path", "/", -1), ".", 1)
    return tile_catalog(files.select(name.alias("name"), F.col("length").alias("bytes")))
