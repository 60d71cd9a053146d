"""Tables that are written down between steps: what was evaluated once stays so, and survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a session on one machine may leave it unset; it gets one below its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt over a task for every so many ``rows`` by a hash of ``keys``. A table of short rows lies in one partition, and what makes very many of each row would run there.

    Spark estimates a table's size before it is exploded, so what comes of such a table must not be left to be broadcast either.
    """
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > 1 else df


def write_down(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder. Whatever a plan deals out by sampled bounds must be read from one such table, not be evaluated twice."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
