"""Helpers that several training-data operators share.

Everything here works on DataFrames of any size: intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir`` (shared by all machines) and nothing that grows with the input reaches the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.shipping import ship

#: A table of at most so many bytes, measured on its rows, may be broadcast.
BROADCAST_BYTES = 48 << 20
#: A key is hot that more rows have than this, and than one row in HOT_SHARE; there are fewer than HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 2_000, 20_000
#: Rows go to Python in batches of so many bytes at most, unless the session bounds them lower.
BATCH_BYTES, BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Deletes the files of a query's shuffles when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of text that one step of a Python operator holds at once (a longer text is one step of its own).
STEP_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. Only a session on one machine may leave it unset; it gets one below its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def materialize(df: DataFrame, name: str, *done: DataFrame | None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Tables ``done`` are deleted afterwards: ``df`` was the last to read them.
    """
    spark = df.sparkSession
    path, kept = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for old in done:
        discard(old)
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table made by materialize() that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, found by exact name and position, so other columns may clash in any way."""
    spark = df.sparkSession
    ship(spark)  # operators begin here, and their functions run on the executors
    if int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    names = list(df.columns)
    missing = [c for c in columns.values() if c not in names]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {names}")
    renamed = df.toDF(*[f"_{i}" for i in range(len(names))])
    return renamed.select(*[F.col(f"_{names.index(src)}").alias(dst) for dst, src in columns.items()])


def row_bytes(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((row_bytes(f"{name}.`{f.name}`", f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, T.ArrayType):
        inner = 8 * (1 + len(kind.elementType) if isinstance(kind.elementType, T.StructType) else 1)
        if isinstance(kind.elementType, T.StringType | T.BinaryType):
            return F.coalesce(F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 24), F.lit(0)) + 24
        return F.coalesce(F.size(name), F.lit(0)) * inner + 24
    return F.lit(8)


def small(df: DataFrame, most: int | None = None) -> bool:
    """Whether ``df`` (materialised) takes at most ``most`` bytes, summed over all its rows."""
    total = df.agg(F.sum(sum((row_bytes(f"`{f.name}`", f.dataType) for f in df.schema), F.lit(16).cast("long")))).first()[0]
    return (total or 0) <= (BROADCAST_BYTES if most is None else most)


def join_small(left: DataFrame, right: DataFrame, on: Column | list[str] | str, how: str = "inner") -> DataFrame:
    """Join that broadcasts ``right`` only if its measured bytes are within bounds, and merges otherwise."""
    return left.join(F.broadcast(right) if small(right) else right.hint("merge"), on, how)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Inner or left join with ``right`` (materialised; one row a key; ``count``: rows that ``left`` has of it, about).

    Fewer than HOT_SHARE keys are hot, so their rows of ``right`` are broadcast; the rest has no large group to shuffle. The
    rest is merged whatever its size: the plan is the same for every input.
    """
    total, most = right.agg(F.sum(count), F.max(count)).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    rows, hot = right.drop(count), F.broadcast(right.where(F.col(count) > bound).drop(count))
    if (most or 0) <= bound:
        return left.join(rows.hint("merge"), keys, how)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rows.hint("merge"), keys, how)
    return left.join(hot, keys).unionByName(rest)


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """The values of ``key`` that are hot (fewer than HOT_SHARE), null if there are none. df: materialised."""
    counts = df.groupBy(key).agg(F.count("*").alias("k"))
    total, most = counts.agg(F.sum("k"), F.max("k")).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    return counts.where(F.col("k") > bound).select(key) if most and most > bound else None


def hash_sample(df: DataFrame, keys: list[str], rows: int, most: int) -> DataFrame:
    """All ``rows`` rows of ``df``, or about ``most`` of them by a hash of ``keys``."""
    share = 1 << 30
    return df if rows <= most else df.where(F.pmod(F.xxhash64(*keys), F.lit(share)) < F.lit(share * most // rows))


def step_batches(batches: Iterator[pa.RecordBatch], sized_by: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches into runs of rows holding about ``step_bytes`` in column ``sized_by``."""
    for batch in batches:
        column = batch.column(sized_by)
        start = held = 0
        for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
            if held and held + n > step_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if batch.num_rows > start:
            yield batch.slice(start)


def map_steps(df: DataFrame, sized_by: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` over runs of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in step_batches(batches, sized_by):
            yield fn(step)

    return df.mapInArrow(run, schema)


def before(df: DataFrame, keys: list[str], order: Column, ties: list[str], value: Column, n_rows: int, per_bucket: int = 20_000) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same ``keys`` that come earlier by a hash order.

    ``order`` is a 64-bit hash (any long). Its range is cut into buckets of about ``per_bucket`` rows; bucket sums
    are summed up first, so no task sees more than one bucket of one key, however large the key is. Rows of one hash are in one
    bucket, however many they are: ``order`` must tell rows apart that are many.
    """
    buckets = max(1, -(-n_rows // per_bucket))
    width = (1 << 62) // buckets + 1
    rows = df.withColumn("_o", order).withColumn("_v", value.cast("long")).withColumn("_b", F.expr(f"shiftright(_o, 1) + {1 << 62}L").cast("long"))
    rows = rows.withColumn("_b", F.expr(f"cast(shiftrightunsigned(_b, 1) div {width}L as int)"))
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_b").orderBy("_o", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_b"]]
    joined = rows.alias("r").join(sums.alias("s"), same)
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("s._base") + F.col("r._in")).alias("before"))


def connected_components(links: DataFrame) -> DataFrame:
    """Component of every node of ``links`` (a, b): the least node reachable.

    Hash-to-min with pointer jumping: each round a node takes the least label of its neighbours, then the label of
    its label. Rounds are written to the shared folder; the loop ends when no label changes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = materialize(both, "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = hooked.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = materialize(new, "labels")
        changed = new.where("old <> label").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(edges)
            return labels.select("node", "label")
