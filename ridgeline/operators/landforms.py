"""Landform rows to summits: first failing rule, keep-first dedup, cells, citations, heights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import cell_name, num
from ridgeline.functions.text import trimmed
from ridgeline.tables import write_down

# Classes that are summits, the size of a point, and the reasons in their order.
SUMMIT_CLASSES = ("peak", "volcano")
POINT_TOLERANCE_DEG = 1e-4
REASONS = ("unreadable-row", "not-a-landform", "not-a-summit-class", "unnamed", "no-elevation", "not-a-point", "outside-area")


def classify_landforms(rows: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Adds name, lat, lon, cell and reason (null for a summit). area: south, west, north, east.

    Texts count without white space around them and a blank one is none; numbers must be finite; a box needs all four sides.
    """
    south, west, north, east = area
    text = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    x0, x1, y0, y1 = (finite(F.col(f"bbox.{side}").cast("double")) for side in ("xmin", "xmax", "ymin", "ymax"))
    unboxed = x0.isNull() | x1.isNull() | y0.isNull() | y1.isNull()
    name = text("names.primary")
    lat, lon = F.when(~unboxed, (y0 + y1) / num(2)), F.when(~unboxed, (x0 + x1) / num(2))
    point = (x1 >= x0) & (y1 >= y0) & (x1 - x0 <= POINT_TOLERANCE_DEG) & (y1 - y0 <= POINT_TOLERANCE_DEG) & lat.between(-90, 90) & lon.between(-180, 180)
    reason = (
        F.when(text("id").isNull() | unboxed, REASONS[0]).when(~text("subtype").eqNullSafe(F.lit("physical")), REASONS[1])
        .when(~F.coalesce(text("class").isin(*SUMMIT_CLASSES), F.lit(False)), REASONS[2]).when(name.isNull(), REASONS[3])
        .when(finite(F.col("elevation").cast("double")).isNull(), REASONS[4]).when(~F.coalesce(point, F.lit(False)), REASONS[5])
        .when(~(lat.between(south, north) & lon.between(west, east)), REASONS[6])
    )
    return rows.withColumn("id", text("id")).withColumn("name", name).withColumn("lat", lat).withColumn("lon", lon).withColumn("cell", cell_name(lat, lon)).withColumn("reason", reason)


def import_landforms(rows: DataFrame, area: tuple[float, float, float, float], order: str = "ord") -> DataFrame:
    """As classify_landforms(); of the summits with one id the first by ``order`` is kept, the others are duplicates."""
    out = classify_landforms(rows, area)
    # only summits are ranked: what has a reason (all rows without an id among them) would be one large group
    nth = F.row_number().over(Window.partitionBy("id").orderBy(order))
    summits = out.where("reason is null").withColumn("outcome", F.when(nth > 1, "duplicate").otherwise("kept"))
    return summits.unionByName(out.where("reason is not null").withColumn("outcome", F.col("reason")))


def outcome_counts(imported: DataFrame) -> DataFrame:
    """outcome, n: every reason, kept and duplicate, with zeros."""
    spark = imported.sparkSession
    every = spark.createDataFrame([(x,) for x in (*REASONS, "kept", "duplicate")], "outcome string")
    counted = imported.groupBy("outcome").agg(F.count("*").alias("n"))
    return every.join(counted, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def write_cells(imported: DataFrame, path: str) -> DataFrame:
    """Write the kept summits by cell, ids in order; returns the index (cell, peaks)."""
    kept = imported.where("outcome = 'kept'")
    kept.select("cell", F.concat(F.lit("overture/"), "id").alias("id"), "name", "lat", "lon", "elevation").repartition("cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").mode("overwrite").parquet(path)
    return kept.groupBy("cell").agg(F.count("*").alias("peaks"))


def fill_elevations(summits: DataFrame, heights: DataFrame) -> DataFrame:
    """Missing heights from a second source by id, with elevationSource (null where neither has one)."""
    filled = summits.join(heights.select("id", F.col("elevationM").alias("_second")), "id", "left")
    source = F.when(F.col("elevationM").isNotNull(), "first").when(F.col("_second").isNotNull(), "second")
    return filled.withColumn("elevationSource", source).withColumn("elevationM", F.coalesce("elevationM", "_second")).drop("_second")


def batches(rows: DataFrame, order: str, most: int) -> DataFrame:
    """batch (from 0), rows (array in order): consecutive rows by ``order``, ``most`` to a batch (1 to 100, cut to that).

    Rows are numbered without one task for all: sorted in parts, whose counts (one row a part) are added up. The parts are written
    down before they are counted, because their bounds are sampled and a second evaluation would cut them elsewhere.
    """
    most = min(100, max(1, int(most)))
    at = F.monotonically_increasing_id()  # the part and, in its lowest 33 bits, the place in it
    part = write_down(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", at), "parts")
    part = part.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = part.join(F.broadcast(counts), "_p").withColumn("batch", F.floor((F.col("_base") + F.col("_i")) / most).cast("long"))
    return numbered.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order]))).alias("rows"))
