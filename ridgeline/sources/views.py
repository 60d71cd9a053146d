"""Adapter views: observers, terrain, summits, rays, landforms and sensors over a folder's general tables.

The engine's operators take tables of observers, summits, terrain samples and sensor readings. These views derive such
tables, deterministically and in plain expressions, from whatever tables a folder has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import destination, num
from ridgeline.tables import spread

EYE_HEIGHT_M, RADIUS_KM = 1.6, 30.0
BEARING_STEP_DEG, RANGE_STEP_M, MAX_RANGE_M = 5, 500, 30_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def terrain_m(lat: Column, lon: Column) -> Column:
    """A closed-form landscape."""
    return (
        num(1500) + num(900) * F.sin(lat * num(37.1)) * F.cos(lon * num(29.3))
        + num(350) * F.sin(lat * num(151.7) + lon * num(97.3)) + num(120) * F.cos(lon * num(411.7) - lat * num(233.1))
    )


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observer_id, lat, lon, groundElevationM, eyeElevationM: one for each nation."""
    n = F.col("n_nationkey")
    placed = table(spark, sf_dir, "nation").select(n.alias("observer_id"), (num(45.2) + n * num(0.061)).alias("lat"), (num(7.1) + (n * 7 % 25) * num(0.063)).alias("lon"))
    return placed.withColumn("groundElevationM", terrain_m(F.col("lat"), F.col("lon"))).withColumn("eyeElevationM", F.col("groundElevationM") + num(EYE_HEIGHT_M))


def summits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, lat, lon, elevationM (null for one in ten): one for each part."""
    k = F.col("p_partkey")
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), 20_000, "p_partkey")
    placed = parts.select(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), (num(45) + (k * 7919 % 20000) / num(10000)).alias("lat"), (num(6.9) + (k * 10473 % 20000) / num(10000)).alias("lon"), F.col("p_size").alias("size"))
    height = terrain_m(F.col("lat"), F.col("lon")) + F.col("size") * num(6)
    return placed.withColumn("elevationM", F.when(F.col("size") % 10 != 0, height)).drop("size")


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observer_id, eyeElevationM, bearingDeg, distanceM, elevationM: terrain along each bearing, with holes.

    Some samples are void and some bearings were never measured; both are absent, not zero.
    """
    at = observers(spark, sf_dir).select("observer_id", "lat", "lon", "eyeElevationM")
    swept = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(360 - BEARING_STEP_DEG), F.lit(BEARING_STEP_DEG))).alias("b"))
    swept = swept.where(~F.col("b").isin([35, 130])).select("*", F.explode(F.sequence(F.lit(RANGE_STEP_M), F.lit(MAX_RANGE_M), F.lit(RANGE_STEP_M))).alias("d"))
    swept = swept.where((F.col("b") * 7 + F.col("d") / F.lit(500) * 13 + F.col("observer_id")).cast("int") % 17 != 0)
    lat, lon = destination(F.col("lat"), F.col("lon"), F.col("b").cast("double"), F.col("d").cast("double"))
    return swept.select("observer_id", "eyeElevationM", F.col("b").cast("double").alias("bearingDeg"), F.col("d").cast("double").alias("distanceM"), terrain_m(lat, lon).alias("elevationM"))


def landforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested landform rows as a map provider ships them: id, names, subtype, class, elevation, bbox, with defects of every kind."""
    k = F.col("p_partkey")
    lat, lon = num(45) + (k * 7919 % 20000) / num(10000), num(6.9) + (k * 10473 % 20000) / num(10000)
    size = F.when(k % 13 == 4, num(0.01)).otherwise(num(0.00004))
    box = F.struct((lon - size).alias("xmin"), F.when(k % 37 != 12, lon + size).alias("xmax"), (lat - size).alias("ymin"), (lat + size).alias("ymax"))
    return table(spark, sf_dir, "part").select(
        F.when(k % 43 == 9, F.lit(" \t")).when(k % 17 != 5, F.concat(F.lit("land-"), (k - F.when(k % 23 == 22, 1).otherwise(0)).cast("string"))).alias("id"),
        F.struct(F.when(k % 11 == 3, F.lit("  ")).otherwise(F.col("p_name")).alias("primary")).alias("names"),
        F.when(k % 7 == 2, F.lit("water")).otherwise(F.lit("physical")).alias("subtype"),
        F.when(k % 5 == 1, F.lit("valley")).when(k % 3 == 0, F.lit("volcano")).otherwise(F.lit("peak")).alias("class"),
        F.when(k % 41 == 17, num(float("nan"))).when(k % 10 != 0, F.col("p_size") * num(60) + num(400)).alias("elevation"),
        F.when(k % 19 != 6, box).alias("bbox"), k.alias("ord"),
    )


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, ms, magneticDeg, trueDeg, accuracyDeg: compass readings; true and accuracy are absent for some."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms"),
        F.when(e % 9 != 0, F.pmod(F.col("value") * num(7.3), num(360))).alias("magneticDeg"),
        F.when(e % 3 == 0, F.pmod(F.col("value") * num(7.3) + num(2.5), num(360))).alias("trueDeg"),
        F.when(e % 4 != 0, (e % 40 - 3).cast("double")).alias("accuracyDeg"), e.alias("event_id"),
    )


def gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, ms, x, y, z in g: accelerometer readings, some of them no gravity."""
    e, v = F.col("event_id"), F.col("value")
    scale = F.when(e % 29 == 0, num(2)).otherwise(num(1))
    a, b = F.radians(v % num(180) - num(90)), F.radians(v * num(3.7) % num(360))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms"),
        (scale * F.cos(a) * F.sin(b)).alias("x"), (scale * -F.cos(a) * F.cos(b)).alias("y"), (scale * F.sin(a)).alias("z"), e.alias("event_id"),
    )
