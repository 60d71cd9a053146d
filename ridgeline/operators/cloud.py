"""Nearest samples of a scattered cloud: cells of a grid, joined by equality, coarser from round to round until the nearest is proven.

A round compares a point with the samples of its own cell and the eight around it. Whatever lies outside them is farther than one
cell, so a nearest found within a cell's size is the nearest of all; points without one go on to cells of twice the size.
Points of one place are compared once, and so are samples: of those of one place the lowest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import num
from ridgeline.tables import write_down

#: Cells of the first round, and what a match may be apart at most if nothing else is said.
CELL_DEG = 1e-5


def _celled(df: DataFrame, size: float) -> DataFrame:
    return df.withColumn("_i", F.floor(F.col("lat") / num(size))).withColumn("_j", F.floor(F.col("lon") / num(size)))


def _places(points: DataFrame) -> DataFrame:
    """One point for each place."""
    return points.select("lat", "lon").distinct().select(F.struct("lat", "lon").alias("point_id"), "lat", "lon")


def _lowest(samples: DataFrame) -> DataFrame:
    return samples.groupBy("lat", "lon").agg(F.min(F.struct("elevationM"))["elevationM"].alias("elevationM"))


def _at_places(points: DataFrame, found: DataFrame) -> DataFrame:
    """point_id, elevationM, apartDeg of points by what was found at their places (point_id: the place)."""
    there = found.select(F.col("point_id.lat").alias("_lat"), F.col("point_id.lon").alias("_lon"), "elevationM", "apartDeg")
    joined = points.select("point_id", "lat", "lon").join(there, F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon")), "left")
    return joined.select("point_id", "elevationM", "apartDeg")


def one_round(points: DataFrame, samples: DataFrame, size: float) -> DataFrame:
    """points with nearest (apart, lat, lon, elevationM) among the samples of nine cells; null if there is none. Of equals the most southern, then western."""
    around = _celled(points, size).select("*", F.explode(F.array(*[F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("c"))
    s = _celled(samples.select("lat", "lon", "elevationM"), size).select(F.col("_i").alias("i"), F.col("_j").alias("j"), F.struct(F.col("lat").alias("slat"), F.col("lon").alias("slon"), "elevationM").alias("s"))
    met = around.select("point_id", "lat", "lon", "c.i", "c.j").join(s, ["i", "j"])
    apart = F.sqrt((F.col("s.slat") - F.col("lat")) * (F.col("s.slat") - F.col("lat")) + (F.col("s.slon") - F.col("lon")) * (F.col("s.slon") - F.col("lon")))
    best = met.groupBy("point_id").agg(F.min(F.struct(apart.alias("apart"), "s.slat", "s.slon", "s.elevationM")).alias("nearest"))
    return points.join(best, "point_id", "left")


def within_tolerance(points: DataFrame, samples: DataFrame, tolerance_deg: float = CELL_DEG) -> DataFrame:
    """point_id, elevationM of the nearest sample no farther than the tolerance (in degrees on both axes); null where there is none: no data is no height."""
    found = one_round(_places(points), _lowest(samples), tolerance_deg)
    near = F.col("nearest.apart") <= tolerance_deg
    return _at_places(points, found.select("point_id", F.when(near, F.col("nearest.elevationM")).alias("elevationM"), F.when(near, F.col("nearest.apart")).alias("apartDeg")))


def nearest(points: DataFrame, samples: DataFrame, cell_deg: float) -> DataFrame:
    """point_id, elevationM, apartDeg of the nearest sample at any distance; null for all if there are no samples. point_id is unique.

    ``cell_deg`` should hold a handful of samples: few points then need more than a round or two.
    """
    samples = write_down(_lowest(samples), "samples")
    size, open_points, done = cell_deg, _places(points), []
    while True:
        found = write_down(one_round(open_points, samples, size), "nearest")
        widest = size >= 720
        sure = F.lit(True) if widest else F.coalesce(F.col("nearest.apart") <= size, F.lit(False))
        done.append(found.where(sure).select("point_id", "nearest.elevationM", F.col("nearest.apart").alias("apartDeg")))
        open_points, size = found.where(~sure).select("point_id", "lat", "lon"), size * 2
        if widest or not open_points.limit(1).count():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return _at_places(points, out)
