"""Horizon profiles from several sources: folded, merged, their steps united; and what stands before a summit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import fold, num


def steps_or_point(steps: Column, distance_km: Column, altitude: Column, elevation: Column) -> Column:
    """A point's steps; a point without any is its own one step."""
    own = F.array(F.struct(distance_km.alias("distanceKm"), altitude.alias("altitudeDeg"), elevation.alias("elevationM")))
    return F.coalesce(steps, own)


def united_steps(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, distanceKm, altitudeDeg, elevationM: steps of several staircases as one that rises strictly.

    Of steps at one distance the highest stays (the earliest by ``ord`` if they tie), and of these such as stand higher than all nearer ones.
    """
    best = F.min(F.struct((-F.col("altitudeDeg")).alias("low"), "ord", "altitudeDeg", "elevationM")).alias("s")
    highest = steps.groupBy(*keys, "distanceKm").agg(best).select(*keys, "distanceKm", "s.altitudeDeg", "s.elevationM")
    nearer = Window.partitionBy(*keys).orderBy("distanceKm").rowsBetween(Window.unboundedPreceding, -1)
    return highest.withColumn("_high", F.max("altitudeDeg").over(nearer)).where("_high is null or altitudeDeg > _high").drop("_high")


def normalised_profile(points: DataFrame) -> DataFrame:
    """One point for each folded bearing of each observer, with the united steps of all points there.

    points: observer_id, bearingDeg (any turn), distanceKm, altitudeDeg, elevationM, steps (array, may be null), ord (input order).
    The highest point stands for its bearing, the earliest if they tie.
    """
    keys = ["observer_id", "bearingDeg"]
    folded = points.withColumn("bearingDeg", fold(F.col("bearingDeg")))
    best = F.min(F.struct((-F.col("altitudeDeg")).alias("low"), "ord", "altitudeDeg", "distanceKm", "elevationM")).alias("p")
    top = folded.groupBy(*keys).agg(best).select(*keys, "p.altitudeDeg", "p.distanceKm", "p.elevationM")
    every = steps_or_point(F.col("steps"), F.col("distanceKm"), F.col("altitudeDeg"), F.col("elevationM"))
    steps = folded.select(*keys, "ord", F.inline(every))
    united = united_steps(steps, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("distanceKm", "altitudeDeg", "elevationM"))).alias("steps"))
    return top.join(united, keys)


def occluder(steps: Column, distance_km: Column, altitude: Column) -> Column:
    """The first nearer step that reaches a summit's altitude, else the tallest nearer one (the nearest if they tie); null if none is nearer.

    steps: array of (distanceKm, altitudeDeg, elevationM) from near to far.
    """
    nearer = F.filter(steps, lambda s: s["distanceKm"] < distance_km)
    reaching = F.filter(nearer, lambda s: s["altitudeDeg"] >= altitude)
    tallest = F.array_max(F.transform(nearer, lambda s: F.struct(s["altitudeDeg"].alias("a"), (-s["distanceKm"]).alias("d"), s.alias("s"))))["s"]
    return F.coalesce(F.get(reaching, F.lit(0)), tallest)


def point_at(points: Column, index: Column) -> Column:
    """An element by its place from 0; a place that there isn't is an error."""
    wrong = F.raise_error(F.concat(F.lit("no point "), index.cast("string")))
    return F.when((index >= 0) & (index < F.size(points)), F.get(points, index)).otherwise(wrong)


def analytic_profile(centres: DataFrame, half_span: float, step: float, base: float, bumps: list[tuple[float, float, float]], distance_km: float = 10.0) -> DataFrame:
    """key, bearingDeg, altitudeDeg, distanceKm, elevationM: closed-form skylines around centres (key, centreDeg).

    bumps: offset from the centre, width and height in degrees of bell curves on a level base.
    """
    if not step > 0:
        raise ValueError("the step must be above 0")
    count = int(2 * half_span / step + 0.5)
    at = centres.select("key", "centreDeg", F.explode(F.sequence(F.lit(0), F.lit(count))).alias("_i"))
    offset = num(-half_span) + F.col("_i") * num(step)
    altitude = num(base)
    for centre, width, height in bumps:
        z = (offset - num(centre)) / num(width)
        altitude = altitude + num(height) * F.exp(num(-0.5) * z * z)
    return at.select("key", fold(F.col("centreDeg") + offset).alias("bearingDeg"), altitude.alias("altitudeDeg"), num(distance_km).alias("distanceKm"), (num(distance_km * 1000) * F.tan(F.radians(altitude))).alias("elevationM"))
