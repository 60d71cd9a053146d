"""The retired first generation's operators, kept for those who still run them: a 6371 km sphere, fixed rays, linear screens.

Where they differ from the rest of the engine (no refraction in a profile, whole degrees of bearing, absence read as
visible) the difference is theirs and stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import fold, num

# fixed values
RADIUS_KM = 6371.0
REFRACTION = 0.13
RAY_DISTANCES_KM = [0.5, 1, 2, 3, 5, 7, 10, 15, 20, 30, 50, 75, 100]
SPARSE_DISTANCES_KM = [2, 5, 10, 20, 40, 70, 100]
BEARING_STEP_DEG, FOV_MARGIN_DEG = 2, 10
CARDINALS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
REFETCH_KM, COMPASS_ALPHA = 0.5, 0.2


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upward."""
    return F.floor(x + num(0.5)).cast("double")


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / num(2), F.radians(lon2 - lon1) / num(2)
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return num(2 * RADIUS_KM) * F.asin(F.sqrt(F.least(num(1), a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return fold(F.degrees(F.atan2(F.cos(p2) * F.sin(dlon), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon))))


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    p, b, d = F.radians(lat), F.radians(bearing), km / num(RADIUS_KM)
    north = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    east = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(north))
    return F.degrees(north), fold(F.degrees(east) + num(180)) - num(180)


def elevation_angle_deg(eye_m: Column, target_m: Column, km: Column, refracted: bool) -> Column:
    """Straight up within a metre; curvature alone, or with the standard refraction."""
    metres = km * num(1000)
    radius = RADIUS_KM / (1 - REFRACTION) if refracted else RADIUS_KM
    drop = metres * metres / num(2 * radius * 1000)
    return F.when(metres < 1, num(90)).otherwise(F.degrees(F.atan2(target_m - eye_m - drop, metres)))


def screen(bearing: Column, altitude: Column, heading: Column, hfov: Column, vfov: Column) -> dict[str, Column]:
    """Angle-linear position: x and y in the frame's units, and whether it is in view."""
    turn = bearing - heading
    turn = F.when(turn > 180, turn - num(360)).otherwise(turn)
    turn = F.when(turn < -180, turn + num(360)).otherwise(turn)
    return {"x": num(0.5) + turn / hfov, "y": num(0.5) - altitude / vfov, "inView": F.abs(turn) <= hfov / num(2)}


def cardinal(heading: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CARDINALS)), (half_up(heading / num(45)) % 8 + 1).cast("int"))


def ray_bearings(heading: Column | None = None, fov: Column | None = None) -> Column:
    """Bearings to sweep: every second degree, or the whole degrees of a view and its margin, each once."""
    if heading is None or fov is None:
        return F.sequence(F.lit(0), F.lit(360 - BEARING_STEP_DEG), F.lit(BEARING_STEP_DEG))
    span = fov / num(2) + num(FOV_MARGIN_DEG)
    steps = F.sequence(F.lit(0), F.floor(span * 2).cast("int"))
    return F.array_sort(F.array_distinct(F.transform(steps, lambda i: (half_up(fold(heading - span + i)) % 360).cast("int"))))


def ray_points(observers: DataFrame, bearings: Column, distances_km: list[float]) -> DataFrame:
    """observer_id, bearingDeg, distanceKm, lat, lon of every sample that a sweep asks for."""
    swept = observers.select("observer_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.explode(bearings).alias("bearingDeg"))
    swept = swept.select("*", F.explode(F.array(*map(num, distances_km))).alias("distanceKm"))
    lat, lon = destination(F.col("_lat"), F.col("_lon"), F.col("bearingDeg").cast("double"), F.col("distanceKm"))
    return swept.select("observer_id", "bearingDeg", "distanceKm", lat.alias("lat"), lon.alias("lon"))


def rounded_profile(samples: DataFrame) -> DataFrame:
    """observer_id, bearingDeg, angleDeg: the highest angle of each whole degree; angles of -90 or less leave no point.

    samples: observer_id, bearing, angle.
    """
    degree = half_up(F.col("bearing")) % 360
    return samples.where("angle > -90").groupBy("observer_id", degree.alias("bearingDeg")).agg(F.max("angle").alias("angleDeg"))


def ray_profile(samples: DataFrame) -> DataFrame:
    """observer_id, bearingDeg, angleDeg: each ray's highest angle, -90 at least. samples: observer_id, bearingDeg, angle."""
    return samples.groupBy("observer_id", "bearingDeg").agg(F.greatest(num(-90), F.max("angle")).alias("angleDeg"))


def visible_within(peaks: DataFrame, profile: DataFrame, window_deg: int = 5, tolerance_deg: float = 0.5) -> DataFrame:
    """Adds maxAngleDeg and visible: against the highest point of the profile within a window of whole degrees.

    The window's bearings are exploded and joined by equality. Without a point there a peak is visible.
    peaks: observer_id, id, bearing, angle; profile: rounded_profile().
    """
    at = peaks.select("observer_id", "id", "bearing", "angle", F.explode(F.sequence(F.lit(-window_deg), F.lit(window_deg))).alias("_o"))
    at = at.withColumn("bearingDeg", fold(half_up(F.col("bearing")) + F.col("_o")))
    near = at.join(profile, ["observer_id", "bearingDeg"], "left").groupBy("observer_id", "id").agg(F.first("angle").alias("angle"), F.max("angleDeg").alias("maxAngleDeg"))
    return near.withColumn("visible", F.coalesce(F.col("angle") >= F.col("maxAngleDeg") - num(tolerance_deg), F.lit(True)))


def interpolated(peaks: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds horizonDeg: the profile at each peak's bearing, linear between neighbours and across north; null without a profile.

    A profile becomes segments from each point to the next (the last to the first); a segment is found by whole degrees,
    which are joined by equality, so a peak meets the few segments of its degree only.
    """
    order = Window.partitionBy("observer_id").orderBy("bearingDeg")
    first = Window.partitionBy("observer_id")
    segments = profile.select(
        "observer_id", F.col("bearingDeg").cast("double").alias("lo"), F.col("angleDeg").alias("loAngle"),
        F.coalesce(F.lead("bearingDeg").over(order).cast("double"), F.min("bearingDeg").over(first) + num(360)).alias("hi"),
        F.coalesce(F.lead("angleDeg").over(order), F.min_by("angleDeg", "bearingDeg").over(first)).alias("hiAngle"),
    )
    cells = F.sequence(F.floor("lo").cast("int"), F.floor("hi").cast("int"))
    cut = segments.select("*", F.explode(F.transform(cells, lambda c: F.pmod(c, F.lit(360)))).alias("_cell")).dropDuplicates(["observer_id", "lo", "_cell"]).alias("s")
    p = peaks.withColumn("_t", fold(F.col("bearing"))).withColumn("_cell", F.floor("_t").cast("int")).alias("p")
    same = [F.col("p.observer_id") == F.col("s.observer_id"), F.col("p._cell") == F.col("s._cell")]
    unwrapped = F.when(F.col("p._t") < F.col("s.lo"), F.col("p._t") + num(360)).otherwise(F.col("p._t"))
    hit = (unwrapped >= F.col("s.lo")) & (unwrapped < F.col("s.hi"))
    part = (unwrapped - F.col("s.lo")) / (F.col("s.hi") - F.col("s.lo"))
    angle = F.col("s.loAngle") + part * (F.col("s.hiAngle") - F.col("s.loAngle"))
    return p.join(cut, [*same, hit], "left").select("p.observer_id", "p.id", "p.bearing", "p.angle", angle.alias("horizonDeg"))


def nearest(peaks: DataFrame, most: int = 30) -> DataFrame:
    """The ``most`` nearest peaks of each observer, ties by id. peaks: observer_id, id, distanceKm."""
    order = Window.partitionBy("observer_id").orderBy("distanceKm", "id")
    return peaks.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def lenient_number(text: Column) -> Column:
    """The number that is left when all but digits, dots and minus signs are taken out, as far as it can be read."""
    left = F.regexp_replace(text, r"[^\d.\-]", "")  # fixed: what that generation took out
    return F.when(text != "", F.regexp_extract(left, r"^(-?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double"))


def lenient_elevation(ele: Column, feet: Column) -> tuple[Column, Column]:
    """Metres and their source; 0 and 'unknown' where neither tag has a number."""
    metres, other = lenient_number(ele), lenient_number(feet)
    return F.coalesce(metres, half_up(other * num(0.3048)), num(0)), F.when(F.coalesce(metres, other).isNull(), "unknown").otherwise("osm")


def _traced(df: DataFrame, key: str, order: list[str], schema: str, start, step) -> DataFrame:
    """A fold along each key's rows in order; state is one key's, so nothing is gathered. Batches may cut a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, start
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if held is None or getattr(row, key) != held:
                    held, state = getattr(row, key), start
                state, out = step(state, row)
                rows.append(out)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def compass_trace(readings: DataFrame) -> DataFrame:
    """device, event_id, headingDeg: an exponential mean on the circle along each device's readings (device, ms, event_id, rawDeg)."""

    def step(held: float, row):
        turn = row.rawDeg - held
        turn = turn - 360 if turn > 180 else turn + 360 if turn < -180 else turn
        held = (held + COMPASS_ALPHA * turn + 360) % 360
        return held, (row.device, row.event_id, held)

    return _traced(readings.where("rawDeg is not null"), "device", ["ms", "event_id"], "device bigint, event_id bigint, headingDeg double", 0.0, step)


def refetches(fixes: DataFrame) -> DataFrame:
    """device, event_id, fetched: a fix asks anew if it is REFETCH_KM or more from where was asked last (device, ms, event_id, lat, lon)."""
    from math import asin, cos, radians, sin, sqrt

    def apart(a, b) -> float:
        dlat, dlon = radians(b[0] - a[0]) / 2, radians(b[1] - a[1]) / 2
        return 2 * RADIUS_KM * asin(sqrt(min(1.0, sin(dlat) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(dlon) ** 2)))

    def step(last, row):
        here = (row.lat, row.lon)
        asks = last is None or not apart(last, here) < REFETCH_KM
        return (here if asks else last), (row.device, row.event_id, asks)

    return _traced(fixes, "device", ["ms", "event_id"], "device bigint, event_id bigint, fetched boolean", None, step)
