"""Queries of the retired first generation's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import num
from ridgeline.operators import classic as c
from ridgeline.operators import visibility as v
from ridgeline.plans import sqltext as s
from ridgeline.plans.scene import r
from ridgeline.sources import views


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observer_id, bearingDeg, bearing, plain and refracted angle of every terrain sample."""
    o = views.observers(spark, sf_dir).select("observer_id", "lat", "lon")
    rays = views.rays(spark, sf_dir).join(o, "observer_id")
    lat, lon = c.destination(F.col("lat"), F.col("lon"), F.col("bearingDeg"), F.col("distanceM") / num(1000))
    at = rays.withColumn("_lat", lat).withColumn("_lon", lon)
    km = c.distance_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    at = at.withColumn("km", km).withColumn("bearing", c.bearing_deg(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    plain, bent = (c.elevation_angle_deg(F.col("eyeElevationM"), F.col("elevationM"), F.col("km"), k) for k in (False, True))
    return at.select("observer_id", "bearingDeg", "bearing", plain.alias("plain"), bent.alias("bent"))


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of an observer and a summit of known height within the radius, by the first generation's formulas."""
    o, p = views.observers(spark, sf_dir), views.summits(spark, sf_dir).where("elevationM is not null")
    near = v.within_radius(o, p, views.RADIUS_KM).select("observer_id", "id")
    o = o.select("observer_id", F.col("lat").alias("oLat"), F.col("lon").alias("oLon"), F.col("eyeElevationM").alias("eyeM"))
    pair = near.join(o, "observer_id").join(p.select("id", "lat", "lon", "elevationM"), "id")
    at = [F.col(x) for x in ("oLat", "oLon", "lat", "lon")]
    pair = pair.withColumn("distanceKm", c.distance_km(*at)).withColumn("bearing", c.bearing_deg(*at))
    for name, bent in (("plain", False), ("bent", True)):
        pair = pair.withColumn(name, c.elevation_angle_deg(F.col("eyeM"), F.col("elevationM"), F.col("distanceKm"), bent))
    return pair


def classic_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, bearing, the point as far again, both angles, screen position and cardinal of every pair within the radius."""
    p = _peaks(spark, sf_dir)
    lat, lon = c.destination(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("distanceKm"))
    heading = F.pmod(F.col("observer_id") * num(14.5), num(360))
    on = c.screen(F.col("bearing"), F.col("bent"), heading, num(66), num(41))
    return p.select(
        "observer_id", "id", r("distanceKm", 5).alias("distanceKm"), r("bearing").alias("bearingDeg"), r(lat, 6).alias("beyondLat"), r(lon, 6).alias("beyondLon"),
        r("plain").alias("plainDeg"), r("bent").alias("refractedDeg"), r(on["x"], 5).alias("x"), r(on["y"], 5).alias("y"), on["inView"].alias("inView"),
        c.cardinal(F.round("bearing", 4)).alias("cardinal"),
    )


def classic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest unrefracted angle of each whole degree."""
    found = c.rounded_profile(_samples(spark, sf_dir).select("observer_id", "bearing", F.col("plain").alias("angle")))
    return found.select("observer_id", "bearingDeg", r("angleDeg").alias("angleDeg"))


def classic_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest refracted angle of each ray."""
    found = c.ray_profile(_samples(spark, sf_dir).select("observer_id", "bearingDeg", F.col("bent").alias("angle")))
    return found.select("observer_id", "bearingDeg", r("angleDeg").alias("angleDeg"))


def classic_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summits against the highest of the profile within five degrees."""
    profile = c.rounded_profile(_samples(spark, sf_dir).where("bearingDeg not between 60 and 80").select("observer_id", "bearing", F.col("plain").alias("angle")))
    seen = c.visible_within(_peaks(spark, sf_dir).select("observer_id", "id", "bearing", F.col("plain").alias("angle")), profile)
    return seen.select("observer_id", "id", r("maxAngleDeg").alias("maxAngleDeg"), "visible")


def classic_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summits that clear the interpolated skyline by -0.3 degrees or more; without a skyline all do."""
    profile = c.ray_profile(_samples(spark, sf_dir).where("observer_id <> 3").select("observer_id", "bearingDeg", F.col("bent").alias("angle")))
    seen = c.interpolated(_peaks(spark, sf_dir).select("observer_id", "id", "bearing", F.col("bent").alias("angle")), profile)
    clear = F.col("angle") - F.coalesce("horizonDeg", num(0))
    kept = seen.where(F.col("horizonDeg").isNull() | (clear >= -0.3))
    return kept.select("observer_id", "id", r(F.coalesce("horizonDeg", num(0))).alias("horizonDeg"), r(clear).alias("clearanceDeg"))


def classic_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that three kinds of sweep ask for: the full circle, a view, and the sparse circle."""
    o = views.observers(spark, sf_dir).withColumn("heading", F.pmod(F.col("observer_id") * num(31.7), num(360)))
    kinds = {
        "circle": c.ray_points(o, c.ray_bearings(), c.RAY_DISTANCES_KM), "view": c.ray_points(o, c.ray_bearings(F.col("heading"), num(60)), c.RAY_DISTANCES_KM),
        "sparse": c.ray_points(o, c.ray_bearings(), c.SPARSE_DISTANCES_KM),
    }
    every = [d.select(F.lit(k).alias("sweep"), "observer_id", "bearingDeg", "distanceKm", r("lat", 6).alias("lat"), r("lon", 6).alias("lon")) for k, d in kinds.items()]
    return every[0].unionByName(every[1]).unionByName(every[2])


def classic_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest summits of each observer."""
    peaks = _peaks(spark, sf_dir).withColumn("distanceKm", F.round("distanceKm", 6))
    return c.nearest(peaks).select("observer_id", "id", "distanceKm", F.col("nth").cast("long").alias("nth"))


def classic_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights read leniently from tags in many spellings."""
    k = F.col("p_partkey")
    ele = F.element_at(F.array(*map(F.lit, ["1200", " 2,345 m", "-12.5", "ca. 900m", "1.2.3", "none", "", "12-34", "."])), (k % 9 + 1).cast("int"))
    feet = F.element_at(F.array(*map(F.lit, ["4000", "3 000 ft", "x", "-1,000.5'"])), (k % 4 + 1).cast("int"))
    tags = views.table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 11 != 0, ele).alias("ele"), F.when(k % 3 != 0, feet).alias("feet"))
    metres, source = c.lenient_elevation(F.col("ele"), F.col("feet"))
    return tags.select("k", metres.alias("elevationM"), source.alias("source"))


def classic_compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed compass of every device at each of its readings."""
    readings = views.headings(spark, sf_dir).select("device", "ms", "event_id", F.col("magneticDeg").alias("rawDeg"))
    return c.compass_trace(readings).select("device", "event_id", r("headingDeg").alias("headingDeg"))


def classic_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a device's fixes ask for new terrain."""
    e = F.col("event_id")
    fixes = views.headings(spark, sf_dir).select("device", "ms", "event_id", (num(46) + (e % 13) * num(0.0011)).alias("lat"), (num(7) + (e % 7) * num(0.0017)).alias("lon"))
    return c.refetches(fixes)


_ALL = (classic_scalars, classic_profile, classic_skyline, classic_visible, classic_clearance, classic_rays, classic_nearest, classic_heights, classic_compass, classic_refetch)
QUERIES = {f.__name__: f for f in _ALL}


def _km(a: str, b: str, x: str, y: str) -> str:
    h = f"pow(sin(radians({x} - {a}) / 2e0), 2) + cos(radians({a})) * cos(radians({x})) * pow(sin(radians({y} - {b}) / 2e0), 2)"
    return f"(12742e0 * asin(sqrt(least(1e0, {h}))))"


def _bearing(a: str, b: str, x: str, y: str) -> str:
    d = f"radians({y} - {b})"
    return s.fold(f"degrees(atan2(cos(radians({x})) * sin({d}), cos(radians({a})) * sin(radians({x})) - sin(radians({a})) * cos(radians({x})) * cos({d})))")


def _dest(la: str, lo: str, b: str, km: str) -> tuple[str, str]:
    d = f"({km} / 6371e0)"
    p = f"asin(sin(radians({la})) * cos({d}) + cos(radians({la})) * sin({d}) * cos(radians({b})))"
    return f"degrees({p})", f"({s.fold(f'degrees(radians({lo}) + atan2(sin(radians({b})) * sin({d}) * cos(radians({la})), cos({d}) - sin(radians({la})) * sin({p}))) + 180e0')} - 180e0)"


def _angle(eye: str, top: str, km: str, radius: str) -> str:
    return f"(CASE WHEN {km} * 1000e0 < 1 THEN 90e0 ELSE degrees(atan2({top} - {eye} - pow({km} * 1000e0, 2) / (2e0 * {radius} * 1000e0), {km} * 1000e0)) END)"


PLAIN, BENT = "6371e0", "(6371e0 / 0.87e0)"
_LAT, _LON = _dest("o.lat", "o.lon", "y.bearingDeg", "(y.distanceM / 1000e0)")
SAMPLES = f"""{s.OBSERVER}, {s.RAY}, c_at AS (
  SELECT y.observer_id, y.bearingDeg, y.eyeElevationM, y.elevationM, o.lat, o.lon, {_LAT} AS la, {_LON} AS lo FROM g_ray y JOIN g_observer o ON o.observer_id = y.observer_id),
c_km AS (SELECT *, {_km('lat', 'lon', 'la', 'lo')} AS km, {_bearing('lat', 'lon', 'la', 'lo')} AS bearing FROM c_at),
c_sample AS (SELECT *, {_angle('eyeElevationM', 'elevationM', 'km', PLAIN)} AS plain, {_angle('eyeElevationM', 'elevationM', 'km', BENT)} AS bent FROM c_km)"""
PEAKS = f"""{s.SUMMIT}, c_pair AS (
  SELECT o.observer_id, p.id, o.lat AS oLat, o.lon AS oLon, o.eyeElevationM, p.lat, p.lon, p.elevationM FROM g_observer o, g_summit p
  WHERE p.elevationM IS NOT NULL AND {s.haversine('o.lat', 'o.lon', 'p.lat', 'p.lon')} <= 30000e0),
c_far AS (SELECT *, {_km('oLat', 'oLon', 'lat', 'lon')} AS distanceKm, {_bearing('oLat', 'oLon', 'lat', 'lon')} AS bearing FROM c_pair),
c_peak AS (SELECT *, {_angle('eyeElevationM', 'elevationM', 'distanceKm', PLAIN)} AS plain, {_angle('eyeElevationM', 'elevationM', 'distanceKm', BENT)} AS bent FROM c_far)"""
_BEYOND = _dest("lat", "lon", "bearing", "distanceKm")
_RAYS = _dest("lat", "lon", "CAST(b AS DOUBLE)", "d")
TURN = "(CASE WHEN bearing - heading > 180 THEN bearing - heading - 360e0 WHEN bearing - heading < -180 THEN bearing - heading + 360e0 ELSE bearing - heading END)"
NUMBER = r"CASE WHEN {0} <> '' THEN TRY_CAST(regexp_extract(regexp_replace({0}, '[^\d.\-]', '', 'g'), '^(-?(?:\d+\.?\d*|\.\d+))', 1) AS DOUBLE) END"

ORACLES = {
    "classic_scalars": f"""WITH {s.OBSERVER}, {PEAKS}, h AS (SELECT *, {s.fold('observer_id * 14.5e0')} AS heading FROM c_peak)
SELECT observer_id, id, round(distanceKm, 5) + 0e0 AS distanceKm, round(bearing, 4) + 0e0 AS bearingDeg, round({_BEYOND[0]}, 6) + 0e0 AS beyondLat, round({_BEYOND[1]}, 6) + 0e0 AS beyondLon,
  round(plain, 4) + 0e0 AS plainDeg, round(bent, 4) + 0e0 AS refractedDeg, round(0.5e0 + {TURN} / 66e0, 5) + 0e0 AS x, round(0.5e0 - bent / 41e0, 5) + 0e0 AS y, abs({TURN}) <= 33e0 AS inView,
  ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(round(bearing, 4) / 45e0 + 0.5e0) AS BIGINT) % 8 + 1] AS cardinal FROM h""",
    "classic_profile": f"WITH {SAMPLES} SELECT observer_id, floor(bearing + 0.5e0) % 360e0 AS bearingDeg, round(max(plain), 4) + 0e0 AS angleDeg FROM c_sample WHERE plain > -90 GROUP BY 1, 2",
    "classic_skyline": f"WITH {SAMPLES} SELECT observer_id, bearingDeg, round(greatest(-90e0, max(bent)), 4) + 0e0 AS angleDeg FROM c_sample GROUP BY 1, 2",
    "classic_visible": f"""WITH {SAMPLES}, {PEAKS}, prof AS (SELECT observer_id, floor(bearing + 0.5e0) % 360e0 AS b, max(plain) AS a FROM c_sample WHERE plain > -90 AND NOT bearingDeg BETWEEN 60 AND 80 GROUP BY 1, 2)
SELECT p.observer_id, p.id, round(max(f.a), 4) + 0e0 AS maxAngleDeg, coalesce(any_value(p.plain) >= max(f.a) - 0.5e0, true) AS visible
FROM c_peak p LEFT JOIN prof f ON f.observer_id = p.observer_id AND abs((f.b - floor(p.bearing + 0.5e0) + 540e0) % 360e0 - 180e0) <= 5 GROUP BY p.observer_id, p.id""",
    "classic_clearance": f"""WITH {SAMPLES}, {PEAKS}, prof AS (SELECT observer_id, bearingDeg AS b, greatest(-90e0, max(bent)) AS a FROM c_sample WHERE observer_id <> 3 GROUP BY 1, 2),
seg AS (SELECT observer_id, b AS lo, a AS la, coalesce(lead(b) OVER w, min(b) OVER (PARTITION BY observer_id) + 360e0) AS hi, coalesce(lead(a) OVER w, first_value(a) OVER w) AS ha FROM prof WINDOW w AS (PARTITION BY observer_id ORDER BY b)),
hit AS (SELECT p.observer_id, p.id, p.bent, f.la + (CASE WHEN p.bearing < f.lo THEN p.bearing + 360e0 ELSE p.bearing END - f.lo) / (f.hi - f.lo) * (f.ha - f.la) AS h
  FROM c_peak p LEFT JOIN seg f ON f.observer_id = p.observer_id AND CASE WHEN p.bearing < f.lo THEN p.bearing + 360e0 ELSE p.bearing END >= f.lo AND CASE WHEN p.bearing < f.lo THEN p.bearing + 360e0 ELSE p.bearing END < f.hi)
SELECT observer_id, id, round(coalesce(h, 0e0), 4) + 0e0 AS horizonDeg, round(bent - coalesce(h, 0e0), 4) + 0e0 AS clearanceDeg FROM hit WHERE h IS NULL OR bent - h >= -0.3e0""",
    "classic_rays": f"""WITH {s.OBSERVER}, o AS (SELECT observer_id, lat, lon, {s.fold('observer_id * 31.7e0')} AS heading FROM g_observer),
b AS (SELECT 'circle' AS sweep, *, unnest(range(0, 360, 2)) AS b FROM o UNION ALL SELECT 'sparse', *, unnest(range(0, 360, 2)) FROM o
  UNION ALL SELECT DISTINCT 'view', observer_id, lat, lon, heading, CAST(floor({s.fold('heading - 40e0 + i')} + 0.5e0) AS BIGINT) % 360 FROM (SELECT *, unnest(range(0, 81)) AS i FROM o)),
d AS (SELECT *, unnest(CASE WHEN sweep = 'sparse' THEN [2e0, 5e0, 10e0, 20e0, 40e0, 70e0, 100e0] ELSE [0.5e0, 1e0, 2e0, 3e0, 5e0, 7e0, 10e0, 15e0, 20e0, 30e0, 50e0, 75e0, 100e0] END) AS d FROM b)
SELECT sweep, observer_id, CAST(b AS INTEGER) AS bearingDeg, d AS distanceKm, round({_RAYS[0]}, 6) + 0e0 AS lat, round({_RAYS[1]}, 6) + 0e0 AS lon FROM d""",
    "classic_nearest": f"""WITH {s.OBSERVER}, {PEAKS} SELECT observer_id, id, km AS distanceKm, nth FROM (
  SELECT observer_id, id, km, row_number() OVER (PARTITION BY observer_id ORDER BY km, id) AS nth FROM (SELECT *, round(distanceKm, 6) AS km FROM c_peak)) WHERE nth <= 30""",
    "classic_heights": f"""WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 <> 0 THEN ['1200', ' 2,345 m', '-12.5', 'ca. 900m', '1.2.3', 'none', '', '12-34', '.'][p_partkey % 9 + 1] END AS ele,
  CASE WHEN p_partkey % 3 <> 0 THEN ['4000', '3 000 ft', 'x', '-1,000.5'''][p_partkey % 4 + 1] END AS feet FROM part),
n AS (SELECT k, {NUMBER.format('ele')} AS m, {NUMBER.format('feet')} AS f FROM t)
SELECT k, coalesce(m, floor(f * 0.3048e0 + 0.5e0), 0e0) AS elevationM, CASE WHEN m IS NULL AND f IS NULL THEN 'unknown' ELSE 'osm' END AS source FROM n""",
    "classic_compass": f"""WITH RECURSIVE {s.HEADING}, n AS (SELECT device, event_id, magneticDeg AS raw, row_number() OVER (PARTITION BY device ORDER BY ms, event_id) AS i FROM g_heading WHERE magneticDeg IS NOT NULL),
t AS (SELECT device, event_id, i, {{0}} AS h FROM (SELECT *, 0e0 AS h FROM n WHERE i = 1)
  UNION ALL SELECT n.device, n.event_id, n.i, {{1}} FROM t JOIN n ON n.device = t.device AND n.i = t.i + 1)
SELECT device, event_id, round(h, 4) + 0e0 AS headingDeg FROM t""".replace("{0}", "(h + 0.2e0 * (CASE WHEN raw - h > 180 THEN raw - h - 360e0 WHEN raw - h < -180 THEN raw - h + 360e0 ELSE raw - h END) + 360e0) % 360e0").replace(
        "{1}", "(t.h + 0.2e0 * (CASE WHEN n.raw - t.h > 180 THEN n.raw - t.h - 360e0 WHEN n.raw - t.h < -180 THEN n.raw - t.h + 360e0 ELSE n.raw - t.h END) + 360e0) % 360e0"),
    "classic_refetch": f"""WITH RECURSIVE {s.HEADING}, n AS (SELECT device, event_id, 46e0 + event_id % 13 * 0.0011e0 AS lat, 7e0 + event_id % 7 * 0.0017e0 AS lon, row_number() OVER (PARTITION BY device ORDER BY ms, event_id) AS i FROM g_heading),
t AS (SELECT device, event_id, i, lat AS la, lon AS lo, true AS fetched FROM n WHERE i = 1
  UNION ALL SELECT n.device, n.event_id, n.i, CASE WHEN {_km('t.la', 't.lo', 'n.lat', 'n.lon')} >= 0.5e0 THEN n.lat ELSE t.la END, CASE WHEN {_km('t.la', 't.lo', 'n.lat', 'n.lon')} >= 0.5e0 THEN n.lon ELSE t.lo END,
    {_km('t.la', 't.lo', 'n.lat', 'n.lon')} >= 0.5e0 FROM t JOIN n ON n.device = t.device AND n.i = t.i + 1)
SELECT device, event_id, fetched FROM t""",
}
