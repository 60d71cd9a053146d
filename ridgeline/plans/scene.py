"""Scene queries: geodesy, staircases, profiles, visibility, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import geodesy as g
from ridgeline.functions.geodesy import num
from ridgeline.operators import visibility as v
from ridgeline.plans import sqltext as s
from ridgeline.sources import views

SWEPT = [float(b) for b in range(0, 360, views.BEARING_STEP_DEG)]


def r(x: Column | str, digits: int = 4) -> Column:
    """Rounded, without negative zero: two engines' last bits differ."""
    return F.round(x, digits) + num(0)


def geo_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, bearing, destination, altitude and dip of every observer and every summit of known height within the radius."""
    o, p = views.observers(spark, sf_dir), views.summits(spark, sf_dir).where("elevationM is not null")
    near = v.within_radius(o, p, views.RADIUS_KM).select(F.col("observer_id").alias("_o"), F.col("id").alias("_p")).alias("near")
    o, p = o.alias("o"), p.alias("p")
    return _scalars(near.join(o, F.expr("_o = o.observer_id")).join(p, F.expr("_p = p.id")))


def _scalars(pair: DataFrame) -> DataFrame:
    """Distance and so on of pairs of an observer o and a summit p."""
    ola, olo, pla, plo = (F.col(x) for x in ("o.lat", "o.lon", "p.lat", "p.lon"))
    d, b = g.haversine_m(ola, olo, pla, plo), g.initial_bearing_deg(ola, olo, pla, plo)
    dla, dlo = g.destination(ola, olo, b * num(0.9), d)
    eye, top = F.col("o.eyeElevationM"), F.col("p.elevationM")
    return pair.select(
        "p.id", "o.observer_id", r(d, 3).alias("distanceM"), r(b).alias("bearingDeg"), r(dla, 6).alias("destLat"), r(dlo, 6).alias("destLon"),
        r(g.angular_difference_deg(b, num(10))).alias("turnDeg"), r(g.normalise_longitude_deg(plo * num(53.7123457))).alias("foldedLon"), r(g.curvature_drop_m(d), 3).alias("dropM"),
        r(g.altitude_angle_deg(eye, top, d)).alias("altitudeDeg"), r(g.exact_altitude_deg(eye, top, d)).alias("exactAltitudeDeg"),
        r(g.flat_horizon_distance_m(eye), 2).alias("horizonM"), r(g.flat_horizon_dip_deg(eye)).alias("dipDeg"),
    )


def horizon_staircase(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = v.staircase(views.rays(spark, sf_dir))
    return steps.select("observer_id", "bearingDeg", "distanceM", r("elevationM", 3).alias("elevationM"), r("altitudeDeg").alias("altitudeDeg"))


def horizon_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.horizon_profile(views.rays(spark, sf_dir))
    return p.select("observer_id", "bearingDeg", r("altitudeDeg").alias("altitudeDeg"), "distanceKm", r("elevationM", 3).alias("elevationM"), F.size("steps").cast("long").alias("steps"))


def peaks_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = v.within_radius(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.RADIUS_KM)
    return near.select("observer_id", "id", r("distanceM", 3).alias("distanceM"), r("bearingDeg").alias("bearingDeg"), F.row_number().over(Window.partitionBy("observer_id").orderBy("distanceM", "id")).cast("long").alias("nth"))


def visible_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every known summit within the radius of every observer."""
    seen = v.against_horizon(v.sightings(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.RADIUS_KM), views.rays(spark, sf_dir))
    return seen.select("observer_id", "id", r("distanceKm").alias("distanceKm"), r("altitudeDeg").alias("altitudeDeg"), r("occludingAltitudeDeg").alias("occludingAltitudeDeg"), r("clearanceDeg").alias("clearanceDeg"), r("occluderDistanceKm").alias("occluderDistanceKm"), (F.col("clearanceDeg") >= 0).alias("visible"))


def annotated_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses, verdicts, uncertainty and occlusion classes."""
    a = v.annotate(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.rays(spark, sf_dir), SWEPT, views.RADIUS_KM, views.RANGE_STEP_M)
    return a.select("observer_id", "id", "status", r("clearanceDeg").alias("clearanceDeg"), r("clearanceBandDeg").alias("clearanceBandDeg"), "visibility", "evidence", "crestDistanceKm", r("colDepthM", 3).alias("colDepthM"))


def scene_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many summits of each observer have each status and verdict."""
    a = v.annotate(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.rays(spark, sf_dir), SWEPT, views.RADIUS_KM, views.RANGE_STEP_M)
    return a.groupBy("observer_id", "status", F.coalesce("visibility", F.lit("-")).alias("visibility")).agg(F.count("*").alias("n"))


def horizon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.horizon_coverage(views.rays(spark, sf_dir), SWEPT)


def sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings and samples asked for and measured, for each observer."""
    measured = views.rays(spark, sf_dir).groupBy("observer_id").agg(F.countDistinct("bearingDeg").alias("bearings"), F.count("*").alias("samples"))
    per_ray = views.MAX_RANGE_M // views.RANGE_STEP_M
    return measured.select("observer_id", F.lit(len(SWEPT)).cast("long").alias("bearingsRequested"), F.col("bearings").alias("bearingsMeasured"), F.lit(len(SWEPT) * per_ray).cast("long").alias("samplesRequested"), F.col("samples").alias("samplesMeasured"))


def near_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = v.near_field(views.rays(spark, sf_dir), 2000.0)
    return n.select("observer_id", "bearings", "near", r("maxAltitudeDeg").alias("maxAltitudeDeg"), r("fraction", 6).alias("fraction"))


def profile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.profile_coverage(views.rays(spark, sf_dir).where("bearingDeg < 200 or bearingDeg > 240").select("observer_id", "bearingDeg").distinct())


NEAR = "p.distanceKm * (1e0 - 1e-9)"
BRACKET = f"""g_km AS (SELECT *, distanceM / 1000e0 AS distanceKm FROM g_seen),
g_prof AS (SELECT DISTINCT observer_id, bearingDeg FROM g_step),
g_br AS (
  SELECT k.observer_id, k.id, any_value(k.elevationM) AS elevationM, any_value(k.eyeElevationM) AS eyeElevationM, any_value(k.distanceM) AS distanceM,
         any_value(k.bearingDeg) AS t, any_value(k.altitudeDeg) AS altitudeDeg, any_value(k.distanceKm) AS distanceKm,
         max(CASE WHEN p.bearingDeg <= k.bearingDeg THEN p.bearingDeg END) AS in0, min(CASE WHEN p.bearingDeg > k.bearingDeg THEN p.bearingDeg END) AS in1,
         max(p.bearingDeg) AS hi, min(p.bearingDeg) AS lo, arg_min(p.bearingDeg, {{'sep': abs({s.angdiff('p.bearingDeg', 'k.bearingDeg')}), 'b': p.bearingDeg}}) AS nearest
  FROM g_km k JOIN g_prof p ON p.observer_id = k.observer_id GROUP BY k.observer_id, k.id),
g_w AS (
  SELECT *, coalesce(in0, hi) AS bef, coalesce(in1, lo) AS aft, coalesce(in0, hi - 360e0) AS bu, coalesce(in1, lo + 360e0) AS au,
         CASE WHEN coalesce(in1, lo + 360e0) > coalesce(in0, hi - 360e0) THEN (t - coalesce(in0, hi - 360e0)) / (coalesce(in1, lo + 360e0) - coalesce(in0, hi - 360e0)) ELSE 0e0 END AS weight FROM g_br),
g_b AS (SELECT p.observer_id, p.id, max(st.alt) AS alt, -max(struct_pack(a := st.alt, d := -st.distanceM)).d / 1000e0 AS km
  FROM g_w p JOIN g_step st ON st.observer_id = p.observer_id AND st.bearingDeg = p.bef AND st.distanceM / 1000e0 < {NEAR} GROUP BY p.observer_id, p.id),
g_a AS (SELECT p.observer_id, p.id, max(st.alt) AS alt, -max(struct_pack(a := st.alt, d := -st.distanceM)).d / 1000e0 AS km
  FROM g_w p JOIN g_step st ON st.observer_id = p.observer_id AND st.bearingDeg = p.aft AND st.distanceM / 1000e0 < {NEAR} GROUP BY p.observer_id, p.id),
g_verdict AS (
  SELECT w.*, coalesce(CASE WHEN b.alt IS NULL THEN a.alt WHEN a.alt IS NULL THEN b.alt ELSE b.alt + weight * (a.alt - b.alt) END, -90e0) AS occ,
         CASE WHEN b.km IS NULL THEN a.km WHEN a.km IS NULL THEN b.km ELSE least(a.km, b.km) END AS occKm
  FROM g_w w LEFT JOIN g_b b ON b.observer_id = w.observer_id AND b.id = w.id LEFT JOIN g_a a ON a.observer_id = w.observer_id AND a.id = w.id)"""

BASE = f"WITH {s.OBSERVER}, {s.SUMMIT}, {s.RAY}, {s.STAIRS}, {s.SIGHTING}, {BRACKET}"

SCENE = f"""{BASE},
g_gap AS (
  SELECT p.observer_id, p.id, max(gap) AS gap FROM (
    SELECT w.observer_id, w.id, d - coalesce(lag(d) OVER (PARTITION BY w.observer_id, w.id ORDER BY d), 0e0) AS gap
    FROM (SELECT w.observer_id, w.id, w.distanceM AS d FROM g_w w
          UNION ALL SELECT w.observer_id, w.id, a.distanceM FROM g_w w JOIN g_alt a ON a.observer_id = w.observer_id AND a.bearingDeg = w.nearest AND a.distanceM < w.distanceM) w) p
  GROUP BY p.observer_id, p.id),
g_un AS (SELECT o.observer_id, u.u FROM g_observer o, (SELECT CAST(unnest(range(0, 360, 5)) AS DOUBLE) AS u) u
  WHERE NOT EXISTS (SELECT 1 FROM g_prof p WHERE p.observer_id = o.observer_id AND p.bearingDeg = u.u)),
g_status AS (
  SELECT v.*, CASE WHEN v.distanceKm < 0.2e0 THEN 'too-near'
    WHEN weight <> 0 AND EXISTS (SELECT 1 FROM g_un u WHERE u.observer_id = v.observer_id AND ((u.u > v.bu AND u.u < v.au) OR (u.u - 360e0 > v.bu AND u.u - 360e0 < v.au) OR (u.u + 360e0 > v.bu AND u.u + 360e0 < v.au))) THEN 'unmeasured-bearing'
    WHEN NOT (gp.gap <= 750e0) THEN 'unmeasured-range' ELSE 'judged' END AS status
  FROM g_verdict v JOIN g_gap gp ON gp.observer_id = v.observer_id AND gp.id = v.id),
g_relief AS (
  SELECT v.observer_id, v.id, greatest(max(ry.elevationM), any_value(o.groundElevationM)) - least(min(ry.elevationM), any_value(o.groundElevationM)) AS relief
  FROM g_status v JOIN g_observer o ON o.observer_id = v.observer_id
  JOIN g_ray ry ON ry.observer_id = v.observer_id AND ry.distanceM <= 2000e0 AND abs({s.angdiff('v.t', 'ry.bearingDeg')}) <= 15e0 GROUP BY v.observer_id, v.id),
g_band AS (
  SELECT v.*, altitudeDeg - occ AS clearance, CASE WHEN rl.relief > 0 AND occKm > 0 AND occKm * 1000e0 < 2000e0 THEN degrees(atan(rl.relief / 2e0 / (occKm * 1000e0))) ELSE 0e0 END AS band
  FROM g_status v LEFT JOIN g_relief rl ON rl.observer_id = v.observer_id AND rl.id = v.id),
g_crest AS (
  SELECT v.observer_id, v.id, max(struct_pack(alt := a.alt, near := -a.distanceM, el := a.elevationM)) AS c
  FROM g_band v JOIN g_alt a ON a.observer_id = v.observer_id AND a.bearingDeg = v.nearest AND a.distanceM < v.distanceM * (1e0 - 1e-9) GROUP BY v.observer_id, v.id),
g_beyond AS (
  SELECT v.observer_id, v.id, min(el) AS low, max(d - pd) AS gap FROM (
    SELECT v.observer_id, v.id, d, el, lag(d) OVER (PARTITION BY v.observer_id, v.id ORDER BY d) AS pd FROM (
      SELECT v.observer_id, v.id, a.distanceM AS d, CASE WHEN a.distanceM > -c.c.near THEN a.elevationM END AS el FROM g_band v JOIN g_crest c ON c.observer_id = v.observer_id AND c.id = v.id
        JOIN g_alt a ON a.observer_id = v.observer_id AND a.bearingDeg = v.nearest AND a.distanceM >= -c.c.near AND a.distanceM < v.distanceM * (1e0 - 1e-9)
      UNION ALL SELECT v.observer_id, v.id, v.distanceM, NULL FROM g_band v) v) v GROUP BY v.observer_id, v.id),
g_class AS (
  SELECT v.*, c.c, CASE WHEN c.c IS NULL OR NOT (c.c.alt > altitudeDeg) THEN 'occluder-not-on-this-ray' WHEN NOT (y.gap <= 750e0) THEN 'unsampled-gap-between-occluder-and-summit'
    WHEN coalesce(greatest(0e0, c.c.el - y.low), 0e0) > 0 THEN 'col-between-occluder-and-summit' ELSE 'unbroken-rise-to-summit' END AS ev,
    coalesce(greatest(0e0, c.c.el - y.low), 0e0) AS depth
  FROM g_band v LEFT JOIN g_crest c ON c.observer_id = v.observer_id AND c.id = v.id LEFT JOIN g_beyond y ON y.observer_id = v.observer_id AND y.id = v.id),
g_final AS (
  SELECT *, CASE WHEN status <> 'judged' THEN NULL WHEN (clearance + band >= 0) <> (clearance - band >= 0) THEN 'marginal' WHEN clearance >= 0 THEN 'visible' WHEN ev = 'unbroken-rise-to-summit' THEN 'self-occluded' ELSE 'foreground-occluded' END AS visibility FROM g_class)"""

HID = "visibility IN ('self-occluded', 'foreground-occluded')"

QUERIES = {f.__name__: f for f in (geo_scalars, horizon_staircase, horizon_profile, peaks_within_radius, visible_peaks, annotated_scene, scene_report, horizon_coverage, sweep_report, near_field, profile_coverage)}

ORACLES = {
    "geo_scalars": f"""WITH {s.OBSERVER}, {s.SUMMIT}, pair AS (
  SELECT p.*, o.observer_id, o.lat AS ola, o.lon AS olo, o.eyeElevationM, {s.haversine('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS d, {s.bearing('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS b
  FROM g_summit p JOIN g_observer o ON CAST(substring(p.id, 2) AS BIGINT) % 25 = o.observer_id WHERE p.elevationM IS NOT NULL)
SELECT id, observer_id, round(d, 3) + 0e0 AS distanceM, round(b, 4) + 0e0 AS bearingDeg, round({s.dest_lat('ola', '(b * 0.9e0)', 'd')}, 6) + 0e0 AS destLat, round({s.dest_lon('ola', 'olo', '(b * 0.9e0)', 'd')}, 6) + 0e0 AS destLon,
  round({s.angdiff('b', '10e0')}, 4) + 0e0 AS turnDeg, round({s.norm_lon('lon * 53.7123457e0')}, 4) + 0e0 AS foldedLon, round({s.drop('d')}, 3) + 0e0 AS dropM, round({s.altitude('eyeElevationM', 'elevationM', 'd')}, 4) + 0e0 AS altitudeDeg,
  round(degrees(atan2(({s.R_EFF} + elevationM) * cos(d / {s.R_EFF}) - ({s.R_EFF} + eyeElevationM), ({s.R_EFF} + elevationM) * sin(d / {s.R_EFF}))), 4) + 0e0 AS exactAltitudeDeg,
  round(sqrt(2e0 * {s.R_EFF} * eyeElevationM), 2) + 0e0 AS horizonM, round(degrees(atan(-sqrt(2e0 * eyeElevationM / {s.R_EFF}))), 4) + 0e0 AS dipDeg FROM pair""",
    "horizon_staircase": f"WITH {s.OBSERVER}, {s.RAY}, {s.STAIRS} SELECT observer_id, bearingDeg, distanceM, round(elevationM, 3) + 0e0 AS elevationM, round(alt, 4) + 0e0 AS altitudeDeg FROM g_step",
    "horizon_profile": f"""WITH {s.OBSERVER}, {s.RAY}, {s.STAIRS} SELECT observer_id, bearingDeg, round(max(alt), 4) + 0e0 AS altitudeDeg, max(distanceM) / 1000e0 AS distanceKm, round(arg_max(elevationM, distanceM), 3) + 0e0 AS elevationM, count(*) AS steps
FROM g_step GROUP BY observer_id, bearingDeg""",
    "peaks_within_radius": f"""WITH {s.OBSERVER}, {s.SUMMIT}, near AS (
  SELECT o.observer_id, p.id, {s.haversine('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS d, {s.bearing('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS b FROM g_observer o, g_summit p)
SELECT observer_id, id, round(d, 3) + 0e0 AS distanceM, round(b, 4) + 0e0 AS bearingDeg, row_number() OVER (PARTITION BY observer_id ORDER BY d, id) AS nth FROM near WHERE d <= 30000e0""",
    "visible_peaks": f"""{BASE} SELECT observer_id, id, round(distanceKm, 4) + 0e0 AS distanceKm, round(altitudeDeg, 4) + 0e0 AS altitudeDeg, round(occ, 4) + 0e0 AS occludingAltitudeDeg, round(altitudeDeg - occ, 4) + 0e0 AS clearanceDeg,
  round(occKm, 4) + 0e0 AS occluderDistanceKm, altitudeDeg - occ >= 0 AS visible FROM g_verdict""",
    "annotated_scene": f"""{SCENE} SELECT observer_id, id, status, CASE WHEN status = 'judged' THEN round(clearance, 4) + 0e0 END AS clearanceDeg, CASE WHEN status = 'judged' THEN round(band, 4) + 0e0 END AS clearanceBandDeg, visibility,
  CASE WHEN {HID} THEN ev END AS evidence, CASE WHEN {HID} AND ev <> 'occluder-not-on-this-ray' THEN -c.near / 1000e0 END AS crestDistanceKm,
  CASE WHEN {HID} AND ev IN ('col-between-occluder-and-summit', 'unbroken-rise-to-summit') THEN round(depth, 3) + 0e0 END AS colDepthM FROM g_final""",
    "scene_report": f"{SCENE} SELECT observer_id, status, coalesce(visibility, '-') AS visibility, count(*) AS n FROM g_final GROUP BY ALL",
    "horizon_coverage": f"""WITH {s.OBSERVER}, {s.RAY} SELECT o.observer_id, u.u AS bearingDeg FROM g_observer o, (SELECT CAST(unnest(range(0, 360, 5)) AS DOUBLE) AS u) u
WHERE NOT EXISTS (SELECT 1 FROM g_ray p WHERE p.observer_id = o.observer_id AND p.bearingDeg = u.u)""",
    "sweep_report": f"""WITH {s.OBSERVER}, {s.RAY} SELECT observer_id, CAST(72 AS BIGINT) AS bearingsRequested, count(DISTINCT bearingDeg) AS bearingsMeasured, CAST(4320 AS BIGINT) AS samplesRequested, count(*) AS samplesMeasured FROM g_ray GROUP BY observer_id""",
    "near_field": f"""WITH {s.OBSERVER}, {s.RAY}, {s.STAIRS}, prof AS (SELECT observer_id, bearingDeg, max(alt) AS alt, max(distanceM) AS d FROM g_step GROUP BY 1, 2)
SELECT observer_id, count(*) AS bearings, count(*) FILTER (d < 2000) AS near, round(coalesce(max(alt) FILTER (d < 2000), 0e0), 4) + 0e0 AS maxAltitudeDeg, round(CAST(count(*) FILTER (d < 2000) AS DOUBLE) / count(*), 6) + 0e0 AS fraction FROM prof GROUP BY observer_id""",
    "profile_coverage": f"""WITH {s.OBSERVER}, {s.RAY}, b AS (SELECT DISTINCT observer_id, bearingDeg FROM g_ray WHERE bearingDeg < 200 OR bearingDeg > 240),
gaps AS (SELECT observer_id, bearingDeg, coalesce(lead(bearingDeg) OVER (PARTITION BY observer_id ORDER BY bearingDeg), min(bearingDeg) OVER (PARTITION BY observer_id) + 360e0) - bearingDeg AS gap FROM b),
f AS (SELECT observer_id, max(gap) AS gap, arg_max(bearingDeg, struct_pack(g := gap, b := -bearingDeg)) AS start, list_sort(list(gap))[count(*) // 2 + 1] AS med FROM gaps GROUP BY observer_id)
SELECT observer_id, CASE WHEN gap > 4e0 * med THEN start END AS gapFromDeg, CASE WHEN gap > 4e0 * med THEN (start + gap) % 360e0 END AS gapToDeg, CASE WHEN gap > 4e0 * med THEN 360e0 - gap ELSE 360e0 END AS coveredSpanDeg FROM f""",
}
#: All pairs within the radius.
ORACLES["geo_scalars"] = ORACLES["geo_scalars"].replace("ON CAST(substring(p.id, 2) AS BIGINT) % 25 = o.observer_id", "ON true") + " WHERE d <= 30000e0"
