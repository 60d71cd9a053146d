"""The same views and formulas as SQL text for the independent engine."""

from __future__ import annotations

R = "6371008.8e0"
R_EFF = f"({R} / 0.87e0)"


def rad(x: str) -> str:
    return f"radians({x})"


def fold(x: str, turn: str = "360e0") -> str:
    return f"(((({x}) % {turn}) + {turn}) % {turn})"


def norm_lon(x: str) -> str:
    return f"(CASE WHEN {fold(f'({x}) - 180e0')} = 0 THEN 180e0 ELSE {fold(f'({x}) - 180e0')} - 180e0 END)"


def angdiff(a: str, b: str) -> str:
    return f"(CASE WHEN {fold(f'({b}) - ({a})')} > 180 THEN {fold(f'({b}) - ({a})')} - 360e0 ELSE {fold(f'({b}) - ({a})')} END)"


def haversine(la1: str, lo1: str, la2: str, lo2: str) -> str:
    a = f"greatest(0e0, least(1e0, pow(sin(radians({la2} - {la1}) / 2e0), 2) + cos(radians({la1})) * cos(radians({la2})) * pow(sin(radians({lo2} - {lo1}) / 2e0), 2)))"
    return f"(2e0 * {R} * atan2(sqrt({a}), sqrt(1e0 - {a})))"


def bearing(la1: str, lo1: str, la2: str, lo2: str) -> str:
    dl = f"radians({lo2} - {lo1})"
    return fold(f"degrees(atan2(sin({dl}) * cos(radians({la2})), cos(radians({la1})) * sin(radians({la2})) - sin(radians({la1})) * cos(radians({la2})) * cos({dl})))")


def dest_lat(la: str, b: str, d: str) -> str:
    return f"degrees(asin(greatest(-1e0, least(1e0, sin(radians({la})) * cos({d} / {R}) + cos(radians({la})) * sin({d} / {R}) * cos(radians({b}))))))"


def dest_lon(la: str, lo: str, b: str, d: str) -> str:
    s = f"sin({rad(dest_lat(la, b, d))})"
    return norm_lon(f"{lo} + degrees(atan2(sin(radians({b})) * sin({d} / {R}) * cos(radians({la})), cos({d} / {R}) - sin(radians({la})) * {s}))")


def drop(d: str) -> str:
    return f"({d} * {d} / (2e0 * {R_EFF}))"


def altitude(eye: str, target: str, d: str) -> str:
    return f"degrees(atan2({target} - {eye} - {drop(d)}, {d}))"


def terrain(la: str, lo: str) -> str:
    return f"(1500e0 + 900e0 * sin({la} * 37.1e0) * cos({lo} * 29.3e0) + 350e0 * sin({la} * 151.7e0 + {lo} * 97.3e0) + 120e0 * cos({lo} * 411.7e0 - {la} * 233.1e0))"


def cell(la: str, lo: str) -> str:
    south = f"CAST(least(89e0, floor({la})) AS INTEGER)"
    west = f"CAST(floor({fold(f'{lo} + 180e0')} - 180e0) AS INTEGER)"
    return f"concat(CASE WHEN {south} >= 0 THEN 'N' ELSE 'S' END, lpad(CAST(abs({south}) AS VARCHAR), 2, '0'), CASE WHEN {west} >= 0 THEN 'E' ELSE 'W' END, lpad(CAST(abs({west}) AS VARCHAR), 3, '0'))"


OBSERVER = f"""g_observer AS (
  SELECT *, {terrain('lat', 'lon')} AS groundElevationM, {terrain('lat', 'lon')} + 1.6e0 AS eyeElevationM
  FROM (SELECT n_nationkey AS observer_id, 45.2e0 + n_nationkey * 0.061e0 AS lat, 7.1e0 + ((n_nationkey * 7) % 25) * 0.063e0 AS lon FROM nation))"""

SUMMIT = f"""g_summit AS (
  SELECT id, name, lat, lon, CASE WHEN size % 10 <> 0 THEN {terrain('lat', 'lon')} + size * 6e0 END AS elevationM
  FROM (SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS id, p_name AS name, 45e0 + ((p_partkey * 7919) % 20000) / 10000e0 AS lat,
               6.9e0 + ((p_partkey * 10473) % 20000) / 10000e0 AS lon, p_size AS size FROM part))"""

RAY = f"""g_swept AS (
  SELECT observer_id, lat, lon, eyeElevationM, CAST(b AS DOUBLE) AS bearingDeg, CAST(d AS DOUBLE) AS distanceM
  FROM g_observer, (SELECT unnest(range(0, 360, 5)) AS b) bs, (SELECT unnest(range(500, 30001, 500)) AS d) ds
  WHERE b NOT IN (35, 130) AND (b * 7 + (d // 500) * 13 + observer_id) % 17 <> 0),
g_ray AS (
  SELECT observer_id, eyeElevationM, bearingDeg, distanceM, {terrain('tlat', 'tlon')} AS elevationM
  FROM (SELECT *, {dest_lat('lat', 'bearingDeg', 'distanceM')} AS tlat, {dest_lon('lat', 'lon', 'bearingDeg', 'distanceM')} AS tlon FROM g_swept))"""

STAIRS = f"""g_alt AS (SELECT *, {altitude('eyeElevationM', 'elevationM', 'distanceM')} AS alt FROM g_ray),
g_step AS (
  SELECT * FROM (
    SELECT *, max(alt) OVER (PARTITION BY observer_id, bearingDeg ORDER BY distanceM ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g_alt)
  WHERE prev IS NULL OR alt > prev)"""

SIGHTING = f"""g_sighting AS (
  SELECT o.observer_id, p.id, p.elevationM, o.eyeElevationM,
         {haversine('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS distanceM, {bearing('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS bearingDeg
  FROM g_observer o, g_summit p
  WHERE p.elevationM IS NOT NULL AND {haversine('o.lat', 'o.lon', 'p.lat', 'p.lon')} <= 30000e0),
g_seen AS (SELECT *, {altitude('eyeElevationM', 'elevationM', 'distanceM')} AS altitudeDeg FROM g_sighting)"""

HEADING = """g_heading AS (
  SELECT user_id AS device, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms,
         CASE WHEN event_id % 9 <> 0 THEN (value * 7.3e0) % 360e0 END AS magneticDeg,
         CASE WHEN event_id % 3 = 0 THEN (value * 7.3e0 + 2.5e0) % 360e0 END AS trueDeg,
         CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 40 - 3 AS DOUBLE) END AS accuracyDeg, event_id
  FROM events)"""

GRAVITY = """g_gravity AS (
  SELECT user_id AS device, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, event_id,
         s * cos(a) * sin(b) AS x, -s * cos(a) * cos(b) AS y, s * sin(a) AS z
  FROM (SELECT *, CASE WHEN event_id % 29 = 0 THEN 2e0 ELSE 1e0 END AS s, radians(value % 180e0 - 90e0) AS a, radians((value * 3.7e0) % 360e0) AS b FROM events))"""
