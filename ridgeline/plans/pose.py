"""Pose queries: all nine fields of every photograph from its layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import pose as po
from ridgeline.plans import sqltext as s
from ridgeline.plans.scene import r
from ridgeline.sources import views

K = "p_partkey"
#: Each layer's fields as expressions that both engines read; cases of every kind by the part's key.
USER = {
    "lat": f"CASE WHEN {K} % 9 = 0 THEN 475e0 WHEN {K} % 9 = 1 THEN 46.5e0 END", "headingDeg": f"CASE WHEN {K} % 6 = 0 THEN ({K} % 900) - 90e0 END",
    "eyeHeightM": f"CASE WHEN {K} % 7 = 0 THEN -1e0 WHEN {K} % 7 = 1 THEN 2e0 END", "hFovDeg": f"CASE WHEN {K} % 10 = 0 THEN 200e0 WHEN {K} % 10 = 1 THEN 60e0 END",
    "vFovDeg": f"CASE WHEN {K} % 23 = 4 THEN 41e0 END", "imageWidthPx": f"CASE WHEN {K} % 13 = 0 THEN 3000e0 END", "imageHeightPx": f"CASE WHEN {K} % 13 = 0 THEN 2000e0 END",
    "groundElevationM": f"CASE WHEN {K} % 29 = 7 THEN -430e0 END", "pitchDeg": f"CASE WHEN {K} % 15 = 2 THEN 12e0 END",
}
EXIF = {
    "lat": f"CASE WHEN {K} % 25 = 3 THEN 95e0 WHEN {K} % 5 <> 0 THEN 45e0 + ({K} % 100) / 100e0 END", "lon": f"CASE WHEN {K} % 5 <> 0 THEN 7e0 + ({K} % 90) / 90e0 END",
    "gpsAltitudeM": f"CASE WHEN {K} % 8 <> 0 THEN p_size * 50e0 END", "imgDirectionDeg": f"CASE WHEN {K} % 4 <> 3 THEN ({K} * 7) % 720 + 0e0 END",
    "imgDirectionRef": f"CASE WHEN {K} % 3 = 0 THEN 'T' WHEN {K} % 3 = 1 THEN 'M' END", "focalLength35mmMm": f"CASE WHEN {K} % 6 IN (1, 2) THEN 28e0 END",
    "focalLengthMm": f"CASE WHEN {K} % 6 IN (1, 3) THEN 4.2e0 END", "hFovDeg": f"CASE WHEN {K} % 6 = 4 THEN 65.5e0 WHEN {K} % 6 = 5 THEN 181e0 END",
    "imageWidthPx": f"CASE WHEN {K} % 2 = 0 THEN 4000e0 END", "imageHeightPx": f"CASE WHEN {K} % 2 = 0 THEN CASE WHEN {K} % 34 = 6 THEN 0e0 ELSE 3000e0 END END",
    "unreadable": f"CASE WHEN {K} % 17 = 5 THEN 'heif' END",
}
DEFAULTS = {
    "eyeHeightM": f"CASE WHEN {K} % 11 <> 2 THEN 1.6e0 END", "pitchDeg": f"CASE WHEN {K} % 11 <> 3 THEN 0e0 END", "rollDeg": "0e0", "hFovDeg": f"CASE WHEN {K} % 12 = 5 THEN 50e0 END",
    "lon": f"CASE WHEN {K} % 35 = 10 THEN 200e0 END",
}
DECLINATION, ASSUMED = f"CASE WHEN {K} % 2 = 0 THEN 2.5e0 END", f"CASE WHEN {K} % 19 = 0 THEN 'T' END"


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = [F.struct(*[F.expr(x).alias(n) for n, x in fields.items()]).alias(name) for name, fields in (("user", USER), ("exif", EXIF), ("defaults", DEFAULTS))]
    return views.table(spark, sf_dir, "part").select(F.col(K).alias("k"), *layers, F.expr(DECLINATION).alias("declinationDeg"), F.expr(ASSUMED).alias("assumedRef"))


def pose_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every photograph's pose: value, source, reason."""
    out = po.resolve_pose(photos(spark, sf_dir))
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"fields.{n}.value").alias("value"), F.col(f"fields.{n}.source").alias("source"), F.col(f"fields.{n}.reason").alias("reason")) for n in po.POSE_FIELDS]))
    return out.select("k", each).select("k", "field", r("value", 4).alias("value"), "source", "reason")


def pose_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing from each photograph's pose, and whether its observer and its camera are known."""
    out = po.resolve_pose(photos(spark, sf_dir))
    return out.select(
        "k", F.array_join("missing", ",").alias("missing"), "complete", F.col("observer").isNotNull().alias("observer"), F.col("cameraPose").isNotNull().alias("camera"),
        r("cameraPose.vFovDeg", 4).alias("vFovDeg"), "gpsAltitudeM", "imageWidthPx", "imageHeightPx",
    )


QUERIES = {f.__name__: f for f in (pose_fields, pose_results)}


def _of(layer: dict[str, str], name: str) -> str:
    return f"({layer[name]})" if name in layer else "CAST(NULL AS DOUBLE)"


def _inside(x: str, test: str | None) -> tuple[str, str]:
    """A layer's value and block, by a test that says what is possible."""
    return (x, "CAST(NULL AS VARCHAR)") if test is None else (f"CASE WHEN {test.format(x=x)} THEN {x} END", f"CASE WHEN NOT ({test.format(x=x)}) THEN 'out-of-range' END")


_LENS = "{x} > 0 AND {x} < 180"
_TESTS = {"lat": "{x} BETWEEN -90 AND 90", "lon": "{x} BETWEEN -180 AND 180", "eyeHeightM": "{x} >= 0", "hFovDeg": _LENS, "vFovDeg": _LENS}


def _merge(name: str, exif: str, blocked: str) -> str:
    """Columns name_v, name_s and name_r."""
    (u, ub), (d, db), test = _inside(_of(USER, name), _TESTS.get(name)), _inside(_of(DEFAULTS, name), _TESTS.get(name)), _TESTS.get(name)
    e, eb = _inside(f"({exif})", test)
    eb = f"coalesce({blocked}, {eb})"
    stop = f"({u}) IS NULL AND ({ub}) IS NOT NULL"
    return f"""CASE WHEN NOT ({stop}) THEN coalesce({u}, {e}, {d}) END AS {name}_v,
  CASE WHEN {stop} THEN NULL WHEN ({u}) IS NOT NULL THEN 'user' WHEN ({e}) IS NOT NULL THEN 'exif' WHEN ({d}) IS NOT NULL THEN 'default' END AS {name}_s,
  CASE WHEN {stop} THEN {ub} WHEN coalesce({u}, {e}, {d}) IS NULL THEN coalesce({eb}, {db}, '{po.ABSENT}') END AS {name}_r"""


_NO, _NULL = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
_DIR, _REF = EXIF["imgDirectionDeg"], f"coalesce({EXIF['imgDirectionRef']}, {ASSUMED})"
_BLOCKED = f"CASE WHEN ({_DIR}) IS NULL THEN '{po.ABSENT}' WHEN ({_REF}) IS NULL THEN 'direction-reference-unknown' WHEN {_REF} <> 'T' AND ({DECLINATION}) IS NULL THEN 'magnetic-declination-required' END"
_HEAD = f"CASE WHEN {_BLOCKED} IS NULL THEN {s.fold(f'({_DIR}) + CASE WHEN {_REF} = {chr(39)}T{chr(39)} THEN 0e0 ELSE ({DECLINATION}) END')} END"
_WHY = f"CASE WHEN ({EXIF['hFovDeg']}) IS NULL THEN CASE WHEN ({EXIF['focalLength35mmMm']}) IS NOT NULL THEN 'image-dimensions-unknown' WHEN ({EXIF['focalLengthMm']}) IS NOT NULL THEN 'no-35mm-equivalent-focal-length' ELSE '{po.ABSENT}' END END"
_SIZE = [f"coalesce({_of(USER, n)}, {_of(EXIF, n)}, {_of(DEFAULTS, n)})" for n in po.SIZES]
_KNOWN = f"coalesce({_SIZE[0]} > 0 AND {_SIZE[1]} > 0, false)"
POSED = f"""a AS (SELECT *, {_merge('eyeHeightM', _NULL, _NO)}, {_merge('hFovDeg', EXIF['hFovDeg'], _WHY)} FROM part),
b AS (SELECT *, {_merge('lat', EXIF['lat'], _NO)}, {_merge('lon', EXIF['lon'], _NO)},
  {_merge('groundElevationM', f"({EXIF['gpsAltitudeM']}) - eyeHeightM_v", f"CASE WHEN ({EXIF['gpsAltitudeM']}) IS NULL THEN '{po.ABSENT}' WHEN eyeHeightM_v IS NULL THEN 'eye-height-required' END")},
  {_merge('headingDeg', _HEAD, _BLOCKED)}, {_merge('pitchDeg', _NULL, _NO)}, {_merge('rollDeg', _NULL, _NO)},
  {_merge('vFovDeg', f"CASE WHEN {_KNOWN} THEN degrees(2e0 * atan(tan(radians(hFovDeg_v) / 2e0) / ({_SIZE[0]} / {_SIZE[1]}))) END", f"CASE WHEN hFovDeg_v IS NULL THEN hFovDeg_r WHEN NOT {_KNOWN} THEN 'image-dimensions-unknown' END")} FROM a),
f AS ({" UNION ALL ".join(f"SELECT {K} AS k, {i} AS nth, '{n}' AS field, {s.fold(f'{n}_v') if n == 'headingDeg' else f'{n}_v'} AS value, {'CASE WHEN vFovDeg_s = $$exif$$ THEN hFovDeg_s ELSE vFovDeg_s END' if n == 'vFovDeg' else f'{n}_s'} AS source, CASE WHEN {n}_r = '{po.ABSENT}' AND ({EXIF['unreadable']}) IS NOT NULL THEN '{po.UNREADABLE}' ELSE {n}_r END AS reason FROM b" for i, n in enumerate(po.POSE_FIELDS))})"""
ORACLES = {
    "pose_fields": f"WITH {POSED} SELECT k, field, round(value, 4) + 0e0 AS value, source, reason FROM f",
    "pose_results": f"""WITH {POSED}, g AS (SELECT k, coalesce(string_agg(field, ',' ORDER BY nth) FILTER (source IS NULL), '') AS missing, count(*) FILTER (source IS NULL AND nth < 4) = 0 AS observer, count(*) FILTER (source IS NULL AND nth >= 4) = 0 AS camera,
  max(round(value, 4)) FILTER (field = 'vFovDeg') AS v FROM f GROUP BY k)
SELECT k, missing, missing = '' AS complete, observer, camera, CASE WHEN camera THEN v END AS vFovDeg, {EXIF['gpsAltitudeM']} AS gpsAltitudeM, {_SIZE[0]} AS imageWidthPx, {_SIZE[1]} AS imageHeightPx FROM g JOIN part ON {K} = k""",
}
