"""Photograph queries: skylines read off pictures, and what they say about the camera's pose."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import camera as c
from ridgeline.functions.geodesy import fold, num
from ridgeline.operators import alignment as al
from ridgeline.operators import skyline as sk
from ridgeline.plans import sqltext as s
from ridgeline.plans.scene import r
from ridgeline.shipping import ship
from ridgeline.sources import views
from ridgeline.tables import spread

COLS, ROWS, HFOV = 64, 48, 65.0
#: Photographs of one task, about.
IMAGES = 500
#: Photographs that are exposed at once.
AT_ONCE = 16
#: Bell curves of a skyline: offset from its centre, width and height in degrees.
BELLS = ((-14.0, 5.0, 3.2), (6.0, 3.0, 2.1), (21.0, 7.0, 4.0))
BASE, PITCH = 2.0, 2.0
OFFSETS = al.steps(25.0, 0.2)


def altitude(off: Column, amplitude: Column) -> Column:
    """Altitude of the terrain at an offset from a skyline's centre."""
    bells = [num(height) * F.exp(num(-0.5) * ((off - num(at)) / num(width)) * ((off - num(at)) / num(width))) for at, width, height in BELLS]
    return num(BASE) + amplitude * sum(bells[1:], bells[0])


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, what its camera says (headingDeg, pitchDeg), how it was held, and the terrain's amplitude: one for each supplier."""
    k = F.col("s_suppkey")
    turned, tilted = ((k * 7) % 33 - num(16)) * num(0.5), ((k * 5) % 9 - num(4)) * num(0.4)
    held = F.pmod(k * num(37), num(360))
    suppliers = spread(views.table(spark, sf_dir, "supplier").select("s_suppkey"), IMAGES, "s_suppkey")
    return suppliers.select(
        k.alias("image"), fold(held - turned).alias("headingDeg"), (num(PITCH) - tilted).alias("pitchDeg"), held.alias("heldDeg"), F.when(k % 5 == 1, num(0)).otherwise(num(1)).alias("amplitude"),
        num(0).alias("rollDeg"), num(HFOV).alias("hFovDeg"), c.vfov_deg(num(HFOV), num(COLS / ROWS)).alias("vFovDeg"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, bearingDeg, altitudeDeg, distanceKm: the terrain's skyline in a sector about each photograph's direction."""
    at = cameras(spark, sf_dir).select("image", "heldDeg", "amplitude", F.explode(F.sequence(F.lit(-80), F.lit(80))).alias("d"))
    d = F.col("d").cast("double")
    near = F.when((F.col("image") % 11 == 4) & (F.col("d") == 3), num(0.1)).otherwise(num(12))
    return at.select("image", fold(F.col("heldDeg") + d).alias("bearingDeg"), altitude(d, F.col("amplitude")).alias("altitudeDeg"), near.alias("distanceKm"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cameras() with the photograph: how much each pixel looks like sky (value, column after column). One in five is fog."""
    ship(spark)
    at = cameras(spark, sf_dir)
    names = at.columns
    read = [names.index(c) for c in ("image", "amplitude", "hFovDeg", "vFovDeg")]

    def expose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        col, row = (x.ravel() for x in np.meshgrid(np.arange(COLS, dtype=np.int32), np.arange(ROWS, dtype=np.int32), indexing="ij"))
        p = math.radians(PITCH)
        for batch in batches:
            for part in (batch.slice(i, AT_ONCE) for i in range(0, batch.num_rows, AT_ONCE)):
                k, amplitude, hfov, vfov = (part.column(c).to_numpy()[:, None] for c in read)
                # bearings are told from the direction the camera is held in; its pitch is its only tilt
                a, b = ((col + 0.5) / COLS - 0.5) * 2.0 * np.tan(np.radians(hfov) / 2.0), (0.5 - (row + 0.5) / ROWS) * 2.0 * np.tan(np.radians(vfov) / 2.0)
                off = np.degrees(np.arctan2(a, math.cos(p) - b * math.sin(p)))
                up = np.degrees(np.arcsin((math.sin(p) + b * math.cos(p)) / np.sqrt(1.0 + a * a + b * b)))
                hills = sum(height * np.exp(-0.5 * ((off - at) / width) * ((off - at) / width)) for at, width, height in BELLS)
                clear = np.where(up > BASE + amplitude * hills, 0.85 - 0.0008 * row, 0.35 + 0.02 * ((col * 31 + row * 17 + k) % 7))
                value = np.where(k % 5 == 0, 0.6 + 0.0005 * ((col * 13 + row * 7) % 5), clear)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(col))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(value.ravel()))], names=[*names, "value"])

    return at.mapInArrow(expose, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in at.schema), "value array<double>"]))


def photographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, col, row, value: the pixels of exposures()."""
    at = exposures(spark, sf_dir).select("image", F.posexplode("value").alias("i", "value"))
    return at.select("image", (F.col("i") / ROWS).cast("int").alias("col"), (F.col("i") % ROWS).alias("row"), "value")


def skylines(spark: SparkSession, sf_dir: str, *beside: str) -> DataFrame:
    """The skyline read off every photograph, with the named fields of its camera beside."""
    return sk.read_pictures(exposures(spark, sf_dir).select("image", *beside, "value"), COLS, ROWS)


def skyline_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every row of every column of the photographs."""
    out = sk.step_factors(photographs(spark, sf_dir), ROWS)
    return out.select("image", "col", "row", *[r(x, 6).alias(x) for x in ("contrast", "snr", "edge01", "evidence")], r("between", 8).alias("between"))


def photo_skylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skyline read off every photograph: rows, confidence and what it is made of."""
    out = skylines(spark, sf_dir)
    return out.select("image", "col", *[r(x, 5).alias(x) for x in ("xNorm", "rowNorm", "confidence01", "contrast", "snr", "edge01", "agreement01")])


def photo_skyline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each photograph's skyline is readable."""
    out = sk.skyline_summary(skylines(spark, sf_dir))
    return out.select("image", "columns", *[r(x, 5).alias(x) for x in ("coverage01", "meanConfidence01", "reliefNorm")])


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, image, bearingDeg, altitudeDeg, weight, headingDeg of the readable columns, as each camera says it stands."""
    read = skylines(spark, sf_dir, "headingDeg", "pitchDeg", "rollDeg", "hFovDeg", "vFovDeg").withColumnRenamed("confidence01", "confidence")
    return sk.observations(read, 0.05).withColumn("key", F.col("image"))


def heading_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse level alone: what every heading offset scores for true directions of each photograph's skyline."""
    seen = directions(spark, sf_dir)
    out = al.heading_scores(seen, al.arcs(profiles(spark, sf_dir)), OFFSETS)
    return out.select(F.col("key").alias("image"), "k", "used", r("score", 6).alias("score"))


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True directions of skylines, every two degrees across the frame, turned as the cameras say they stand."""
    at = cameras(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(-32), F.lit(32), F.lit(2))).alias("d"))
    off = F.col("d") + num(0.25)
    return at.select(F.col("image").alias("key"), "image", fold(F.col("headingDeg") + off).alias("bearingDeg"), altitude(off, F.col("amplitude")).alias("altitudeDeg"), (num(0.5) + (F.col("d") + 32) % 3 * num(0.25)).alias("weight"), "headingDeg")


def heading_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak of each scan, between its candidates, and how far it stands above its best rival."""
    out = al.locked_headings(directions(spark, sf_dir), profiles(spark, sf_dir), OFFSETS, 0.2)
    return out.select(F.col("key").alias("image"), r("heading", 3).alias("headingOffsetDeg"), r("peak", 6).alias("peak"), r("margin", 5).alias("margin"), "atEdge")


def photo_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading and pitch of every photograph's camera recovered from its skyline, or the reason why not."""
    columns = cameras(spark, sf_dir).select(F.col("image").alias("key"), "image", F.lit(COLS).alias("columns"))
    out = al.align_skylines(observed(spark, sf_dir), columns, profiles(spark, sf_dir))
    return out.select("image", "status", "reason", r("headingOffsetDeg", 2).alias("headingOffsetDeg"), r("pitchOffsetDeg", 2).alias("pitchOffsetDeg"), r("confidence01", 2).alias("confidence01"), "concerns", r("usedFraction01", 4).alias("usedFraction01"))


def pose_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each photograph's skyline suggests within what a compass may be wrong by."""
    camera = cameras(spark, sf_dir).select("image", "headingDeg", "hFovDeg", F.lit(COLS).alias("columns"))
    out = al.suggested_trims(observed(spark, sf_dir), camera, profiles(spark, sf_dir))
    return out.select("image", "status", "reason", "detail", r("headingTrimDeg", 1).alias("headingTrimDeg"), r("pitchTrimDeg", 1).alias("pitchTrimDeg"))


_ALL = (skyline_factors, photo_skylines, photo_skyline_summary, heading_scan, heading_locks, photo_alignment, pose_trims)
QUERIES = {f.__name__: f for f in _ALL}


def _altitude(off: str, amplitude: str) -> str:
    return f"({BASE!r}e0 + {amplitude} * (" + " + ".join(f"{h!r}e0 * exp(-0.5e0 * pow(({off} - {a!r}e0) / {w!r}e0, 2))" for a, w, h in BELLS) + "))"


_VFOV = f"degrees(2e0 * atan(tan(radians({HFOV!r}e0) / 2e0) / {COLS / ROWS!r}e0))"
CAMERAS = f"""cam AS (SELECT s_suppkey AS image, (s_suppkey * 37e0) % 360e0 AS held, ((s_suppkey * 7) % 33 - 16e0) * 0.5e0 AS turned,
  CASE WHEN s_suppkey % 5 = 1 THEN 0e0 ELSE 1e0 END AS amp FROM supplier)"""
PHOTOS = f"""{CAMERAS}, px AS (
  SELECT image, held, amp, c.c AS col, w.r AS row, ((c.c + 0.5e0) / {COLS} - 0.5e0) * 2e0 * tan(radians({HFOV!r}e0) / 2e0) AS a, (0.5e0 - (w.r + 0.5e0) / {ROWS}) * 2e0 * tan(radians({_VFOV}) / 2e0) AS b
  FROM cam, (SELECT unnest(range(0, {COLS})) AS c) c, (SELECT unnest(range(0, {ROWS})) AS r) w),
ray AS (SELECT *, radians({PITCH!r}e0) AS p, degrees(atan2(a, cos(radians({PITCH!r}e0)) - b * sin(radians({PITCH!r}e0)))) AS off,
  degrees(asin((sin(radians({PITCH!r}e0)) + b * cos(radians({PITCH!r}e0))) / sqrt(1e0 + a * a + b * b))) AS up FROM px),
sg AS (SELECT image, col, row, CASE WHEN image % 5 = 0 THEN 0.6e0 + 0.0005e0 * ((col * 13 + row * 7) % 5) WHEN up > {_altitude('off', 'amp')} THEN 0.85e0 - 0.0008e0 * row
  ELSE 0.35e0 + 0.02e0 * ((col * 31 + row * 17 + image) % 7) END AS value FROM ray)"""
_G, _B = 2, sk.band_rows(ROWS)


def _rise(x: str, ends: tuple[float, float]) -> str:
    return f"greatest(0e0, least(1e0, ({x} - {ends[0]!r}e0) / {ends[1] - ends[0]!r}e0))"


FACTORS = f"""{PHOTOS},
bl AS (SELECT image, col, row, avg(value) OVER (PARTITION BY image, col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM sg),
df AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY image, col ORDER BY row)) AS d FROM bl),
wi AS (SELECT image, col, row, row AS n0, sum(v) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0, sum(d) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND {_G + 2} PRECEDING) AS rg,
  avg(v) OVER (k ROWS BETWEEN {_G + _B} PRECEDING AND {_G + 1} PRECEDING) AS ab, avg(v) OVER (k ROWS BETWEEN {_G} FOLLOWING AND {_G + _B - 1} FOLLOWING) AS be,
  sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM df WINDOW k AS (PARTITION BY image, col ORDER BY row), w AS (PARTITION BY image, col)),
fa AS (SELECT *, s0 / n0 - (s - s0) / ({ROWS} - n0) AS ct, CASE WHEN n0 - {_G} - 1 <= 1 THEN 0e0 ELSE coalesce(rg, 0) / (n0 - {_G} - 2) END AS mr, n0 / {ROWS}e0 AS sh FROM wi WHERE n0 > 0),
fb AS (SELECT *, 1e0 - {_rise('mr', sk.ROUGHNESS)} AS cl, sh * (1e0 - sh) * ct * ct AS bt, sqrt(greatest(0e0, q / {ROWS} - (s / {ROWS}) * (s / {ROWS}) - sh * (1e0 - sh) * ct * ct)) AS wt FROM fa),
fc AS (SELECT *, coalesce(greatest(0e0, least(1e0, (ab - be) / greatest(ct, 1e-9))), 0e0) AS ed, CASE WHEN wt > 0 THEN ct / wt END AS sn, ct > 0 AND cl > 0 AS ok FROM fb),
fx AS (SELECT image, col, row, CASE WHEN ok THEN ct ELSE 0e0 END AS contrast, CASE WHEN ok THEN coalesce(sn, {sk.SNR[1]!r}e0) ELSE 0e0 END AS snr, CASE WHEN ok THEN ed ELSE 0e0 END AS edge01,
  CASE WHEN ok THEN {_rise('ct', sk.CONTRAST)} * coalesce({_rise('sn', sk.SNR)}, 0e0) * ed * cl ELSE 0e0 END AS evidence, CASE WHEN ok THEN bt ELSE 0e0 END AS between FROM fc)"""
_LAST = ROWS - 2
#: The path by trying every row after every row, and rows as text of the path so far.
PATHS = f"""{FACTORS},
ev AS (SELECT image, col, row, evidence FROM fx WHERE row <= {_LAST}),
dp AS (SELECT image, col, row, evidence AS total, [row] AS path FROM ev WHERE col = 0
  UNION ALL SELECT e.image, e.col, e.row, max(round(p.total - greatest(0, abs(e.row - p.row) - 5), 9)) + any_value(e.evidence) AS total,
    list_append(arg_max(p.path, struct_pack(t := round(p.total - greatest(0, abs(e.row - p.row) - 5), 9), n := -p.row)), e.row) AS path
  FROM dp p JOIN ev e ON e.image = p.image AND e.col = p.col + 1 GROUP BY e.image, e.col, e.row),
ends AS (SELECT image, arg_max(path, struct_pack(t := round(total, 9), n := -row)) AS path FROM dp WHERE col = {COLS - 1} GROUP BY image),
pt AS (SELECT image, unnest(path) AS row, generate_subscripts(path, 1) - 1 AS col FROM ends),
mv AS (SELECT p.image, p.col, arg_max(f, struct_pack(b := f.between, n := -abs(f.row - p.row), u := -f.row)) AS f
  FROM pt p JOIN fx f ON f.image = p.image AND f.col = p.col AND f.row BETWEEN greatest(1, p.row - 2) AND least({_LAST}, p.row + 2) WHERE f.row = p.row OR f.evidence > 0 GROUP BY p.image, p.col),
ch AS (SELECT image, col, CASE WHEN f.evidence > 0 THEN f.row END AS row, f.contrast AS contrast, f.snr AS snr, f.edge01 AS edge01, f.evidence AS evidence FROM mv),
ag AS (SELECT a.image, a.col, count(b.row) AS n, median(b.row) AS m FROM ch a LEFT JOIN ch b ON b.image = a.image AND b.col <> a.col AND abs(b.col - a.col) <= 16 AND b.evidence >= {sk.READABLE!r} GROUP BY a.image, a.col),
ac AS (SELECT ch.*, coalesce(CASE WHEN n >= 3 THEN 1e0 / (1e0 + pow(abs(row - m) / {ROWS}e0 / {sk.AGREEMENT!r}e0, 2)) END, 1e0) AS agreement01 FROM ch JOIN ag USING (image, col)),
sky AS (SELECT *, row IS NOT NULL AND evidence * agreement01 >= {sk.READABLE!r} AS ok, evidence * agreement01 AS sure, (row + 0.5e0) / {ROWS} AS rn FROM ac)"""
ARCS = f"""pr AS (SELECT image, amp, held, {s.fold('held + d')} AS b, d, {_altitude('d', 'amp')} AS a FROM cam, (SELECT unnest(range(-80, 81))::DOUBLE AS d) x),
arc AS (SELECT image, b AS start, a, lead(a) OVER (PARTITION BY image ORDER BY d) AS a2 FROM pr QUALIFY a2 IS NOT NULL)"""
SCAN = f"""{CAMERAS}, {ARCS},
ob AS (SELECT image, {s.fold('held - turned + d + 0.25e0')} AS bearing, {_altitude('(d + 0.25e0)', 'amp')} AS o, 0.5e0 + (d + 32) % 3 * 0.25e0 AS w FROM cam, (SELECT unnest(range(-32, 33, 2)) AS d) x),
tr AS (SELECT image, k, {s.fold('bearing + (-25e0 + k * 0.2e0)')} AS b, o, w FROM ob, (SELECT unnest(range(0, {len(OFFSETS)})) AS k) ks),
jn AS (SELECT t.image, t.k, t.o, t.w, a.a + {s.fold('t.b - a.start')} * (a.a2 - a.a) AS p FROM tr t JOIN arc a ON a.image = t.image AND {s.fold('t.b - a.start')} < 1),
sm AS (SELECT image, k, count(*) AS used, sum(w * o) / sum(w) AS mo, sum(w * p) / sum(w) AS mp, sum(w * o * o) / sum(w) AS oo, sum(w * p * p) / sum(w) AS pp, sum(w * o * p) / sum(w) AS op FROM jn GROUP BY image, k),
sc AS (SELECT image, k, used, CASE WHEN sqrt(greatest(0e0, oo - mo * mo) * greatest(0e0, pp - mp * mp)) > 1e-12 THEN (op - mo * mp) / sqrt(greatest(0e0, oo - mo * mo) * greatest(0e0, pp - mp * mp)) ELSE 0e0 END AS score
  FROM sm WHERE used >= greatest(2, 33 * {al.MIN_USED!r}))"""
ORACLES = {
    "skyline_factors": f"WITH {FACTORS} SELECT image, CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row, round(contrast, 6) + 0e0 AS contrast, round(snr, 6) + 0e0 AS snr, round(edge01, 6) + 0e0 AS edge01, round(evidence, 6) + 0e0 AS evidence, round(between, 8) + 0e0 AS between FROM fx",
    "photo_skylines": f"""WITH RECURSIVE {PATHS} SELECT image, CAST(col AS INTEGER) AS col, round((col + 0.5e0) / {COLS}, 5) AS xNorm, CASE WHEN ok THEN round(rn, 5) END AS rowNorm, CASE WHEN ok THEN round(sure, 5) ELSE 0e0 END AS confidence01,
  round(contrast, 5) + 0e0 AS contrast, round(snr, 5) + 0e0 AS snr, round(edge01, 5) + 0e0 AS edge01, round(agreement01, 5) + 0e0 AS agreement01 FROM sky""",
    "photo_skyline_summary": f"""WITH RECURSIVE {PATHS} SELECT image, count(*) AS columns, round(count(*) FILTER (ok) / count(*), 5) AS coverage01, round(coalesce(avg(sure) FILTER (ok), 0e0), 5) AS meanConfidence01,
  round(coalesce(sqrt(greatest(0e0, sum(sure * rn * rn) FILTER (ok) / sum(sure) FILTER (ok) - pow(sum(sure * rn) FILTER (ok) / sum(sure) FILTER (ok), 2))), 0e0), 5) AS reliefNorm FROM sky GROUP BY image""",
    "heading_scan": f"WITH {SCAN} SELECT image, CAST(k AS INTEGER) AS k, used, round(score, 6) + 0e0 AS score FROM sc",
    "heading_locks": f"""WITH {SCAN}, rs AS (SELECT image, k, round(score, 9) AS score FROM sc),
ev AS (SELECT i.image, k.k, coalesce(rs.score, '-inf'::DOUBLE) AS score FROM (SELECT DISTINCT image FROM rs) i, (SELECT unnest(range(0, {len(OFFSETS)})) AS k) k LEFT JOIN rs ON rs.image = i.image AND rs.k = k.k),
lr AS (SELECT *, lag(score) OVER o AS l, lead(score) OVER o AS r, max(score) OVER (PARTITION BY image) AS top FROM ev WINDOW o AS (PARTITION BY image ORDER BY k)),
bs AS (SELECT *, min(k) FILTER (score = top) OVER (PARTITION BY image) AS best FROM lr),
bn AS (SELECT *, least(max(k) FILTER (k <= best AND (l IS NULL OR l > score)) OVER (PARTITION BY image), best - 10) AS low, greatest(min(k) FILTER (k >= best AND (r IS NULL OR r > score)) OVER (PARTITION BY image), best + 10) AS high FROM bs),
pk AS (SELECT image, any_value(top) AS peak, any_value(best) AS best, max(score) FILTER (k < low OR k > high) AS rival, any_value(coalesce(l, score)) FILTER (k = best) AS l, any_value(coalesce(r, score)) FILTER (k = best) AS r FROM bn GROUP BY image)
SELECT image, round(-25e0 + best * 0.2e0 + 0.2e0 * CASE WHEN isfinite(l - 2e0 * peak + r) AND abs(l - 2e0 * peak + r) >= 1e-12 THEN greatest(-0.5e0, least(0.5e0, 0.5e0 * (l - r) / (l - 2e0 * peak + r))) ELSE 0e0 END, 3) + 0e0 AS headingOffsetDeg,
  round(peak, 6) + 0e0 AS peak, round(CASE WHEN rival > '-inf'::DOUBLE THEN peak - rival ELSE peak END, 5) + 0e0 AS margin, best IN (0, {len(OFFSETS) - 1}) AS atEdge FROM pk""",
}
