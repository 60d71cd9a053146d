"""Raster, camera, label and pose queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import camera as c
from ridgeline.functions import geodesy as g
from ridgeline.functions.geodesy import num
from ridgeline.functions.text import text_width_em
from ridgeline.operators import raster as ra
from ridgeline.operators import visibility as v
from ridgeline.plans import sqltext as s
from ridgeline.plans.records import _width
from ridgeline.plans.scene import r
from ridgeline.sources import views

NORTH, WEST, STEP, N = 46.0, 7.0, 0.02, 51


def _samples(spark: SparkSession) -> DataFrame:
    """A grid of the closed-form landscape with void cells."""
    at = spark.range(N * N).select((F.col("id") / N).cast("int").alias("row"), (F.col("id") % N).cast("int").alias("col"))
    height = views.terrain_m(num(NORTH) - F.col("row") * num(STEP), num(WEST) + F.col("col") * num(STEP))
    return at.withColumn("elevationM", F.when((F.col("row") * 7 + F.col("col") * 3) % 23 != 0, height))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return views.table(spark, sf_dir, "customer").select(k.alias("point_id"), (num(44.9) + (k * 37 % 1200) / num(1000)).alias("lat"), (num(6.95) + (k * 53 % 1100) / num(1000)).alias("lon"))


def raster_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear readings of points in a grid with voids, and what they rest on."""
    out = ra.read_bilinear(_points(spark, sf_dir), _samples(spark), NORTH, WEST, STEP, N, N)
    return out.select("point_id", "status", "method", r("elevationM", 3).alias("elevationM"))


def grid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of a catalog that answers for each point."""
    catalog = spark.createDataFrame([("a", 45.5, 7.0, 31, 31, 0.01, 0), ("b", 46.2, 7.2, 51, 51, 0.02, 1), ("c", 46.2, 7.2, 51, 51, 0.02, 2), ("d", 45.0, 6.9, 11, 101, 0.01, 3)], "name string, northLat double, westLon double, rows int, cols int, stepDeg double, ord int")
    return ra.choose_grid(_points(spark, sf_dir), catalog).select("point_id", "grid")


def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that summits need and the store (cells of observers) does not hold."""
    need = views.summits(spark, sf_dir).select(g.cell_name(F.col("lat"), F.col("lon")).alias("tile")).distinct()
    held = views.observers(spark, sf_dir).where("observer_id < 12").select(g.cell_name(F.col("lat"), F.col("lon")).alias("tile")).distinct()
    return need.join(held, "tile", "left_anti")


#: Screen cells in which label boxes are compared.
CELL_W, CELL_H = 128, 32


def _pose() -> tuple:
    o = F.col("observer_id")
    return (o * 29 % 360).cast("double"), (o % 7 - 3).cast("double"), (o % 5 - 2).cast("double"), num(60) + o % 20, num(42) + o % 13


def projected_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each observer's camera sees the summits in reach, and the way back from the frame."""
    seen = v.sightings(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.RADIUS_KM)
    h, p, ro, hf, vf = _pose()
    at = c.project(h, p, ro, hf, vf, F.col("bearingDeg"), F.col("altitudeDeg"))
    placed = seen.select("observer_id", "id", *[x.alias(k) for k, x in at.items()])
    back = c.unproject(h, p, ro, hf, vf, F.col("x"), F.col("y"))
    return placed.select("observer_id", "id", "inFrame", (F.col("depth") > 0).alias("inFront"), r("x", 5).alias("x"), r("y", 5).alias("y"), r(F.when(F.col("inFrame"), back[0]), 3).alias("backBearingDeg"), r(F.when(F.col("inFrame"), back[1]), 3).alias("backAltitudeDeg"))


def fields_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, w, h = num(14) + F.col("p_size") * num(4), num(3000) + F.col("p_partkey") % 2000, num(2000) + F.col("p_partkey") % 3000
    long_side = c.hfov_deg(f)
    wide = w >= h
    hf = F.when(wide, long_side).otherwise(c.vfov_deg(long_side, h / w))
    return views.table(spark, sf_dir, "part").select("p_partkey", r(long_side).alias("longSideDeg"), r(hf).alias("hFovDeg"), r(c.vfov_deg(hf, w / h)).alias("vFovDeg"), r(c.focal_35mm(hf), 3).alias("focal35mm"), r(c.drag_angle_deg(F.col("p_partkey") % 400 - num(200), w, hf)).alias("dragDeg"))


def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b = ((k * 37 % 2400) - num(600), (k * 91 % 1800) - num(450)), ((k * 53 % 2400) - num(600), F.when(k % 10 == 0, (k * 91 % 1800) - num(450)).otherwise((k * 17 % 1800) - num(450)))
    clip = c.clip_segment(*a, *b, num(1200), num(900))
    return views.table(spark, sf_dir, "orders").select(k.alias("k"), *[r(x, 3).alias(n) for n, x in clip.items()])


def label_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that a frame has room for: highest in view first, a budget from the labels' mean width."""
    seen = v.sightings(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.RADIUS_KM)
    width = text_width_em(F.col("name")) * num(14) + num(8)
    every, order = Window.partitionBy("observer_id"), Window.partitionBy("observer_id").orderBy(F.desc("altitudeDeg"), F.desc("elevationM"), "id")
    mean = F.avg(width).over(every)
    ranked = seen.select("observer_id", "id", F.row_number().over(order).cast("long").alias("rank"), F.greatest(F.lit(1), F.floor(num(0.75) * F.floor(num(1600) / mean) * num(3))).cast("long").alias("budget"))
    return ranked.select("observer_id", "id", "rank", "budget", (F.col("rank") <= F.col("budget")).alias("labelled"))


def label_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of label boxes of one observer that overlap (touching is no overlap)."""
    h, p, ro, hf, vf = _pose()
    seen = v.sightings(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.RADIUS_KM)
    at = c.project(h, p, ro, hf, vf, F.col("bearingDeg"), F.col("altitudeDeg"))
    boxes = seen.select("observer_id", "id", at["inFrame"].alias("inFrame"), r(at["x"] * num(1600), 3).alias("x"), r(at["y"] * num(1200), 3).alias("y"), (text_width_em(F.col("name")) * num(14)).alias("w")).where("inFrame")
    # boxes by the screen cells that they touch; a pair counts in the cell of its overlap's upper left corner
    across = F.sequence(F.floor(F.col("x") / CELL_W), F.floor((F.col("x") + F.col("w")) / CELL_W))
    down = F.sequence(F.floor(F.col("y") / CELL_H), F.floor((F.col("y") + 32) / CELL_H))
    celled = boxes.select("*", F.explode(across).alias("cx")).select("*", F.explode(down).alias("cy"))
    a, b = celled.alias("a"), celled.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("observer_id", "cx", "cy")]
    hit = (F.col("a.id") < F.col("b.id")) & (F.col("a.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("a.x") + F.col("a.w")) & (F.col("a.y") < F.col("b.y") + 32) & (F.col("b.y") < F.col("a.y") + 32)
    once = (F.floor(F.greatest("a.x", "b.x") / CELL_W) == F.col("a.cx")) & (F.floor(F.greatest("a.y", "b.y") / CELL_H) == F.col("a.cy"))
    return a.join(b, [*same, hit, once]).select("a.observer_id", F.col("a.id").alias("first"), F.col("b.id").alias("second"))


def resolved_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, ground height and field of view from three layers: user, photograph, default; a bad user value blocks."""
    k = F.col("p_partkey")
    user = F.when(k % 6 == 0, (k % 900) - num(90))
    ref = F.when(k % 4 == 0, "T").when(k % 4 == 1, "M")
    raw = F.when(k % 5 != 0, (k * 7 % 360).cast("double"))
    declination = F.when(k % 3 != 0, num(2.5))
    exif = F.when(ref == "T", raw).when(ref == "M", g.fold(raw + declination))
    blocked = F.when(raw.isNull(), "absent-from-exif").when(ref.isNull(), "direction-reference-unknown").when((ref == "M") & declination.isNull(), "magnetic-declination-required")
    fallback = F.when(k % 7 == 0, num(180))
    bad = user.isNotNull() & ~user.between(0, 360)
    value = F.when(bad, None).otherwise(F.coalesce(user, exif, fallback))
    source = F.when(bad, None).when(user.isNotNull(), "user").when(exif.isNotNull(), "exif").when(fallback.isNotNull(), "default")
    reason = F.when(bad, "out-of-range").when(source.isNull(), F.coalesce(blocked, F.lit("absent-from-exif")))
    ground = F.when(k % 8 != 0, F.col("p_size") * num(50)) - F.when(k % 9 != 0, num(1.6))
    ground_reason = F.when(k % 8 == 0, "absent-from-exif").when(k % 9 == 0, "eye-height-required")
    return views.table(spark, sf_dir, "part").select(k.alias("k"), r(value, 3).alias("headingDeg"), source.alias("source"), reason.alias("reason"), r(ground, 3).alias("groundElevationM"), ground_reason.alias("groundReason"), (reason.isNull() & ground_reason.isNull()).alias("complete"))


def trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses after trims, the span that a sweep of a sector leaves uncovered, and linear ramps."""
    k = F.col("c_custkey")
    heading, pitch, hf = (k * 13 % 360).cast("double"), (k * 7 % 181) - num(90), num(20) + k % 100
    start, span = (k * 29 % 360).cast("double"), F.when(k % 11 == 0, num(360)).otherwise(num(60) + k % 200)
    drawn = F.least(num(360), hf * num(1.5))
    offset = g.fold(heading - drawn / num(2) - start)
    direct = F.when(offset < span, F.least(span - offset, drawn)).otherwise(num(0))
    uncovered = F.when(span >= 360, num(0)).otherwise(drawn - direct - F.greatest(num(0), F.least(offset + drawn - num(360), span)))
    trimmed = F.least(num(175), F.greatest(num(1), hf + (k % 61 - num(30))))
    return views.table(spark, sf_dir, "customer").select(k.alias("k"), g.fold(heading + (k % 61 - num(30))).alias("headingDeg"), g.clamp(pitch + (k % 41 - num(20)), -90, 90).alias("pitchDeg"), trimmed.alias("hFovDeg"), r(c.vfov_deg(trimmed, num(1.5))).alias("vFovDeg"), r(uncovered, 6).alias("uncoveredDeg"), r(F.least(num(1), F.greatest(num(0), (hf - num(30)) / num(50))), 6).alias("ramp"))


O = "observer_id"
POSE = f"CAST(({O} * 29) % 360 AS DOUBLE) AS h, CAST({O} % 7 - 3 AS DOUBLE) AS p, CAST({O} % 5 - 2 AS DOUBLE) AS ro, 60e0 + {O} % 20 AS hf, 42e0 + {O} % 13 AS vf"
AXES = """ax AS (SELECT *, sin(radians(h)) * cos(radians(p)) AS fe, cos(radians(h)) * cos(radians(p)) AS fn, sin(radians(p)) AS fu,
  cos(radians(h)) * cos(radians(ro)) + sin(radians(h)) * sin(radians(p)) * sin(radians(ro)) AS re, -sin(radians(h)) * cos(radians(ro)) + cos(radians(h)) * sin(radians(p)) * sin(radians(ro)) AS rn, -cos(radians(p)) * sin(radians(ro)) AS ru,
  cos(radians(h)) * sin(radians(ro)) - sin(radians(h)) * sin(radians(p)) * cos(radians(ro)) AS ue, -sin(radians(h)) * sin(radians(ro)) - cos(radians(h)) * sin(radians(p)) * cos(radians(ro)) AS un, cos(radians(p)) * cos(radians(ro)) AS uu,
  sin(radians(bearingDeg)) * cos(radians(altitudeDeg)) AS de, cos(radians(bearingDeg)) * cos(radians(altitudeDeg)) AS dn, sin(radians(altitudeDeg)) AS du FROM posed),
dep AS (SELECT *, de * fe + dn * fn + du * fu AS depth, tan(radians(hf) / 2e0) AS hw, tan(radians(vf) / 2e0) AS hh FROM ax),
xy AS (SELECT *, CASE WHEN depth > 0 THEN 0.5e0 + (de * re + dn * rn + du * ru) / depth / (2e0 * hw) END AS x, CASE WHEN depth > 0 THEN 0.5e0 - (de * ue + dn * un + du * uu) / depth / (2e0 * hh) END AS y FROM dep),
fr AS (SELECT *, coalesce(depth > 0 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1, false) AS inFrame, (x - 0.5e0) * 2e0 * hw AS ta, (0.5e0 - y) * 2e0 * hh AS tb FROM xy),
bk AS (SELECT *, fe + ta * re + tb * ue AS be, fn + ta * rn + tb * un AS bn, fu + ta * ru + tb * uu AS bu FROM fr)"""
GRID = f"grid AS (SELECT rr.r AS row, cc.c AS col, CASE WHEN (rr.r * 7 + cc.c * 3) % 23 <> 0 THEN {s.terrain('(46e0 - rr.r * 0.02e0)', '(7e0 + cc.c * 0.02e0)')} END AS e FROM (SELECT unnest(range(0, 51)) AS r) rr, (SELECT unnest(range(0, 51)) AS c) cc)"
POINTS = "pts AS (SELECT c_custkey AS point_id, 44.9e0 + ((c_custkey * 37) % 1200) / 1000e0 AS lat, 6.95e0 + ((c_custkey * 53) % 1100) / 1000e0 AS lon FROM customer)"
_C = "c_custkey"
_P = "p_partkey"

_FUNCS = (raster_readings, grid_choice, missing_tiles, projected_peaks, fields_of_view, clipped_segments, label_ranking, label_collisions, resolved_pose, trims)
QUERIES = {f.__name__: f for f in _FUNCS}
ORACLES = {
    "raster_readings": f"""WITH {GRID}, {POINTS}, ix AS (SELECT *, (46e0 - lat) / 0.02e0 AS r0, (CASE WHEN lon - 7e0 >= 0 THEN lon - 7e0 ELSE lon - 7e0 + 360e0 END) / 0.02e0 AS c0 FROM pts),
ins AS (SELECT *, r0 >= -1e-9 AND r0 <= 50.000000001e0 AND c0 >= -1e-9 AND c0 <= 50.000000001e0 AS inside, greatest(0e0, least(50e0, r0)) AS r1, greatest(0e0, least(50e0, c0)) AS c1 FROM ix),
co AS (SELECT point_id, r1 - rb AS fr, c1 - cb AS fc, rb, cb FROM (SELECT *, least(floor(r1), 49e0) AS rb, least(floor(c1), 49e0) AS cb FROM ins WHERE inside)),
w AS (SELECT point_id, 0 AS k, rb AS row, cb AS col, (1e0 - fr) * (1e0 - fc) AS w FROM co UNION ALL SELECT point_id, 1, rb, cb + 1, (1e0 - fr) * fc FROM co UNION ALL SELECT point_id, 2, rb + 1, cb, fr * (1e0 - fc) FROM co UNION ALL SELECT point_id, 3, rb + 1, cb + 1, fr * fc FROM co),
rd AS (SELECT w.point_id, sum(g.e * w.w) AS sm, sum(CASE WHEN g.e IS NULL THEN w.w ELSE 0e0 END) AS void, max(CASE WHEN g.e IS NOT NULL THEN struct_pack(w := w.w, k := -w.k, e := g.e) END) AS best FROM w JOIN grid g ON g.row = w.row AND g.col = w.col GROUP BY w.point_id)
SELECT i.point_id, CASE WHEN NOT inside THEN 'outside' WHEN void > {ra.NEGLIGIBLE_VOID_WEIGHT!r} AND best IS NULL THEN 'void' ELSE 'ok' END AS status, CASE WHEN void <= {ra.NEGLIGIBLE_VOID_WEIGHT!r} THEN 'bilinear' WHEN best IS NOT NULL THEN 'nearest-valid' END AS method,
  round(CASE WHEN void <= {ra.NEGLIGIBLE_VOID_WEIGHT!r} THEN sm ELSE best.e END, 3) + 0e0 AS elevationM FROM ins i LEFT JOIN rd ON rd.point_id = i.point_id""",
    "grid_choice": f"""WITH {POINTS}, cat AS (SELECT * FROM (VALUES ('a', 45.5e0, 7.0e0, 0.3e0, 0.3e0, 0), ('b', 46.2e0, 7.2e0, 1e0, 1e0, 1), ('c', 46.2e0, 7.2e0, 1e0, 1e0, 2), ('d', 45.0e0, 6.9e0, 0.1e0, 1e0, 3)) t(name, n, w, ht, wd, ord))
SELECT p.point_id, (SELECT c.name FROM cat c WHERE p.lat <= c.n + 1e-9 AND p.lat >= c.n - c.ht - 1e-9 AND p.lon >= c.w - 1e-9 AND p.lon <= c.w + c.wd + 1e-9 ORDER BY round(c.ht * c.wd, 9) DESC, c.ord LIMIT 1) AS grid FROM pts p""",
    "missing_tiles": f"WITH {s.OBSERVER}, {s.SUMMIT} SELECT DISTINCT {s.cell('lat', 'lon')} AS tile FROM g_summit EXCEPT SELECT {s.cell('lat', 'lon')} FROM g_observer WHERE observer_id < 12",
    "projected_peaks": f"""WITH {s.OBSERVER}, {s.SUMMIT}, {s.SIGHTING}, posed AS (SELECT *, {POSE} FROM g_seen), {AXES} SELECT observer_id, id, inFrame, depth > 0 AS inFront, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y,
  CASE WHEN inFrame THEN round({s.fold('degrees(atan2(be, bn))')}, 3) + 0e0 END AS backBearingDeg, CASE WHEN inFrame THEN round(degrees(asin(greatest(-1e0, least(1e0, bu / sqrt(be * be + bn * bn + bu * bu))))), 3) + 0e0 END AS backAltitudeDeg FROM bk""",
    "fields_of_view": f"""WITH x AS (SELECT {_P}, 14e0 + p_size * 4e0 AS f, 3000e0 + {_P} % 2000 AS w, 2000e0 + {_P} % 3000 AS h FROM part), l AS (SELECT *, 2e0 * degrees(atan(36e0 / (2e0 * f))) AS lg FROM x),
y AS (SELECT *, CASE WHEN w >= h THEN lg ELSE 2e0 * degrees(atan(tan(radians(lg) / 2e0) / (h / w))) END AS hf FROM l)
SELECT {_P}, round(lg, 4) + 0e0 AS longSideDeg, round(hf, 4) + 0e0 AS hFovDeg, round(2e0 * degrees(atan(tan(radians(hf) / 2e0) / (w / h))), 4) + 0e0 AS vFovDeg, round(36e0 / (2e0 * tan(radians(hf) / 2e0)), 3) + 0e0 AS focal35mm,
  round(degrees(atan(({_P} % 400 - 200e0) / (w / 2e0) * tan(radians(hf) / 2e0))), 4) + 0e0 AS dragDeg FROM y""",
    "clipped_segments": """WITH s AS (SELECT o_orderkey AS k, (o_orderkey * 37) % 2400 - 600e0 AS ax, (o_orderkey * 91) % 1800 - 450e0 AS ay, (o_orderkey * 53) % 2400 - 600e0 AS bx, CASE WHEN o_orderkey % 10 = 0 THEN (o_orderkey * 91) % 1800 - 450e0 ELSE (o_orderkey * 17) % 1800 - 450e0 END AS b_y FROM orders),
d AS (SELECT *, bx - ax AS dx, b_y - ay AS dy FROM s),
t AS (SELECT *, greatest(0e0, CASE WHEN dx > 0 THEN -ax / dx WHEN dx < 0 THEN (1200e0 - ax) / dx ELSE 0e0 END, CASE WHEN dy > 0 THEN -ay / dy WHEN dy < 0 THEN (900e0 - ay) / dy ELSE 0e0 END) AS t0,
  least(1e0, CASE WHEN dx < 0 THEN -ax / dx WHEN dx > 0 THEN (1200e0 - ax) / dx ELSE 1e0 END, CASE WHEN dy < 0 THEN -ay / dy WHEN dy > 0 THEN (900e0 - ay) / dy ELSE 1e0 END) AS t1,
  (dx = 0 AND (ax < 0 OR ax > 1200)) OR (dy = 0 AND (ay < 0 OR ay > 900)) AS gone FROM d)
SELECT k, CASE WHEN NOT gone AND t0 <= t1 THEN round(ax + t0 * dx, 3) + 0e0 END AS x0, CASE WHEN NOT gone AND t0 <= t1 THEN round(ay + t0 * dy, 3) + 0e0 END AS y0, CASE WHEN NOT gone AND t0 <= t1 THEN round(ax + t1 * dx, 3) + 0e0 END AS x1, CASE WHEN NOT gone AND t0 <= t1 THEN round(ay + t1 * dy, 3) + 0e0 END AS y1 FROM t""",
    "label_ranking": f"""WITH {s.OBSERVER}, {s.SUMMIT}, {s.SIGHTING}, m AS (SELECT s.*, avg({_width('p.name')} * 14e0 + 8e0) OVER (PARTITION BY s.observer_id) AS mw, row_number() OVER (PARTITION BY s.observer_id ORDER BY s.altitudeDeg DESC, s.elevationM DESC, s.id) AS rank FROM g_seen s JOIN g_summit p ON p.id = s.id),
b AS (SELECT *, CAST(greatest(1, floor(0.75e0 * floor(1600e0 / mw) * 3e0)) AS BIGINT) AS budget FROM m) SELECT observer_id, id, rank, budget, rank <= budget AS labelled FROM b""",
    "label_collisions": f"""WITH {s.OBSERVER}, {s.SUMMIT}, {s.SIGHTING}, posed AS (SELECT s.*, p.name, {POSE} FROM g_seen s JOIN g_summit p ON p.id = s.id WHERE distanceM <= 30000e0), {AXES},
bx AS (SELECT observer_id, id, round(x * 1600e0, 3) AS px, round(y * 1200e0, 3) AS py, {_width('name')} * 14e0 AS w FROM bk WHERE inFrame)
SELECT a.observer_id, a.id AS first, b.id AS second FROM bx a JOIN bx b ON a.observer_id = b.observer_id AND a.id < b.id AND a.px < b.px + b.w AND b.px < a.px + a.w AND a.py < b.py + 32 AND b.py < a.py + 32""",
    "resolved_pose": f"""WITH x AS (SELECT {_P} AS k, p_size, CASE WHEN {_P} % 6 = 0 THEN ({_P} % 900) - 90e0 END AS u, CASE WHEN {_P} % 4 = 0 THEN 'T' WHEN {_P} % 4 = 1 THEN 'M' END AS rf, CASE WHEN {_P} % 5 <> 0 THEN CAST(({_P} * 7) % 360 AS DOUBLE) END AS raw, CASE WHEN {_P} % 3 <> 0 THEN 2.5e0 END AS decl FROM part),
e AS (SELECT *, CASE WHEN rf = 'T' THEN raw WHEN rf = 'M' THEN (raw + decl) % 360e0 END AS ex, CASE WHEN raw IS NULL THEN 'absent-from-exif' WHEN rf IS NULL THEN 'direction-reference-unknown' WHEN rf = 'M' AND decl IS NULL THEN 'magnetic-declination-required' END AS bl, CASE WHEN k % 7 = 0 THEN 180e0 END AS fb, coalesce(u < 0 OR u > 360, false) AS bad FROM x),
v AS (SELECT *, CASE WHEN NOT bad THEN coalesce(u, ex, fb) END AS val, CASE WHEN bad THEN NULL WHEN u IS NOT NULL THEN 'user' WHEN ex IS NOT NULL THEN 'exif' WHEN fb IS NOT NULL THEN 'default' END AS src FROM e),
q AS (SELECT *, CASE WHEN bad THEN 'out-of-range' WHEN src IS NULL THEN coalesce(bl, 'absent-from-exif') END AS reason, CASE WHEN k % 8 = 0 THEN 'absent-from-exif' WHEN k % 9 = 0 THEN 'eye-height-required' END AS gr FROM v)
SELECT k, round(val, 3) + 0e0 AS headingDeg, src AS source, reason, CASE WHEN gr IS NULL THEN round(p_size * 50e0 - 1.6e0, 3) + 0e0 END AS groundElevationM, gr AS groundReason, reason IS NULL AND gr IS NULL AS complete FROM q""",
    "trims": f"""WITH x AS (SELECT {_C} AS k, CAST(({_C} * 13) % 360 AS DOUBLE) AS h, ({_C} * 7) % 181 - 90e0 AS p, 20e0 + {_C} % 100 AS hf, CAST(({_C} * 29) % 360 AS DOUBLE) AS st, CASE WHEN {_C} % 11 = 0 THEN 360e0 ELSE 60e0 + {_C} % 200 END AS sp FROM customer),
y AS (SELECT *, least(360e0, hf * 1.5e0) AS dr, least(175e0, greatest(1e0, hf + (k % 61 - 30e0))) AS tf FROM x), z AS (SELECT *, {s.fold('h - dr / 2e0 - st')} AS off FROM y)
SELECT k, {s.fold('h + (k % 61 - 30e0)')} AS headingDeg, greatest(-90e0, least(90e0, p + (k % 41 - 20e0))) AS pitchDeg, tf AS hFovDeg, round(2e0 * degrees(atan(tan(radians(tf) / 2e0) / 1.5e0)), 4) + 0e0 AS vFovDeg,
  round(CASE WHEN sp >= 360 THEN 0e0 ELSE dr - (CASE WHEN off < sp THEN least(sp - off, dr) ELSE 0e0 END) - greatest(0e0, least(off + dr - 360e0, sp)) END, 6) + 0e0 AS uncoveredDeg, round(least(1e0, greatest(0e0, (hf - 30e0) / 50e0)), 6) + 0e0 AS ramp FROM z""",
}
