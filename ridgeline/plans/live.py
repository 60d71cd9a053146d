"""Sensor and skyline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import num
from ridgeline.operators import sensors as se
from ridgeline.operators import skyline as sk
from ridgeline.plans import sqltext as s
from ridgeline.plans.scene import r
from ridgeline.sources import views
from ridgeline.streaming.sensors import windowed_headings

AGE, TAU = 6 * 3_600_000, 7_200_000.0
OFFSETS = [x * 0.5 for x in range(-50, 51)]


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.headings(spark, sf_dir).select("device", (F.col("ms") + 1_800_000 * (F.col("event_id") % 12)).alias("atMs")).distinct()


def heading_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed headings at every reading's time, without a declination: refusals and values."""
    out = se.smoothed_headings(views.headings(spark, sf_dir), _instants(spark, sf_dir), None, AGE, TAU)
    return out.select("device", "atMs", r("headingDeg", 3).alias("headingDeg"), r("spreadDeg", 3).alias("spreadDeg"), "samples", "refusal")


def true_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a declination, so that magnetic readings count."""
    out = se.smoothed_headings(views.headings(spark, sf_dir), _instants(spark, sf_dir), 2.5, AGE, TAU)
    return out.select("device", "atMs", r("headingDeg", 3).alias("headingDeg"), "samples", "refusal")


def orientation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = se.smoothed_orientation(views.gravity(spark, sf_dir), _instants(spark, sf_dir), AGE, TAU)
    return out.select("device", "atMs", r("pitchDeg", 3).alias("pitchDeg"), r("pitchSpreadDeg", 3).alias("pitchSpreadDeg"), "pitchRefusal", r("rollDeg", 3).alias("rollDeg"), "rollRefusal")


def fused_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, pitch and roll of every device at every reading's time, each answered or refused by itself."""
    out = se.fused_poses(views.headings(spark, sf_dir), views.gravity(spark, sf_dir), _instants(spark, sf_dir), 2.5, AGE, TAU)
    return out.select("device", "atMs", r("headingDeg", 3).alias("headingDeg"), "headingRefusal", r("pitchDeg", 3).alias("pitchDeg"), "pitchRefusal", r("rollDeg", 3).alias("rollDeg"), "rollRefusal")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best axis map of each device whose readings are turned in one of 48 ways."""
    holds = spark.createDataFrame([(h, float(a), float(b), float(c)) for h, a, b, c in se.HOLDS], "hold string, ex double, ey double, ez double")
    n = F.col("n_nationkey")
    x, y, z = F.col("ex"), F.col("ey"), F.col("ez")
    turned = views.table(spark, sf_dir, "nation").crossJoin(F.broadcast(holds)).select(n.alias("device"), "hold", F.when(n % 3 == 0, x).when(n % 3 == 1, y).otherwise(-z).alias("x"), (F.when(n % 3 == 0, -y).when(n % 3 == 1, x).otherwise(y) + num(0.05)).alias("y"), (F.when(n % 3 == 2, x).otherwise(z) + n * num(0.003)).alias("z"))
    out = se.axis_maps(turned)
    return out.select("device", "map", r("worstErrorDeg").alias("worstErrorDeg"))


def heading_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows, half an hour apart, of every device's heading (the stream's plan on a table)."""
    samples = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.pmod(F.col("value") * num(7.3123457), num(360)).alias("headingDeg"))
    out = windowed_headings(samples)
    return out.select("device", F.unix_seconds("start").alias("startSec"), r("headingDeg", 3).alias("headingDeg"), "samples")


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as column signals: 20 columns of an image each."""
    v = F.col("vec_id")
    return views.table(spark, sf_dir, "embeddings").select(F.floor(v / 20).cast("long").alias("image"), (v % 20).alias("col"), F.posexplode("embedding").alias("row", "value")).withColumn("value", F.col("value").cast("double"))


def column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split scores of blurred column signals."""
    out = sk.split_scores(sk.smooth(_signal(spark, sf_dir), 2))
    return out.select("image", "col", "row", r("above", 6).alias("above"), r("below", 6).alias("below"), r("contrast", 6).alias("contrast"), r("between", 8).alias("between"))


def skylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skyline of every image by the exact dynamic program."""
    return sk.extract_skyline(_signal(spark, sf_dir))


def row_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_discount") + num(0.01)).alias("w"))
    out = sk.weighted_moments(rows, ["l_suppkey"], "x", "w")
    return out.select("l_suppkey", r("mean").alias("mean"), r("deviation").alias("deviation"), "median")


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading offsets that each nation's turned view of a profile is found at."""
    n = F.col("n_nationkey")
    shape = lambda b: F.sin(F.radians(b * num(3))) + num(0.6) * F.sin(F.radians(b * num(7) + num(40))) + num(0.3) * F.cos(F.radians(b * num(11)))
    nation = views.table(spark, sf_dir, "nation").select(n.alias("image"))
    profile = nation.select("image", F.explode(F.sequence(F.lit(0), F.lit(359))).alias("b")).select("image", F.col("b").cast("double").alias("bearingDeg"), shape(F.col("b").cast("double")).alias("altitudeDeg"))
    seen = nation.select("image", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("c")).select("image", (num(100) + F.col("c")).alias("bearingDeg"), shape(num(100) + F.col("c") + (F.col("image") % 25 - num(12)) * num(1.3)).alias("altitudeDeg"), (num(1) + F.col("c") % 3).alias("weight"))
    out = sk.align(seen, profile, OFFSETS)
    return out.select("image", "offsetDeg", r("refinedDeg", 3).alias("refinedDeg"), r("score", 6).alias("score"))


INST = "inst AS (SELECT DISTINCT device, ms + 1800000 * (event_id % 12) AS atMs FROM g_heading)"


def _heading_sql(true: str, spread: bool) -> str:
    return f"""WITH {s.HEADING}, {INST}, us AS (SELECT device, ms, {true} AS t FROM g_heading WHERE (accuracyDeg IS NULL OR accuracyDeg >= 0) AND (trueDeg IS NOT NULL OR magneticDeg IS NOT NULL)),
j AS (SELECT i.device, i.atMs, sum(exp(-(i.atMs - u.ms) / 7200000e0) * sin(radians(t))) AS sn, sum(exp(-(i.atMs - u.ms) / 7200000e0) * cos(radians(t))) AS cs, sum(exp(-(i.atMs - u.ms) / 7200000e0)) AS w, count(u.ms) AS n, count(t) AS good
  FROM inst i LEFT JOIN us u ON u.device = i.device AND i.atMs - u.ms BETWEEN 0 AND {AGE} GROUP BY i.device, i.atMs),
f AS (SELECT *, CASE WHEN n = 0 THEN 'stale' WHEN good < n THEN 'needs-declination' END AS refusal, sqrt(sn * sn + cs * cs) / w AS len FROM j)
SELECT device, atMs, CASE WHEN refusal IS NULL THEN round({s.fold('degrees(atan2(sn, cs))')}, 3) + 0e0 END AS headingDeg, {"CASE WHEN refusal IS NULL AND n > 1 THEN round(CASE WHEN len >= 1 THEN 0e0 ELSE degrees(sqrt(greatest(0e0, -2e0 * ln(greatest(len, 1e-12))))) END, 3) + 0e0 END AS spreadDeg," if spread else ""}
  CASE WHEN refusal IS NULL THEN n END AS samples, refusal FROM f"""


_SIGNAL = "sg AS (SELECT vec_id // 20 AS image, vec_id % 20 AS col, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS row FROM embeddings)"
_FUNCS = (heading_answers, true_headings, orientation_answers, fused_poses, calibration, heading_windows, column_scores, skylines, row_moments, alignment)
QUERIES = {f.__name__: f for f in _FUNCS}
_SHAPE = "(sin(radians({b} * 3e0)) + 0.6e0 * sin(radians({b} * 7e0 + 40e0)) + 0.3e0 * cos(radians({b} * 11e0)))"
ORACLES = {
    "heading_answers": _heading_sql("trueDeg", True),
    "true_headings": _heading_sql("coalesce(trueDeg, magneticDeg + 2.5e0)", False),
    "orientation_answers": f"""WITH {s.HEADING}, {INST}, {s.GRAVITY}, j AS (SELECT i.device, i.atMs, g.ms, sqrt(x * x + y * y + z * z) BETWEEN 0.5e0 AND 1.5e0 AS ok, degrees(asin(greatest(-1e0, least(1e0, z / sqrt(x * x + y * y + z * z))))) AS p, atan2(x, -y) AS r, exp(-(i.atMs - g.ms) / 7200000e0) AS w
  FROM inst i LEFT JOIN g_gravity g ON g.device = i.device AND i.atMs - g.ms BETWEEN 0 AND {AGE}),
a AS (SELECT device, atMs, count(ms) AS seen, count(*) FILTER (ok) AS n, sum(w) FILTER (ok) AS sw, sum(w * p) FILTER (ok) AS sp, sum(w * p * p) FILTER (ok) AS sq, count(*) FILTER (ok AND abs(p) <= 80) AS rolls, sum(w * sin(r)) FILTER (ok AND abs(p) <= 80) AS sn, sum(w * cos(r)) FILTER (ok AND abs(p) <= 80) AS cs FROM j GROUP BY device, atMs),
b AS (SELECT *, sp / sw AS m, CASE WHEN seen = 0 THEN 'stale' WHEN n = 0 THEN 'not-gravity' END AS pr, {s.fold('degrees(atan2(sn, cs))')} AS rl FROM a), c AS (SELECT *, coalesce(pr, CASE WHEN abs(m) > 80 OR rolls = 0 THEN 'gimbal-degenerate' END) AS rr FROM b)
SELECT device, atMs, round(m, 3) + 0e0 AS pitchDeg, CASE WHEN n > 1 THEN round(sqrt(greatest(0e0, sq / sw - m * m)), 3) + 0e0 END AS pitchSpreadDeg, pr AS pitchRefusal, CASE WHEN rr IS NULL THEN round(CASE WHEN rl > 180 THEN rl - 360e0 ELSE rl END, 3) + 0e0 END AS rollDeg, rr AS rollRefusal FROM c""",
    "calibration": """WITH h AS (SELECT * FROM (VALUES ('upright-portrait', 0e0, -1e0, 0e0), ('flat-face-up', 0e0, 0e0, -1e0), ('flat-face-down', 0e0, 0e0, 1e0), ('right-edge-down', 1e0, 0e0, 0e0)) t(hold, ex, ey, ez)),
o AS (SELECT n_nationkey AS device, ex, ey, ez, CASE n_nationkey % 3 WHEN 0 THEN ex WHEN 1 THEN ey ELSE -ez END AS x, CASE n_nationkey % 3 WHEN 0 THEN -ey WHEN 1 THEN ex ELSE ey END + 0.05e0 AS y, CASE n_nationkey % 3 WHEN 2 THEN ex ELSE ez END + n_nationkey * 0.003e0 AS z FROM nation, h),
m AS (SELECT i * 8 + j AS map, (ARRAY[[1,2,3],[1,3,2],[2,1,3],[2,3,1],[3,1,2],[3,2,1]])[i + 1] AS src, 1 - 2 * ((j // 4) % 2) AS sx, 1 - 2 * ((j // 2) % 2) AS sy, 1 - 2 * (j % 2) AS sz FROM (SELECT unnest(range(0, 6)) AS i) a, (SELECT unnest(range(0, 8)) AS j) b),
e AS (SELECT device, map, max(degrees(acos(greatest(-1e0, least(1e0, (sx * [ex, ey, ez][src[1]] * x + sy * [ex, ey, ez][src[2]] * y + sz * [ex, ey, ez][src[3]] * z) / sqrt(x * x + y * y + z * z)))))) AS worst FROM o, m GROUP BY device, map)
SELECT device, CAST(arg_min(map, struct_pack(w := round(worst, 9), m := map)) AS INTEGER) AS map, round(min(round(worst, 9)), 4) + 0e0 AS worstErrorDeg FROM e GROUP BY device""",
    "heading_windows": f"""WITH x AS (SELECT user_id AS device, epoch_us(ts) AS us, radians((value * 7.3123457e0) % 360e0) AS r FROM events), w AS (SELECT device, r, (us // 1800000000 - k) * 1800 AS startSec FROM x, (SELECT unnest([0, 1]) AS k) ks)
SELECT device, startSec, round({s.fold('degrees(atan2(sum(sin(r)), sum(cos(r))))')}, 3) + 0e0 AS headingDeg, count(*) AS samples FROM w GROUP BY device, startSec""",
    "column_scores": f"""WITH {_SIGNAL}, b AS (SELECT image, col, row, avg(value) OVER (PARTITION BY image, col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM sg),
p AS (SELECT *, count(v) OVER k AS n0, sum(v) OVER k AS s0, count(v) OVER w AS n, sum(v) OVER w AS s FROM b WINDOW k AS (PARTITION BY image, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY image, col)),
q AS (SELECT image, col, row, s0 / n0 AS a, (s - s0) / (n - n0) AS b, n0::DOUBLE / n AS f FROM p WHERE n0 > 0 AND n0 < n)
SELECT image, col, CAST(row AS INTEGER) AS row, round(a, 6) + 0e0 AS above, round(b, 6) + 0e0 AS below, round(a - b, 6) + 0e0 AS contrast, round(f * (1e0 - f) * (a - b) * (a - b), 8) + 0e0 AS between FROM q""",
    "row_moments": """WITH x AS (SELECT l_suppkey, l_quantity AS x, l_discount + 0.01e0 AS w FROM lineitem), m AS (SELECT l_suppkey, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) AS q, quantile_cont(x, 0.5) AS median FROM x GROUP BY 1)
SELECT l_suppkey, round(m, 4) + 0e0 AS mean, round(sqrt(greatest(0e0, q - m * m)), 4) + 0e0 AS deviation, median FROM m""",
    "alignment": f"""WITH p AS (SELECT CAST(b AS DOUBLE) AS b, {_SHAPE.format(b='b')} AS a FROM (SELECT unnest(range(0, 360)) AS b) t), o AS (SELECT n_nationkey AS image, 100e0 + c AS b, {_SHAPE.format(b='(100e0 + c + (n_nationkey % 25 - 12e0) * 1.3e0)')} AS o, 1e0 + c % 3 AS w FROM nation, (SELECT unnest(range(0, 61)) AS c) t),
t AS (SELECT o.*, f.f, {s.fold('o.b + f.f')} AS t FROM o, (SELECT unnest(range(-50, 51)) * 0.5e0 AS f) f), j AS (SELECT t.image, t.f, t.w, t.o, x.a + (t.t - floor(t.t)) * (y.a - x.a) AS p FROM t JOIN p x ON x.b = floor(t.t) JOIN p y ON y.b = (floor(t.t) + 1) % 360),
s AS (SELECT image, f, sum(w) AS w, sum(w * o) / sum(w) AS mo, sum(w * p) / sum(w) AS mp, sum(w * o * o) / sum(w) AS oo, sum(w * p * p) / sum(w) AS pp, sum(w * o * p) / sum(w) AS op FROM j GROUP BY image, f),
c AS (SELECT image, f, CASE WHEN (oo - mo * mo) * (pp - mp * mp) > 1e-12 THEN (op - mo * mp) / sqrt((oo - mo * mo) * (pp - mp * mp)) ELSE 0e0 END AS sc FROM s),
k AS (SELECT *, lag(sc) OVER (PARTITION BY image ORDER BY f) AS l, lead(sc) OVER (PARTITION BY image ORDER BY f) AS r FROM c), g AS (SELECT *, coalesce(CASE WHEN l - 2e0 * sc + r < 0 THEN greatest(-0.5e0, least(0.5e0, 0.5e0 * (l - r) / (l - 2e0 * sc + r))) ELSE 0e0 END, 0e0) AS pk FROM k),
z AS (SELECT image, max(struct_pack(s := round(sc, 9), n := -abs(f), f := f, p := pk)) AS b FROM g GROUP BY image) SELECT image, b.f AS offsetDeg, round(b.f + b.p * 0.5e0, 3) + 0e0 AS refinedDeg, round(b.s, 6) + 0e0 AS score FROM z""",
}
ORACLES["fused_poses"] = f"""SELECT a.device, a.atMs, a.headingDeg, a.refusal AS headingRefusal, b.pitchDeg, b.pitchRefusal, b.rollDeg, b.rollRefusal
FROM ({ORACLES["true_headings"]}) a JOIN ({ORACLES["orientation_answers"]}) b ON b.device = a.device AND b.atMs = a.atMs"""
