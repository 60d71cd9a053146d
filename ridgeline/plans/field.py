"""Queries over what is acquired and what devices report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import camera as cam
from ridgeline.functions import image as im
from ridgeline.functions.geodesy import num
from ridgeline.operators import acquisition as ac
from ridgeline.operators import device as dv
from ridgeline.operators import visibility as v
from ridgeline.plans import imaging
from ridgeline.plans import sqltext as s
from ridgeline.plans.catalog import pick
from ridgeline.plans.scene import r
from ridgeline.sources import views
from ridgeline.tables import spread


def k() -> Column:
    return F.col("p_partkey")


def byte_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded byte ranges of five files, joined where they go on."""
    start, size = F.floor(k() / 5) * 100, F.when(k() % 3 == 0, 90).otherwise(100)
    offset = start + F.when(k() % 35 < 7, 7).otherwise(0)
    ranges = views.table(spark, sf_dir, "part").select((k() % 5).alias("key"), *[x.cast("long").alias(n) for n, x in (("start", start), ("end", start + size), ("offset", offset))])
    return ac.segments(ranges)


def listed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that listings in XML name."""
    name = F.concat(F.lit("part-"), F.lpad(k().cast("string"), 5, "0"), pick([".parquet", ".crc", ".zstd.parquet"], k()))
    entry = F.concat(F.lit("<Contents>\n<Key>"), name, F.lit("</Key><Size>"), F.when(k() % 13 == 4, "x").otherwise((k() * 17).cast("string")), F.lit("</Size></Contents>"))
    xml = views.table(spark, sf_dir, "part").groupBy((k() % 7).alias("key")).agg(F.concat_ws("", F.collect_list(entry)).alias("xml"))
    return ac.listed_parts(xml)


def sampling_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse grids around every observer."""
    o = views.observers(spark, sf_dir).select(F.col("observer_id").alias("key"), "lat", "lon")
    g = ac.sampling_grid(o, 25.0, 12, 5)
    return g.select("key", "ray", "sample", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"))


def sweep_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector that every observer's camera sweeps, and the samples that a sweep of it asks for."""
    o = views.observers(spark, sf_dir)
    span, first = ac.sector((F.col("observer_id") * 29 % 360).cast("double"), num(20) + F.col("observer_id") * 9)
    sweep = ac.Sweep(bearing_step_deg=2.5, range_step_m=90, min_range_m=200, max_range_km=30, start_bearing_deg=350, span_deg=60)
    b, d = sweep.bearings(), sweep.ranges()
    return o.select("observer_id", span.alias("spanDeg"), r(first).alias("startDeg"), F.size(b).cast("long").alias("bearings"), r(F.element_at(b, -1)).alias("lastDeg"), F.size(d).cast("long").alias("ranges"), F.get(d, F.lit(0)).alias("firstM"), F.element_at(d, -1).alias("lastM"))


def recorded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from recorded exchanges."""
    p = views.table(spark, sf_dir, "part")
    records = p.where("p_partkey % 4 <> 1").select(F.concat(F.lit("GET k"), (k() % 150).cast("string")).alias("key"), F.when(k() % 9 == 2, 503).otherwise(200).alias("status"), F.concat(F.lit("b"), k().cast("string")).alias("body"))
    return ac.recorded_answers(p.select(k().alias("k"), F.concat(F.lit("GET k"), k().cast("string")).alias("key")), records).select("k", "status", "body", "reason")


def echoed_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights from batched answers that must echo what was asked."""
    lat, lon = num(45) + k() / num(1000), num(7) + k() / num(500)
    point = F.struct(lat.alias("lat"), lon.alias("lon"))
    answer = F.struct(F.when(k() % 6 != 1, k() * num(1.5)).alias("elevation"), F.struct((lat + F.when(k() % 11 == 3, num(0.001)).otherwise(num(4e-7))).alias("lat"), lon.alias("lng")).alias("location"))
    rows = views.table(spark, sf_dir, "part").select(F.floor(k() / 8).cast("long").alias("key"), k().alias("k"), point.alias("p"), answer.alias("a"))
    each = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "p", "a"))).alias("x"))
    results = F.when(F.col("key") % 5 == 2, F.slice(F.col("x.a"), 1, 1)).otherwise(F.col("x.a"))
    payload = F.to_json(F.struct(F.when(F.col("key") % 7 == 4, "INVALID").otherwise("OK").alias("status"), results.alias("results")))
    out = ac.echoed_heights(each.select("key", F.col("x.p").alias("asked"), payload.alias("payload")))
    return out.select("key", "at", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), "elevationM", "reason")


def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their summits and the sources that they cite."""
    n = views.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    path = F.concat(F.lit("regions/"), F.lower("n_name"), F.lit("/index.json"))
    sources = F.array(pick(["OpenMap", "Survey", " "], key), F.concat(F.lit("Source "), (key % 4).cast("string")))
    return ac.region_summary(n.select(path.alias("path"), F.when(key % 6 != 1, key * 10).alias("peakCount"), sources.alias("sources")))


def gravity_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion events as gravity samples, with what can't be used refused."""
    e, value = F.col("event_id"), F.col("value")
    g = F.when(e % 11 != 5, F.struct(value.alias("x"), F.when(e % 17 == 3, num(float("nan"))).otherwise(value * num(0.5)).alias("y"), num(9.8).alias("z")))
    own = F.when(e % 3 != 0, F.struct(num(0.1).alias("x"), F.when(e % 5 == 1, num(float("inf"))).otherwise(num(0.2)).alias("y"), num(-0.1).alias("z")))
    motion = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), e.alias("ms"), g.alias("gravity"), own.alias("linear"))
    out = dv.gravity_samples(motion)
    return out.select("device", "ms", *[r(c, 6).alias(c) for c in "xyz"], "contaminated", "refusal")


def heading_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compass events as heading samples."""
    e, value = F.col("event_id"), F.col("value")
    readings = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"), e.alias("ms"), F.when(e % 4 == 1, num(-1)).otherwise(value).alias("trueHeading"), F.when(e % 6 == 1, num(float("nan"))).when(e % 12 == 5, num(-1)).otherwise(value + 1).alias("magHeading"), pick([0.0, 1.0, 2.0, 3.0, 4.0, 1.5, -1.0], e).alias("bucket"),
    )
    return dv.heading_samples(readings).select("device", "ms", r("trueDeg", 6).alias("trueDeg"), r("magneticDeg", 6).alias("magneticDeg"), "accuracyDeg", "refusal")


def sensor_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses with the fields that sensors answered."""
    c = F.col("c_custkey")
    t = views.table(spark, sf_dir, "customer")
    poses = t.select(c.alias("key"), (c % 360).cast("double").alias("headingDeg"), (c % 50 - 25).cast("double").alias("pitchDeg"), num(0).alias("rollDeg"))
    answers = t.where("c_custkey % 3 <> 1").select(c.alias("key"), F.when(c % 2 == 0, num(1) + c).alias("heading"), F.when(c % 5 != 0, num(-2)).alias("pitch"), F.when(c % 7 == 0, num(3)).alias("roll"))
    return dv.pose_with_sensors(poses, answers)


def live_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ticks of every observer over the scene that was swept for its first pose."""
    h, p, ro, hf, vf = imaging._pose()
    o = views.observers(spark, sf_dir)
    scenes = o.select(F.col("observer_id").alias("scene"), F.pmod(h - hf, num(360)).alias("startDeg"), (hf * num(2)).alias("spanDeg"))
    ticks = o.select("observer_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("t"))
    ticks = ticks.select(F.col("observer_id").alias("scene"), (F.col("observer_id") * 3 + F.col("t")).alias("tick"), (h + F.col("t") * num(11)).alias("headingDeg"), p.alias("pitchDeg"), ro.alias("rollDeg"), hf.alias("hFovDeg"), vf.alias("vFovDeg"))
    seen = v.sightings(o, views.summits(spark, sf_dir), views.RADIUS_KM).select(F.col("observer_id").alias("scene"), "id", "bearingDeg", "altitudeDeg")
    out = dv.live_overlay(ticks, scenes, seen)
    return out.select(F.col("tick").cast("long").alias("tick"), "id", "reason", r("x", 5).alias("x"), r("y", 5).alias("y"), "inFrame", r("uncoveredDeg", 5).alias("uncoveredDeg"))


def drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trims that drags between two places of a frame stand for."""
    c = F.col("c_custkey")
    a, b = (c * 37 % 1600).cast("double"), (c * 91 % 1600).cast("double")
    out = -dv.drag_trim_deg(a, b, num(1600), (c % 90).cast("double"))
    return views.table(spark, sf_dir, "customer").select(c.alias("k"), r(out).alias("headingTrimDeg"), r(cam.drag_angle_deg(b - num(800), num(1600), num(60))).alias("fromCentreDeg"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    suppliers = spread(views.table(spark, sf_dir, "supplier").select("s_suppkey"), 2000, "s_suppkey")
    wide = suppliers.select(F.col("s_suppkey").alias("image"), F.posexplode(F.sequence(F.lit(0), F.lit(29))).alias("x", "_x")).drop("_x")
    at = wide.select("image", "x", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("row"))
    i, row = F.col("image"), F.col("row")
    return at.select("image", "x", "row", ((x * 7 + row * 3 + i) % 256).cast("double").alias("red"), ((x * 5 + row * 11) % 256).cast("double").alias("green"), ((x + row * 13 + i * 3) % 256).cast("double").alias("blue"))


def column_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky affinity of small images by strips of columns."""
    out = im.column_signals(_pixels(spark, sf_dir), 30, 8)
    return out.select("image", F.col("strip").cast("int").alias("strip"), "row", r("affinity", 6).alias("affinity"))


def refined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows refined to the best nearby."""
    signals = im.column_signals(_pixels(spark, sf_dir), 30, 8)
    score = F.floor(F.col("affinity") * 1000)
    scores = signals.select("image", "strip", "row", score.alias("between"), (score % 5).alias("evidence"))
    chosen = signals.where("row = 9").select("image", "strip", ((F.col("image") + F.col("strip") * 3) % 20).cast("int").alias("row"))
    return im.refined_rows(scores, chosen, 3).select("image", F.col("strip").cast("int").alias("strip"), "row")


_ALL = (byte_segments, listed_parts, sampling_grids, sweep_sectors, recorded_answers, echoed_heights, region_summary, gravity_samples, heading_samples, sensor_poses, live_overlay, drags, column_signals, refined_rows)
QUERIES = {f.__name__: f for f in _ALL}

P = "p_partkey"
_G = "e % 11 <> 5 AND e % 17 <> 3"
_CONT = "(e % 3 = 0 OR e % 5 = 1)"
_PX = "px AS (SELECT s_suppkey AS image, x, y AS row, CAST((x * 7 + y * 3 + s_suppkey) % 256 AS DOUBLE) AS r, CAST((x * 5 + y * 11) % 256 AS DOUBLE) AS g, CAST((x + y * 13 + s_suppkey * 3) % 256 AS DOUBLE) AS b FROM supplier, (SELECT unnest(range(0, 30)) AS x), (SELECT unnest(range(0, 20)) AS y))"
_SIG = f"{_PX}, sg AS (SELECT image, CAST(len(list_filter([4, 8, 11, 15, 19, 23, 26, 30], lambda e: e <= x)) AS INTEGER) AS strip, CAST(row AS INTEGER) AS row, avg(0.65e0 * (0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) / 255e0 + 0.35e0 * greatest(0e0, least(1e0, 0.5e0 + (b - (r + g) / 2e0) / 255e0))) AS affinity FROM px GROUP BY 1, 2, 3)"
_OPEN = "CASE WHEN span >= 360 THEN 0e0 ELSE wide - CASE WHEN off < span THEN least(span - off, wide) ELSE 0e0 END - greatest(0e0, least(off + wide - 360e0, span)) END"

ORACLES = {
    "byte_segments": f"""WITH x AS (SELECT {P} % 5 AS key, {P} // 5 * 100 AS st, {P} // 5 * 100 + CASE WHEN {P} % 3 = 0 THEN 90 ELSE 100 END AS en, {P} // 5 * 100 + CASE WHEN {P} % 35 < 7 THEN 7 ELSE 0 END AS off FROM part),
y AS (SELECT *, CASE WHEN st = lag(en) OVER w AND off = lag(off) OVER w + lag(en) OVER w - lag(st) OVER w THEN 0 ELSE 1 END AS nw FROM x WINDOW w AS (PARTITION BY key ORDER BY st, off)), z AS (SELECT *, sum(nw) OVER (PARTITION BY key ORDER BY st, off) AS i FROM y)
SELECT key, min(st) AS start, max(en) AS "end", min(off) AS "offset" FROM z GROUP BY key, i""",
    "listed_parts": f"""WITH x AS (SELECT {P} % 7 AS key, 'part-' || lpad(CAST({P} AS VARCHAR), 5, '0') || ['.parquet', '.crc', '.zstd.parquet'][{P} % 3 + 1] AS name, {P} * 17 AS bytes FROM part WHERE {P} % 13 <> 4 AND {P} % 3 <> 1)
SELECT key, name, bytes, row_number() OVER (PARTITION BY key ORDER BY name) AS nth FROM x""",
    "sampling_grids": f"""WITH {s.OBSERVER}, x AS (SELECT observer_id AS key, lat, lon, -1 AS ray, 0 AS sample FROM g_observer UNION ALL SELECT observer_id, lat, lon, CAST(i AS INTEGER), CAST(j AS INTEGER) FROM g_observer, (SELECT unnest(range(0, 12)) AS i), (SELECT unnest(range(1, 6)) AS j))
SELECT key, ray, sample, round(lat + 5e0 * sample * cos(radians(30e0 * greatest(ray, 0))) / 110.574e0, 6) + 0e0 AS lat, round(lon + 5e0 * sample * sin(radians(30e0 * greatest(ray, 0))) / (111.32e0 * cos(radians(lat))), 6) + 0e0 AS lon FROM x""",
    "sweep_sectors": f"""WITH {s.OBSERVER}, x AS (SELECT observer_id, CAST((observer_id * 29) % 360 AS DOUBLE) AS h, least(360e0, (20e0 + observer_id * 9) * 2e0) AS sp FROM g_observer)
SELECT observer_id, sp AS spanDeg, round({s.fold('h - sp / 2e0')}, 4) + 0e0 AS startDeg, CAST(25 AS BIGINT) AS bearings, 50e0 AS lastDeg, CAST(331 AS BIGINT) AS ranges, 270e0 AS firstM, 29970e0 AS lastM FROM x""",
    "recorded_answers": f"""WITH rc AS (SELECT {P} % 150 AS g, CASE WHEN {P} % 9 = 2 THEN 503 ELSE 200 END AS status, 'b' || CAST({P} AS VARCHAR) AS body FROM part WHERE {P} % 4 <> 1), o AS (SELECT g, min(body) AS body, arg_min(status, body) AS status FROM rc GROUP BY g)
SELECT {P} AS k, status, body, CASE WHEN status IS NULL THEN 'fixture-missing' WHEN status NOT BETWEEN 200 AND 299 THEN 'http-status' END AS reason FROM part LEFT JOIN o ON o.g = {P}""",
    "echoed_heights": f"""WITH x AS (SELECT {P} AS k, {P} // 8 AS key, row_number() OVER (PARTITION BY {P} // 8 ORDER BY {P}) - 1 AS at0, count(*) OVER (PARTITION BY {P} // 8) AS n FROM part),
q AS (SELECT *, CASE WHEN key % 7 = 4 THEN 'bad-response' WHEN key % 5 = 2 AND n <> 1 THEN 'count-differs' WHEN k % 11 = 3 THEN 'not-echoed' WHEN k % 6 = 1 THEN 'no-data' END AS reason FROM x)
SELECT key, CAST(at0 AS INTEGER) AS "at", round(45e0 + k / 1000e0, 6) + 0e0 AS lat, round(7e0 + k / 500e0, 6) + 0e0 AS lon, CASE WHEN reason IS NULL THEN k * 1.5e0 END AS elevationM, reason FROM q""",
    "region_summary": """WITH x AS (SELECT lower(n_name) AS nm, n_nationkey AS i FROM nation), t AS (SELECT nm, 0 AS o, ['OpenMap', 'Survey', ' '][i % 3 + 1] AS t FROM x UNION ALL SELECT nm, 1, 'Source ' || CAST(i % 4 AS VARCHAR) FROM x),
f AS (SELECT t, min({'n': 'regions/' || nm || '/index.json', 'o': o}) AS k FROM t WHERE trim(t) <> '' GROUP BY t)
SELECT (SELECT string_agg(nm, ',' ORDER BY nm) FROM x) AS regions, (SELECT CAST(sum(CASE WHEN i % 6 <> 1 THEN i * 10 ELSE 0 END) AS BIGINT) FROM x) AS summits, (SELECT string_agg(t, '; ' ORDER BY k) FROM f) AS citations""",
    "gravity_samples": f"""WITH x AS (SELECT user_id AS device, event_id AS e, value AS v FROM events)
SELECT device, e AS ms, CASE WHEN {_G} THEN round((v - CASE WHEN {_CONT} THEN 0e0 ELSE 0.1e0 END) / 9.80665e0, 6) + 0e0 END AS x, CASE WHEN {_G} THEN round((v * 0.5e0 - CASE WHEN {_CONT} THEN 0e0 ELSE 0.2e0 END) / 9.80665e0, 6) + 0e0 END AS y,
  CASE WHEN {_G} THEN round((9.8e0 - CASE WHEN {_CONT} THEN 0e0 ELSE -0.1e0 END) / 9.80665e0, 6) + 0e0 END AS z, CASE WHEN {_G} THEN {_CONT} END AS contaminated, CASE WHEN e % 11 = 5 THEN 'no-gravity-channel' WHEN e % 17 = 3 THEN 'not-finite' END AS refusal FROM x""",
    "heading_samples": """WITH x AS (SELECT user_id AS device, event_id AS e, CASE WHEN event_id % 4 <> 1 AND value >= 0 THEN value END AS t, CASE WHEN event_id % 6 <> 1 AND event_id % 12 <> 5 AND value + 1 >= 0 THEN value + 1 END AS m FROM events)
SELECT device, e AS ms, round(t, 6) + 0e0 AS trueDeg, round(m, 6) + 0e0 AS magneticDeg, CASE WHEN t IS NOT NULL OR m IS NOT NULL THEN [-1e0, 50e0, 35e0, 20e0, -1e0, -1e0, -1e0][e % 7 + 1] END AS accuracyDeg, CASE WHEN t IS NULL AND m IS NULL THEN 'no-heading' END AS refusal FROM x""",
    "sensor_poses": """WITH x AS (SELECT c_custkey AS k, c_custkey % 3 <> 1 AS a FROM customer), y AS (SELECT *, a AND k % 2 = 0 AS h, a AND k % 5 <> 0 AS p, a AND k % 7 = 0 AS r FROM x)
SELECT k AS key, CASE WHEN h THEN 1e0 + k ELSE CAST(k % 360 AS DOUBLE) END AS headingDeg, CASE WHEN p THEN -2e0 ELSE CAST(k % 50 - 25 AS DOUBLE) END AS pitchDeg, CASE WHEN r THEN 3e0 ELSE 0e0 END AS rollDeg,
  array_to_string(list_filter([CASE WHEN h THEN 'heading' END, CASE WHEN p THEN 'pitch' END, CASE WHEN r THEN 'roll' END], lambda x: x IS NOT NULL), ',') AS applied FROM y""",
    "live_overlay": f"""WITH {s.OBSERVER}, {s.SUMMIT}, {s.SIGHTING}, tk AS (SELECT observer_id, t, {imaging.POSE} FROM g_observer, (SELECT unnest(range(0, 3)) AS t)),
o AS (SELECT *, h + t * 11e0 AS hh, least(360e0, hf * 1.5e0) AS wide, hf * 2e0 AS span, {s.fold('h - hf')} AS st FROM tk), u AS (SELECT *, {s.fold('hh - wide / 2e0 - st')} AS off FROM o), w AS (SELECT *, {_OPEN} AS lack FROM u),
posed AS (SELECT w.observer_id * 3 + w.t AS tick, g.id, g.bearingDeg, g.altitudeDeg, w.hh AS h, w.p, w.ro, w.hf, w.vf, w.lack FROM w JOIN g_seen g ON g.observer_id = w.observer_id WHERE lack <= 0), {imaging.AXES}
SELECT tick, id, CAST(NULL AS VARCHAR) AS reason, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y, inFrame, round(lack, 5) + 0e0 AS uncoveredDeg FROM fr
UNION ALL SELECT observer_id * 3 + t, NULL, 'resweep-needed', NULL, NULL, NULL, round(lack, 5) + 0e0 FROM w WHERE lack > 0""",
    "drags": """WITH x AS (SELECT c_custkey AS k, CAST((c_custkey * 37) % 1600 AS DOUBLE) AS a, CAST((c_custkey * 91) % 1600 AS DOUBLE) AS b, CAST(c_custkey % 90 AS DOUBLE) AS f FROM customer)
SELECT k, round(CASE WHEN f > 0 THEN -(degrees(atan((b - 800e0) / 800e0 * tan(radians(f / 2e0)))) - degrees(atan((a - 800e0) / 800e0 * tan(radians(f / 2e0))))) ELSE 0e0 END, 4) + 0e0 AS headingTrimDeg, round(degrees(atan((b - 800e0) / 800e0 * tan(radians(60e0) / 2e0))), 4) + 0e0 AS fromCentreDeg FROM x""",
    "column_signals": f"WITH {_SIG} SELECT image, strip, row, round(affinity, 6) + 0e0 AS affinity FROM sg",
    "refined_rows": f"""WITH {_SIG}, sc AS (SELECT image, strip, row, CAST(floor(affinity * 1000) AS BIGINT) AS bt FROM sg), ch AS (SELECT image, strip, CAST((image + strip * 3) % 20 AS INTEGER) AS c FROM sg WHERE row = 9)
SELECT image, strip, row FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.image, sc.strip ORDER BY bt DESC, abs(row - c), row) AS n FROM sc JOIN ch ON ch.image = sc.image AND ch.strip = sc.strip AND row BETWEEN c - 3 AND c + 3 WHERE row = c OR bt % 5 > 0) WHERE n = 1""",
}
