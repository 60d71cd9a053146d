"""Queries over overlays and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import camera as cam
from ridgeline.functions.geodesy import num
from ridgeline.operators import classic as old
from ridgeline.operators import backdrop as bd
from ridgeline.operators import overlay as ov
from ridgeline.operators import profiles as pf
from ridgeline.operators import raster as ra
from ridgeline.operators import skyline as sk
from ridgeline.operators import visibility as v
from ridgeline.plans import imaging
from ridgeline.plans import sqltext as s
from ridgeline.plans.catalog import pick
from ridgeline.plans.scene import r
from ridgeline.sources import views

FRAME = ov.Frame()
KINDS = ["visible", "marginal", "self-occluded", "foreground-occluded"]


def k() -> Column:
    return F.col("p_partkey")


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings with a verdict of every kind, as each observer's camera sees them."""
    seen = v.sightings(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.RADIUS_KM)
    at = cam.project(*imaging._pose(), F.col("bearingDeg"), F.col("altitudeDeg"))
    verdict = pick(KINDS, F.expr("cast(substring(id, 2) as bigint)") + F.col("observer_id"))
    return seen.select("observer_id", "id", "name", "altitudeDeg", "distanceKm", "elevationM", verdict.alias("visibility"), at["x"].alias("x"), at["y"].alias("y"), at["inFrame"].alias("inFrame"))


def drawn_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many summits of each observer are drawn with and without obscured ones, labelled and obscured."""
    p, cols = _peaks(spark, sf_dir), ["observer_id"]
    counts = p.groupBy(*cols).agg(F.count("*").alias("all"), F.count_if(ov.labelled(F.col("visibility"))).alias("labelled"), F.count_if(ov.obscured(F.col("visibility"))).alias("obscured"))
    return counts.join(ov.drawn(p, False).groupBy(*cols).agg(F.count("*").alias("drawn")), cols, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))


def label_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occluded, off-frame, candidate and crowded-out summits with their ranks and budgets."""
    out = ov.partition(_peaks(spark, sf_dir), FRAME)
    shown = F.col("status").isin("candidate", "crowded-out")
    return out.select("observer_id", "id", "status", "detail", *[F.when(shown, F.col(c)).alias(c) for c in ("rank", "budget")], r(F.when(shown, F.col("labelWidthPx")), 3).alias("labelWidthPx"))


def label_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every summit's place in the overlay (greedy, so not in SQL; tests hold it against a plain placement)."""
    out = ov.layout(_peaks(spark, sf_dir), FRAME)
    return out.select("observer_id", "id", "status", "direction", "level", r("boxX", 3).alias("boxX"), r("boxY", 3).alias("boxY"), "overlapped")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observer_id, at, xPx, yPx: each observer's skyline at 241 bearings over three quarters of the view, interpolated and projected."""
    profile = v.horizon_profile(views.rays(spark, sf_dir)).select("observer_id", "bearingDeg", F.col("altitudeDeg").alias("angleDeg"))
    h, p, ro, hf, vf = imaging._pose()
    half = F.least(hf * num(0.75), num(85))
    bearings = F.transform(F.sequence(F.lit(0), F.lit(240)), lambda i: h - half + i * half / num(120))
    asked = views.observers(spark, sf_dir).select("observer_id", F.posexplode(bearings).alias("at", "bearing"))
    at = asked.select("observer_id", F.col("at").alias("id"), "bearing", num(0).alias("angle"))
    found = old.interpolated(at, profile).select("observer_id", F.col("id").alias("at"), "bearing", "horizonDeg")
    on = cam.project(h, p, ro, hf, vf, F.col("bearing"), F.col("horizonDeg"))
    return found.select("observer_id", "at", (on["x"] * FRAME.width_px).alias("xPx"), (on["y"] * FRAME.height_px).alias("yPx"))


def horizon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each observer's skyline inside the frame."""
    lines = ov.clipped_lines(line_points(spark, sf_dir), FRAME.width_px, FRAME.height_px)
    return lines.select("observer_id", F.col("first").cast("long").alias("first"), "segments", r("length", 2).alias("length"))


def horizon_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs as lists of points."""
    lines = bd.polylines(line_points(spark, sf_dir), FRAME.width_px, FRAME.height_px)
    rounded = F.transform("points", lambda p: F.struct(r(p["x"], 1).alias("x"), r(p["y"], 1).alias("y")))
    return lines.select("observer_id", F.col("first").cast("long").alias("first"), bd.point_list(rounded).alias("points"))


def backdrop_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silhouettes in each observer's drawn backdrop, in the order of the sweep, and how long the document's other lines are."""
    lines = bd.polylines(line_points(spark, sf_dir), FRAME.width_px, FRAME.height_px)
    lines = lines.withColumn("points", F.transform("points", lambda p: F.struct(r(p["x"], 1).alias("x"), r(p["y"], 1).alias("y"))))
    names = views.observers(spark, sf_dir).select("observer_id", F.concat(F.lit("view <"), F.col("observer_id").cast("string"), F.lit(">")).alias("caption"))
    svg = F.split("svg", "\n")
    drawn, rest = F.filter(svg, lambda x: x.startswith("<polygon")), F.filter(svg, lambda x: ~x.startswith("<polygon"))
    return bd.backdrops(lines, names, FRAME).select("observer_id", F.array_join(drawn, "\n").alias("silhouettes"), F.size(rest).alias("lines"), F.contains("svg", F.concat(F.lit("view &lt;"), F.col("observer_id").cast("string"), F.lit("&gt;"))).alias("captioned"))


def normalised_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each bearing, one a turn further on and without steps, merged."""
    p = v.horizon_profile(views.rays(spark, sf_dir))
    steps = F.transform("steps", lambda s: F.struct((s["distanceM"] / num(1000)).alias("distanceKm"), s["altitudeDeg"].alias("altitudeDeg"), s["elevationM"].alias("elevationM")))
    none = F.lit(None).cast("array<struct<distanceKm:double,altitudeDeg:double,elevationM:double>>")
    a = p.select("observer_id", "bearingDeg", "distanceKm", "altitudeDeg", "elevationM", steps.alias("steps"), F.lit(0).alias("ord"))
    near = F.when(F.col("bearingDeg") % 3 == 0, F.col("distanceKm")).otherwise(F.col("distanceKm") / num(2))
    b = p.select("observer_id", (F.col("bearingDeg") + 360).alias("bearingDeg"), near.alias("distanceKm"), (F.col("altitudeDeg") - (F.col("bearingDeg") % 4 - 2) * num(0.25)).alias("altitudeDeg"), (F.col("elevationM") + 1).alias("elevationM"), none.alias("steps"), F.lit(1).alias("ord"))
    out = pf.normalised_profile(a.unionByName(b))
    first, last = pf.point_at(F.col("steps"), F.lit(0)), pf.point_at(F.col("steps"), F.size("steps") - 1)
    return out.select("observer_id", "bearingDeg", r("altitudeDeg").alias("altitudeDeg"), r("distanceKm").alias("distanceKm"), r("elevationM", 3).alias("elevationM"), F.size("steps").cast("long").alias("steps"), r(first["distanceKm"]).alias("firstKm"), r(last["altitudeDeg"]).alias("lastDeg"))


def occluder_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before each summit on the nearest measured bearing."""
    seen = v.sightings(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.RADIUS_KM)
    profile = v.horizon_profile(views.rays(spark, sf_dir))
    near = v.bracketed(seen, profile)
    steps = F.transform("steps", lambda s: F.struct((s["distanceM"] / num(1000)).alias("distanceKm"), s["altitudeDeg"].alias("altitudeDeg"), s["elevationM"].alias("elevationM")))
    rays = profile.select("observer_id", F.col("bearingDeg").alias("nearest"), steps.alias("steps"))
    out = near.join(rays, ["observer_id", "nearest"]).withColumn("o", pf.occluder(F.col("steps"), F.col("distanceKm"), F.col("altitudeDeg")))
    return out.select("observer_id", "id", F.col("nearest").alias("rayBearingDeg"), r("o.distanceKm").alias("distanceKm"), r("o.altitudeDeg").alias("altitudeDeg"), r("o.elevationM", 3).alias("elevationM"))


def pose_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of sightings turned and tilted; whether a gap covers them; the span that a search looks over."""
    seen = v.sightings(views.observers(spark, sf_dir), views.summits(spark, sf_dir), views.RADIUS_KM)
    h, _, _, hf, _ = imaging._pose()
    moved = ov.pose_offset(cam.direction(F.col("bearingDeg"), F.col("altitudeDeg")), h, (F.col("observer_id") % 9 - 4).cast("double"), (F.col("observer_id") % 5 - 2) * num(0.7))
    a, b = ov.searched_span(h, hf, num(12))
    o = F.col("observer_id")
    gap = ov.covers_bearing(F.when(o % 3 != 0, num(340)), F.when(o % 3 != 0, num(25)), F.col("bearingDeg"))
    return seen.select("observer_id", "id", *[r(x, 6).alias(n) for n, x in zip("enu", moved, strict=True)], gap.alias("covered"), r(a).alias("fromDeg"), r(b).alias("toDeg"))


def pose_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured errors of poses from different sources."""
    heading, pitch = pick(["exif", "user", "missing"], k()), F.when(k() % 4 == 1, "user").otherwise("default")
    hf, vf = (k() % 130).cast("double"), (k() % 7).cast("double")
    out = ov.pose_uncertainty(heading, pitch, hf, vf, num(4000), num(3000))
    return views.table(spark, sf_dir, "part").select(k().alias("k"), *[(x if n == "hasUnquantified" else r(x, 5)).alias(n) for n, x in out.items()])


def overlay_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of names, notes, labels as SVG, credits, file names and alignment lines."""
    names = F.transform(F.sequence(F.lit(1), (k() % 7 + 1).cast("int")), lambda i: F.concat(F.lit("P"), i.cast("string")))
    raw = F.concat(F.col("p_name"), pick(["", " <&>", "'\"", "\x01x"], k()))
    holders, pubs, origins = F.slice(F.array(F.lit("Ann"), F.lit("Bo")), 1, (k() % 3).cast("int")), F.slice(F.array(F.lit("Site")), 1, (k() % 2).cast("int")), F.array(F.lit("origin"))
    licence = F.when(k() % 5 != 0, pick(["ODbL-1.0", "CC-BY-4.0"], k()))
    x, y = (k() * 37 % 1600) - num(0.125), (k() * 91 % 1200) + num(0.0049)
    text = ov.alignment_text(pick(["failed", "low-confidence", "aligned"], k()), k() / num(37), -k() / num(19), (k() % 100) / num(131), pick(["no-skyline", "rival"], k()))
    return views.table(spark, sf_dir, "part").select(
        k().alias("k"), ov.name_list(names).alias("names"), ov.name_list(names, 5, '"').alias("quoted"), ov.crowding_text(k() % 4).alias("crowding"), ov.svg_label(x, y, raw, F.lit("1 m")).alias("svg"),
        ov.credit_line(holders, licence, pubs, origins).alias("credit"), ov.obligation(k() % 2 == 0, licence).alias("obligation"), ov.annotated_name(pick(["a.jpg", "b.c.HEIC", ".png", "d/e.x/f", "g"], k())).alias("file"), text.alias("alignment"),
    )


def scene_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each observer's overlay says about summits without a verdict or a place."""
    p = _peaks(spark, sf_dir)
    kind = F.when(~F.col("inFrame"), "off-frame").otherwise(F.col("visibility"))
    return ov.scene_notes(p.select("observer_id", F.concat("name", F.lit(" "), "id").alias("name"), kind.alias("kind")))


def svg_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of the frame's labels for each observer."""
    p = ov.partition(_peaks(spark, sf_dir), FRAME).where("status = 'candidate'")
    return ov.svg_documents(p.select("observer_id", F.lit(1).alias("layer"), F.col("rank").alias("at"), ov.svg_label(F.round("xPx", 1), F.round("yPx", 1), F.col("name"), F.col("detail")).alias("svg")), FRAME)


def empty_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said where a tile is not held."""
    from ridgeline.functions.geodesy import cell_name

    o = views.observers(spark, sf_dir)
    held = F.slice(F.array(*[F.lit(f"N4{i}E00{i}") for i in range(8)]), 1, (F.col("observer_id") % 9).cast("int"))
    return o.select("observer_id", ov.no_terrain_text(F.col("lat"), F.col("lon"), cell_name(F.col("lat"), F.col("lon")), held).alias("text"))


def analytic_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form skylines around every observer's heading."""
    o = views.observers(spark, sf_dir).select(F.col("observer_id").alias("key"), (F.col("observer_id") * 15).cast("double").alias("centreDeg"))
    out = pf.analytic_profile(o, 60, 0.5, 3.0, [(-18, 4, 5.5), (-2, 1.6, 9), (14, 7, 3)])
    return out.select("key", r("bearingDeg").alias("bearingDeg"), r("altitudeDeg", 5).alias("altitudeDeg"), r("elevationM", 2).alias("elevationM"))


def skyline_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable columns of skylines as directions."""
    c = F.col("c_custkey")
    columns = views.table(spark, sf_dir, "customer").select(
        c.alias("image"), (c % 101 / num(100)).alias("xNorm"), F.when(c % 6 != 1, c % 89 / num(88)).alias("rowNorm"), (c % 10 / num(10)).alias("confidence"),
        (c % 360).cast("double").alias("headingDeg"), (c % 11 - 5).cast("double").alias("pitchDeg"), num(0).alias("rollDeg"), num(66).alias("hFovDeg"), num(45).alias("vFovDeg"),
    )
    out = sk.observations(columns, 0.3)
    return out.select("image", r("bearingDeg").alias("bearingDeg"), r("altitudeDeg").alias("altitudeDeg"), "weight")


def nearest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the summits by the nearest sample of a grid with voids."""
    grid = spark.range(0, 51).select(F.col("id").cast("int").alias("row")).select("row", F.explode(F.sequence(F.lit(0), F.lit(50))).alias("col"))
    samples = grid.select("row", "col", F.when((F.col("row") * 7 + F.col("col") * 3) % 23 != 4, (F.col("row") * 100 + F.col("col")).cast("double")).alias("elevationM"))
    points = views.summits(spark, sf_dir).select(F.col("id").alias("point_id"), "lat", "lon")
    return ra.read(points, samples, 46.0, 7.0, 0.02, 51, 51, "nearest")


def areas_of_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summits in circles of different sizes, some of them empty."""
    i = F.col("observer_id")
    areas = views.observers(spark, sf_dir).select(i.alias("key"), (F.col("lat") + F.when(i % 7 == 3, num(9)).otherwise(num(0))).alias("lat"), "lon", (num(5) + i).alias("radiusKm"))
    return v.peaks_for(areas, views.summits(spark, sf_dir)).select("key", "id", r("distanceM", 3).alias("distanceM"), "nth", "reason")


_ALL = (drawn_peaks, label_partition, label_layout, horizon_lines, horizon_polylines, backdrop_silhouettes, normalised_profile, occluder_notes, pose_offsets, pose_uncertainties, overlay_texts, scene_notes, svg_overlays, empty_terrain, analytic_profiles, skyline_observations, nearest_readings, areas_of_peaks)
QUERIES = {f.__name__: f for f in _ALL}

P = "p_partkey"
_KIND = "['visible', 'marginal', 'self-occluded', 'foreground-occluded'][CAST((CAST(substring(id, 2) AS BIGINT) + observer_id) % 4 AS INTEGER) + 1]"
POSED = f"{s.OBSERVER}, {s.SUMMIT}, {s.SIGHTING}, posed AS (SELECT s.*, p.name, {imaging.POSE} FROM g_seen s JOIN g_summit p ON p.id = s.id), {imaging.AXES}, v AS (SELECT *, {_KIND} AS visibility FROM fr)"
_DETAIL = "CAST(CAST(floor(elevationM + 0.5e0) AS BIGINT) AS VARCHAR) || ' m · ' || printf('%.1f', distanceM / 1000e0) || ' km' || CASE visibility WHEN 'marginal' THEN ' · may be hidden' WHEN 'self-occluded' THEN ' · summit obscured' ELSE '' END"
_SEEN = f"{s.OBSERVER}, {s.SUMMIT}, {s.SIGHTING}"
_TURNED = "e0 * cos(radians(tn)) + n1 * sin(radians(tn)) AS e, n1 * cos(radians(tn)) - e0 * sin(radians(tn)) AS n, u1 AS u"
_H, _HF = "CAST((observer_id * 29) % 360 AS DOUBLE)", "(60e0 + observer_id % 20)"
_XML = "replace(replace(replace(replace(replace(regexp_replace(nm, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def _coordinate(x: str) -> str:
    return f"regexp_replace(CAST(floor({x} * 100e0 + 0.5e0) / 100e0 + 0e0 AS VARCHAR), '\\.0$', '')"


def _names(most: int, quote: str) -> str:
    shown = f"array_to_string(list_transform(range(1, least(c, {most}) + 1), lambda i: '{quote}P' || CAST(i AS VARCHAR) || '{quote}'), ', ')"
    return f"{shown} || CASE WHEN c > {most} THEN ' and ' || CAST(c - {most} AS VARCHAR) || ' more' ELSE '' END"


ORACLES = {
    "drawn_peaks": f"""WITH {POSED} SELECT observer_id, count(*) AS "all", count(*) FILTER (visibility <> 'foreground-occluded') AS labelled, count(*) FILTER (visibility IN ('self-occluded', 'marginal')) AS obscured, count(*) FILTER (visibility <> 'self-occluded') AS drawn FROM v GROUP BY observer_id""",
    "label_partition": f"""WITH {POSED}, d AS (SELECT *, CASE WHEN visibility = 'foreground-occluded' THEN 'occluded' WHEN NOT inFrame THEN 'off-frame' ELSE 'candidate' END AS st, {_DETAIL} AS detail FROM v),
w AS (SELECT *, greatest({imaging._width('name')} * {FRAME.name_px}e0, {imaging._width('detail')} * {FRAME.detail_px}e0) + {2 * FRAME.padding_px}e0 AS w FROM d),
b AS (SELECT *, CAST(greatest(1, floor(0.75e0 * greatest(1e0, floor({FRAME.width_px - 2 * FRAME.margin_px}e0 / avg(w) OVER (PARTITION BY observer_id, st))) * {FRAME.reachable}e0)) AS BIGINT) AS budget,
  row_number() OVER (PARTITION BY observer_id, st ORDER BY altitudeDeg DESC, elevationM DESC, id) AS rank FROM w)
SELECT observer_id, id, CASE WHEN st = 'candidate' AND rank > budget THEN 'crowded-out' ELSE st END AS status, detail, CASE WHEN st = 'candidate' THEN rank END AS rank, CASE WHEN st = 'candidate' THEN budget END AS budget, CASE WHEN st = 'candidate' THEN round(w, 3) + 0e0 END AS labelWidthPx FROM b""",
    "normalised_profile": f"""WITH {s.OBSERVER}, {s.RAY}, {s.STAIRS}, tp AS (SELECT observer_id, bearingDeg AS b, max(alt) AS alt, max(distanceM) / 1000e0 AS km, arg_max(elevationM, distanceM) AS el FROM g_step GROUP BY 1, 2),
other AS (SELECT observer_id, b, CASE WHEN b % 3 = 0 THEN km ELSE km / 2e0 END AS km, alt - (b % 4 - 2) * 0.25e0 AS alt, el + 1 AS el FROM tp),
pt AS (SELECT observer_id, b, km, alt, el, 0 AS ord FROM tp UNION ALL SELECT *, 1 FROM other), win AS (SELECT *, row_number() OVER (PARTITION BY observer_id, b ORDER BY alt DESC, ord) AS nth FROM pt),
st AS (SELECT observer_id, bearingDeg AS b, distanceM / 1000e0 AS km, alt, elevationM AS el, 0 AS ord FROM g_step UNION ALL SELECT *, 1 FROM other),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observer_id, b, km ORDER BY alt DESC, ord) AS nth FROM st) WHERE nth = 1),
up AS (SELECT *, max(alt) OVER (PARTITION BY observer_id, b ORDER BY km ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM one),
un AS (SELECT observer_id, b, count(*) AS steps, min(km) AS firstKm, max(alt) AS lastDeg FROM up WHERE hi IS NULL OR alt > hi GROUP BY 1, 2)
SELECT w.observer_id, w.b AS bearingDeg, round(w.alt, 4) + 0e0 AS altitudeDeg, round(w.km, 4) + 0e0 AS distanceKm, round(w.el, 3) + 0e0 AS elevationM, steps, round(firstKm, 4) + 0e0 AS firstKm, round(lastDeg, 4) + 0e0 AS lastDeg FROM win w JOIN un u ON u.observer_id = w.observer_id AND u.b = w.b WHERE nth = 1""",
    "occluder_notes": f"""WITH {_SEEN}, {s.RAY}, {s.STAIRS}, pr AS (SELECT DISTINCT observer_id, bearingDeg FROM g_step),
nr AS (SELECT k.observer_id, k.id, any_value(k.distanceM) / 1000e0 AS km, any_value(k.altitudeDeg) AS alt, arg_min(p.bearingDeg, {{'sep': abs({s.angdiff('p.bearingDeg', 'k.bearingDeg')}), 'b': p.bearingDeg}}) AS b FROM g_seen k JOIN pr p ON p.observer_id = k.observer_id GROUP BY 1, 2),
st AS (SELECT n.*, s.distanceM / 1000e0 AS skm, s.alt AS salt, s.elevationM AS el FROM nr n LEFT JOIN g_step s ON s.observer_id = n.observer_id AND s.bearingDeg = n.b AND s.distanceM / 1000e0 < n.km),
rk AS (SELECT *, row_number() OVER (PARTITION BY observer_id, id ORDER BY CASE WHEN salt >= alt THEN 0 ELSE 1 END, CASE WHEN salt >= alt THEN skm END, salt DESC, skm) AS nth FROM st)
SELECT observer_id, id, b AS rayBearingDeg, round(skm, 4) + 0e0 AS distanceKm, round(salt, 4) + 0e0 AS altitudeDeg, round(el, 3) + 0e0 AS elevationM FROM rk WHERE nth = 1""",
    "pose_offsets": f"""WITH {_SEEN}, d AS (SELECT observer_id, id, bearingDeg, sin(radians(bearingDeg)) * cos(radians(altitudeDeg)) AS de, cos(radians(bearingDeg)) * cos(radians(altitudeDeg)) AS dn, sin(radians(altitudeDeg)) AS du, {_H} AS h, {_HF} AS hf,
  CAST(observer_id % 9 - 4 AS DOUBLE) AS tn, (observer_id % 5 - 2) * 0.7e0 AS ti FROM g_seen),
a AS (SELECT *, cos(radians(h)) AS ae, -sin(radians(h)) AS an, cos(radians(h)) * de - sin(radians(h)) * dn AS al FROM d),
t AS (SELECT *, de * cos(radians(ti)) + an * du * sin(radians(ti)) + ae * al * (1e0 - cos(radians(ti))) AS e0, dn * cos(radians(ti)) - ae * du * sin(radians(ti)) + an * al * (1e0 - cos(radians(ti))) AS n1, du * cos(radians(ti)) + (ae * dn - an * de) * sin(radians(ti)) AS u1 FROM a),
z AS (SELECT *, {_TURNED} FROM t)
SELECT observer_id, id, round(e, 6) + 0e0 AS e, round(n, 6) + 0e0 AS n, round(u, 6) + 0e0 AS u, observer_id % 3 = 0 OR NOT ({s.fold('bearingDeg - 340e0')} > 0 AND {s.fold('bearingDeg - 340e0')} < 45) AS covered, round(h - hf / 2e0 - 12e0, 4) + 0e0 AS fromDeg, round(h + hf / 2e0 + 12e0, 4) + 0e0 AS toDeg FROM z""",
    "pose_uncertainties": f"""WITH x AS (SELECT {P} AS k, {P} % 3 = 0 AS ex, {P} % 4 = 1 AS us, CAST({P} % 130 AS DOUBLE) AS hf, CAST({P} % 7 AS DOUBLE) AS vf FROM part), y AS (SELECT *, CASE WHEN ex THEN 0.6e0 ELSE 0e0 END AS a, CASE WHEN us THEN 0e0 ELSE 3.5e0 END AS u FROM x)
SELECT k, a AS acrossDeg, u AS upDeg, round(CASE WHEN hf <= 0 OR a <= 0 THEN 0e0 WHEN a >= hf / 2e0 THEN 1e0 ELSE least(1e0, tan(radians(a)) / tan(radians(hf / 2e0))) END, 5) + 0e0 AS acrossShare, round(CASE WHEN vf <= 0 OR u <= 0 THEN 0e0 WHEN u >= vf / 2e0 THEN 1e0 ELSE least(1e0, tan(radians(u)) / tan(radians(vf / 2e0))) END, 5) + 0e0 AS upShare,
  round(CASE WHEN hf > 0 THEN 2000e0 * radians(1e0) / tan(radians(hf / 2e0)) ELSE 0e0 END, 5) + 0e0 AS acrossPxPerDeg, round(CASE WHEN vf > 0 THEN 1500e0 * radians(1e0) / tan(radians(vf / 2e0)) ELSE 0e0 END, 5) + 0e0 AS upPxPerDeg, NOT ex OR us AS hasUnquantified FROM y""",
    "overlay_texts": f"""WITH x AS (SELECT {P} AS k, {P} % 7 + 1 AS c, p_name || ['', ' <&>', '''"', chr(1) || 'x'][{P} % 4 + 1] AS nm, CASE WHEN {P} % 5 <> 0 THEN ['ODbL-1.0', 'CC-BY-4.0'][{P} % 2 + 1] END AS li, ({P} * 37) % 1600 - 0.125e0 AS px, ({P} * 91) % 1200 + 0.0049e0 AS py FROM part),
m AS (SELECT *, ['', '© Ann', '© Ann, © Bo'][k % 3 + 1] AS held, 'heading ' || printf('%.2f', k / 37e0) || '°, pitch ' || printf('%.2f', -k / 19e0) || '° (confidence ' || printf('%.0f', (k % 100) / 131e0 * 100e0) || ' %' AS ms, ['no-skyline', 'rival'][k % 2 + 1] AS wd FROM x)
SELECT k, {_names(4, '')} AS names, {_names(5, '"')} AS quoted, CASE WHEN k % 4 > 0 THEN '+' || CAST(k % 4 AS VARCHAR) || ' more named summit' || CASE WHEN k % 4 = 1 THEN '' ELSE 's' END || ' in this frame — marked, too crowded to label' END AS crowding,
  '<g><text x="' || {_coordinate('px')} || '" y="' || {_coordinate('py')} || '">' || {_XML} || '</text><text x="' || {_coordinate('px')} || '" y="' || {_coordinate('py')} || '" dy="1.15em">1 m</text></g>' AS svg,
  CASE WHEN held <> '' THEN held || coalesce(', ' || li, '') || CASE WHEN k % 2 = 1 THEN ', via Site' ELSE '' END ELSE CASE WHEN k % 2 = 1 THEN 'Site' ELSE 'origin' END || coalesce(' — ' || li, '') END AS credit,
  CASE WHEN k % 2 = 0 THEN 'Attribution required by ' || coalesce(li, 'the licence') || '.' WHEN li IS NOT NULL THEN 'Credit is courtesy, not a condition.' ELSE 'Cited facts, no licence attached — credit is courtesy.' END AS obligation,
  ['a', 'b.c', 'photo', 'd/e.x/f', 'g'][k % 5 + 1] || '-annotated.png' AS file, CASE k % 3 WHEN 0 THEN 'no alignment (' || wd || ')' WHEN 1 THEN 'tentative: ' || ms || ', concerns: ' || wd || ')' ELSE ms || ')' END AS alignment FROM m""",
}
_SEGMENTS = """seg AS (SELECT observer_id, b AS lo, a AS la, coalesce(lead(b) OVER w, min(b) OVER (PARTITION BY observer_id) + 360e0) AS hi, coalesce(lead(a) OVER w, first_value(a) OVER w) AS ha
  FROM (SELECT observer_id, bearingDeg AS b, max(alt) AS a FROM g_step GROUP BY 1, 2) WINDOW w AS (PARTITION BY observer_id ORDER BY b))"""
ORACLES["horizon_lines"] = f"""WITH {s.OBSERVER}, {s.RAY}, {s.STAIRS}, {_SEGMENTS},
ask AS (SELECT observer_id, ix, {_H} - least({_HF} * 0.75e0, 85e0) + ix * least({_HF} * 0.75e0, 85e0) / 120e0 AS bearingDeg FROM g_observer, (SELECT unnest(range(0, 241)) AS ix)),
fa AS (SELECT *, {s.fold('bearingDeg')} AS t FROM ask), un AS (SELECT f.*, s.la + (CASE WHEN t < lo THEN t + 360e0 ELSE t END - lo) / (hi - lo) * (ha - la) AS altitudeDeg FROM fa f JOIN seg s ON s.observer_id = f.observer_id AND CASE WHEN t < lo THEN t + 360e0 ELSE t END >= lo AND CASE WHEN t < lo THEN t + 360e0 ELSE t END < hi),
posed AS (SELECT *, {imaging.POSE} FROM un), {imaging.AXES}, px AS (SELECT observer_id, ix, x * 1600e0 AS ax, y * 1200e0 AS ay FROM xy), pr AS (SELECT *, lead(ax) OVER w AS bx, lead(ay) OVER w AS b_y FROM px WINDOW w AS (PARTITION BY observer_id ORDER BY ix)),
d AS (SELECT *, bx - ax AS dx, b_y - ay AS dy FROM pr),
t AS (SELECT *, greatest(0e0, CASE WHEN dx > 0 THEN -ax / dx WHEN dx < 0 THEN (1600e0 - ax) / dx ELSE 0e0 END, CASE WHEN dy > 0 THEN -ay / dy WHEN dy < 0 THEN (1200e0 - ay) / dy ELSE 0e0 END) AS t0,
  least(1e0, CASE WHEN dx < 0 THEN -ax / dx WHEN dx > 0 THEN (1600e0 - ax) / dx ELSE 1e0 END, CASE WHEN dy < 0 THEN -ay / dy WHEN dy > 0 THEN (1200e0 - ay) / dy ELSE 1e0 END) AS t1, (dx = 0 AND (ax < 0 OR ax > 1600)) OR (dy = 0 AND (ay < 0 OR ay > 1200)) AS gone FROM d),
c AS (SELECT observer_id, ix, CASE WHEN NOT gone AND t0 <= t1 THEN ax + t0 * dx END AS x0, CASE WHEN NOT gone AND t0 <= t1 THEN ay + t0 * dy END AS y0, CASE WHEN NOT gone AND t0 <= t1 THEN ax + t1 * dx END AS x1, CASE WHEN NOT gone AND t0 <= t1 THEN ay + t1 * dy END AS y1 FROM t),
j AS (SELECT *, CASE WHEN coalesce(abs(lag(x1) OVER w - x0) <= 1e-9 AND abs(lag(y1) OVER w - y0) <= 1e-9, false) THEN 0 ELSE 1 END AS nw FROM c WINDOW w AS (PARTITION BY observer_id ORDER BY ix)),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY observer_id ORDER BY ix) AS run FROM j)
SELECT observer_id, min(ix) AS first, count(*) AS segments, round(sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))), 2) + 0e0 AS length FROM rn WHERE x0 IS NOT NULL AND NOT (abs(x1 - x0) <= 1e-9 AND abs(y1 - y0) <= 1e-9) GROUP BY observer_id, run"""

_RUNS, _HELD = ORACLES["horizon_lines"].rsplit("SELECT", 1)[0], "x0 IS NOT NULL AND NOT (abs(x1 - x0) <= 1e-9 AND abs(y1 - y0) <= 1e-9)"
_PAIR = {k: f"{_coordinate(f'round(x{k}, 1)')} || ',' || {_coordinate(f'round(y{k}, 1)')}" for k in (0, 1)}
_LISTS = f"""{_RUNS}, pl AS (SELECT observer_id, min(ix) AS first, arg_min({_PAIR[0]}, ix) || ' ' || string_agg({_PAIR[1]}, ' ' ORDER BY ix) AS points,
  {_coordinate("round(arg_max(x1, ix), 1)")} || ',1200 ' || {_coordinate("round(arg_min(x0, ix), 1)")} || ',1200' AS foot FROM rn WHERE {_HELD} GROUP BY observer_id, run)"""
ORACLES["horizon_polylines"] = f"{_LISTS} SELECT observer_id, first, points FROM pl"
ORACLES["backdrop_silhouettes"] = f"""{_LISTS}, ln AS (SELECT observer_id, string_agg('<polygon points="' || points || ' ' || foot || '" fill="{bd.ROCK}"/>', chr(10) ORDER BY first) AS s FROM pl GROUP BY observer_id)
SELECT o.observer_id, coalesce(s, '') AS silhouettes, 10 AS lines, true AS captioned FROM g_observer o LEFT JOIN ln USING (observer_id)"""

ORACLES |= {
    "scene_notes": f"""WITH {POSED}, x AS (SELECT observer_id, name || ' ' || id AS nm, CASE WHEN NOT inFrame THEN 'off-frame' ELSE visibility END AS kind FROM v),
y AS (SELECT observer_id, kind, count(*) AS n, list_sort(list(nm)) AS l FROM x WHERE kind IN ('off-frame', 'foreground-occluded', 'marginal') GROUP BY 1, 2)
SELECT observer_id, kind, CAST(n AS VARCHAR) || CASE WHEN n = 1 THEN ' summit ' ELSE ' summits ' END || CASE kind WHEN 'off-frame' THEN 'outside this frame, not drawn' WHEN 'marginal' THEN 'may or may not clear the ground in front' ELSE 'hidden behind nearer, different hills' END
  || ': ' || array_to_string(l[1:4], ', ') || CASE WHEN n > 4 THEN ' and ' || CAST(n - 4 AS VARCHAR) || ' more' ELSE '' END AS note FROM y""",
    "empty_terrain": f"""WITH {s.OBSERVER}, x AS (SELECT *, observer_id % 9 AS h, {s.cell('lat', 'lon')} AS tile FROM g_observer)
SELECT observer_id, 'No terrain at ' || printf('%.5f', lat) || ', ' || printf('%.5f', lon) || ': tile ' || tile || ' is not held. ' || CASE WHEN h = 0 THEN 'Nothing is held at all.' ELSE 'Held: ' ||
  array_to_string(list_transform(range(0, least(h, 6)), lambda i: 'N4' || CAST(i AS VARCHAR) || 'E00' || CAST(i AS VARCHAR)), ', ') || CASE WHEN h > 6 THEN ' and ' || CAST(h - 6 AS VARCHAR) || ' more' ELSE '' END || '.' END AS text FROM x""",
    "analytic_profiles": f"""WITH {s.OBSERVER}, x AS (SELECT observer_id AS key, observer_id * 15 AS c, -60e0 + i * 0.5e0 AS o FROM g_observer, (SELECT unnest(range(0, 241)) AS i)),
y AS (SELECT *, 3e0 + 5.5e0 * exp(-0.5e0 * pow((o + 18e0) / 4e0, 2)) + 9e0 * exp(-0.5e0 * pow((o + 2e0) / 1.6e0, 2)) + 3e0 * exp(-0.5e0 * pow((o - 14e0) / 7e0, 2)) AS a FROM x)
SELECT key, round({s.fold('c + o')}, 4) + 0e0 AS bearingDeg, round(a, 5) + 0e0 AS altitudeDeg, round(10000e0 * tan(radians(a)), 2) + 0e0 AS elevationM FROM y""",
    "nearest_readings": f"""WITH {s.SUMMIT}, x AS (SELECT id, (46e0 - lat) / 0.02e0 AS r, (CASE WHEN lon - 7e0 >= 0 THEN lon - 7e0 ELSE lon + 353e0 END) / 0.02e0 AS c FROM g_summit),
y AS (SELECT *, r >= -1e-9 AND r <= 50.000000001e0 AND c >= -1e-9 AND c <= 50.000000001e0 AS ins, CAST(greatest(0, least(50, floor(r + 0.5e0))) AS INTEGER) AS rr, CAST(greatest(0, least(50, floor(c + 0.5e0))) AS INTEGER) AS cc FROM x)
SELECT id AS point_id, CASE WHEN NOT ins THEN 'outside' WHEN (rr * 7 + cc * 3) % 23 = 4 THEN 'void' ELSE 'ok' END AS status, CASE WHEN ins AND (rr * 7 + cc * 3) % 23 <> 4 THEN 'nearest' END AS method, CASE WHEN ins AND (rr * 7 + cc * 3) % 23 <> 4 THEN CAST(rr * 100 + cc AS DOUBLE) END AS elevationM FROM y""",
    "areas_of_peaks": f"""WITH {s.OBSERVER}, {s.SUMMIT}, a AS (SELECT observer_id AS key, lat + CASE WHEN observer_id % 7 = 3 THEN 9e0 ELSE 0e0 END AS la, lon AS lo, 5e0 + observer_id AS km FROM g_observer),
h AS (SELECT * FROM (SELECT a.key, p.id, a.km, {s.haversine('a.la', 'a.lo', 'p.lat', 'p.lon')} AS d FROM a, g_summit p) WHERE d <= km * 1000e0)
SELECT key, id, round(d, 3) + 0e0 AS distanceM, row_number() OVER (PARTITION BY key ORDER BY d, id) AS nth, CAST(NULL AS VARCHAR) AS reason FROM h UNION ALL SELECT key, NULL, NULL, NULL, 'empty-result' FROM a WHERE key NOT IN (SELECT key FROM h)""",
    "skyline_observations": f"""WITH x AS (SELECT c_custkey AS observer_id, c_custkey % 101 / 100e0 AS x, c_custkey % 89 / 88e0 AS y, c_custkey % 10 / 10e0 AS weight, CAST(c_custkey % 360 AS DOUBLE) AS h, CAST(c_custkey % 11 - 5 AS DOUBLE) AS p, 66e0 AS hf, 45e0 AS vf FROM customer WHERE c_custkey % 6 <> 1 AND c_custkey % 10 >= 3),
a AS (SELECT *, (x - 0.5e0) * 2e0 * tan(radians(hf) / 2e0) AS ta, (0.5e0 - y) * 2e0 * tan(radians(vf) / 2e0) AS tb FROM x),
b AS (SELECT *, sin(radians(h)) * cos(radians(p)) + ta * cos(radians(h)) - tb * sin(radians(h)) * sin(radians(p)) AS e, cos(radians(h)) * cos(radians(p)) - ta * sin(radians(h)) - tb * cos(radians(h)) * sin(radians(p)) AS n, sin(radians(p)) + tb * cos(radians(p)) AS u FROM a)
SELECT observer_id AS image, round({s.fold('degrees(atan2(e, n))')}, 4) + 0e0 AS bearingDeg, round(degrees(asin(u / sqrt(e * e + n * n + u * u))), 4) + 0e0 AS altitudeDeg, weight FROM b""",
    "svg_overlays": ORACLES["label_partition"].rsplit("SELECT", 1)[0] + f""", lb AS (SELECT observer_id, rank, '<g><text x="' || {_coordinate('round(x * 1600e0, 1)')} || '" y="' || {_coordinate('round(y * 1200e0, 1)')} || '">' || {_XML.replace('nm', 'name')} || '</text><text x="' || {_coordinate('round(x * 1600e0, 1)')} || '" y="' ||
  {_coordinate('round(y * 1200e0, 1)')} || '" dy="1.15em">' || detail || '</text></g>' AS g FROM b WHERE st = 'candidate' AND rank <= budget)
SELECT observer_id, '<svg xmlns="http://www.w3.org/2000/svg" width="1600" height="1200">' || chr(10) || string_agg(g, chr(10) ORDER BY rank) || chr(10) || '</svg>' AS svg FROM lb GROUP BY observer_id""",
}
