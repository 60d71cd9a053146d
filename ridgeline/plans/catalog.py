"""Queries over catalogues, coverage, missing data and photo metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geodesy as g
from ridgeline.functions import text as t
from ridgeline.functions.geodesy import num
from ridgeline.operators import catalog as c
from ridgeline.plans import sqltext as s
from ridgeline.plans.scene import r
from ridgeline.sources import views

NAMES = ["N45E007", "s01w123", " N00E000 ", "N91E000", "N45E181", "X45E007", "N5E007", "S90W180"]
SIZES = [2 * 3601 * 3601, 2 * 1201 * 1201, 2 * 91 * 91, 2 * 10 * 10 + 2, 7, 2, 8]
BOUNDS = {"south": 45.3, "west": 7.0, "north": 46.9, "east": 8.4}


def k() -> Column:
    return F.col("p_partkey")


def pick(values: list, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows of tile files with names and sizes of every kind."""
    files = views.table(spark, sf_dir, "part").select(k().alias("k"), pick(NAMES, k()).alias("name"), pick(SIZES, k() * 3).cast("long").alias("bytes"))
    out = c.tile_catalog(files)
    return out.groupBy("name", "bytes").agg(
        F.first("reason").alias("reason"), F.first("size").alias("size"), F.first("dataset").alias("dataset"), r(F.first("stepDeg"), 9).alias("stepDeg"),
        F.first("north").alias("north"), F.first("south").alias("south"), F.first("west").alias("west"), F.first("east").alias("east"), F.count("*").alias("files"),
    )


def spacing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset names of sample spacings that do and don't divide a degree."""
    step = F.when(k() % 2 == 0, num(1) / (k() % 4000 + 1)).otherwise(k() * num(0.0137))
    return views.table(spark, sf_dir, "part").select(k().alias("k"), c.dataset_label(step).alias("dataset"))


def manifest_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster manifests as JSON, one for each part, with a defect of each kind in some."""
    blank = lambda every, at, value: F.when(k() % every != at, value)
    geometry = F.struct(
        (num(46) + k() % 3).alias("northLat"), blank(13, 4, num(7)).alias("westLon"), F.when(k() % 17 == 3, num(2.5)).otherwise((k() % 100 + 2).cast("double")).alias("rows"),
        F.when(k() % 19 == 3, num(1)).otherwise((k() % 50 + 3).cast("double")).alias("cols"), F.when(k() % 23 == 5, num(0)).otherwise(num(0.01)).alias("latStepDeg"), num(0.02).alias("lonStepDeg"),
    )
    grid = F.struct(
        F.when(k() % 5 == 1, F.lit("")).otherwise(F.concat(F.lit("g"), k().cast("string"))).alias("name"), blank(7, 2, F.lit("u")).alias("url"), blank(11, 6, F.lit("srtm1")).alias("dataset"), blank(29, 7, geometry).alias("geometry"),
    )
    manifest = F.struct(F.when(k() % 31 == 9, 2).otherwise(1).alias("version"), blank(37, 8, F.array(grid)).alias("grids"))
    payload = F.when(k() % 41 == 10, "[]").otherwise(F.to_json(manifest))
    out = c.manifest_grids(views.table(spark, sf_dir, "part").select(k().alias("label"), payload.alias("payload")))
    return out.select("label", "at", "name", "reason", "bytes", r("south", 6).alias("south"), r("east", 6).alias("east"))


def cell_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of cells held against the files of the cells."""
    p = views.summits(spark, sf_dir).withColumn("k", F.expr("cast(substring(id, 2) as bigint)"))
    own = g.cell_name(F.col("lat"), F.col("lon"))
    files = p.select(F.when(F.col("k") % 97 == 1, F.lit("n46e007")).when(F.col("k") % 89 == 5, F.lit("N10E010")).otherwise(own).alias("cell"), "id", "lat", "lon").where("id <> 'p50'")
    counted = p.groupBy(own.alias("cell")).agg(F.count("*").alias("peaks")).select("cell", F.when(F.col("cell") == "N45E006", num(-1)).otherwise(F.col("peaks")).cast("long").alias("peaks"))
    extra = p.where("k in (1, 2)").select(F.when(F.col("k") == 1, "N47E009").otherwise("n45e008").alias("cell"), F.lit(4).cast("long").alias("peaks"))
    return c.cell_check(counted.unionByName(extra), files)


def dataset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the summits' dataset answers for circles around every observer, and for wide ones."""
    o = views.observers(spark, sf_dir).select((F.col("observer_id") * 2).alias("key"), "lat", "lon")
    circles = [(o, 30.0), (o.select((F.col("key") + 1).alias("key"), (F.col("lat") - num(0.9)).alias("lat"), "lon"), 90.0)]
    boxed = [d.select("*", *[x.alias(n) for n, x in g.bounding_box(F.col("lat"), F.col("lon"), km).items()]) for d, km in circles]
    held = views.summits(spark, sf_dir).where("lat between 45.3 and 46.9 and lon between 7.0 and 8.4").select(g.cell_name(F.col("lat"), F.col("lon")).alias("cell"))
    out = c.coverage(boxed[0].unionByName(boxed[1]), held, {side: num(x) for side, x in BOUNDS.items()})
    return out.select("key", "complete", "cellsSpanned", "cellsHeld", r("coveredRadiusKm", 3).alias("coveredRadiusKm"), "missing", "note")


def resolved_observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground heights of observers: supplied, read from terrain with holes, fallen back on, or unknown."""
    i = F.col("observer_id")
    o = views.observers(spark, sf_dir)
    ground = c.resolved_ground(F.when(i % 4 == 0, num(1000) + i), F.when(i % 3 != 0, F.col("groundElevationM")), F.lit("srtm1"), F.when(i % 5 != 0, num(700)))
    out = o.select("observer_id", *[x.alias(n) for n, x in ground.items()])
    return out.select("observer_id", r("groundElevationM", 3).alias("groundElevationM"), "source", "note", r(F.col("groundElevationM") + num(views.EYE_HEIGHT_M), 3).alias("eyeElevationM"))


def filled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and voids of the summits' heights under the policies drop and fill."""
    p = views.summits(spark, sf_dir).select("id", "lat", "lon", "elevationM")
    kinds = [c.elevation_samples(p, policy).select(F.lit(name).alias("policy"), "elevationM") for name, policy in (("drop", "drop"), ("fill", -5.0))]
    counted = kinds[0].unionByName(kinds[1]).groupBy("policy").agg(F.count("*").alias("samples"), r(F.min("elevationM"), 3).alias("least"))
    voids = p.agg(F.count_if(F.col("elevationM").isNull()).alias("voids"))
    return counted.join(F.broadcast(voids))


PHOTO_TAGS = {
    "latitude": (["46.02", "x", " 45.5 ", ""], 3), "longitude": (["7.75", "8.1e0", "NaN"], 5), "GPSAltitude": (["2500.5", "120", "1d"], 1), "GPSAltitudeRef": (["0", "1"], 1),
    "GPSImgDirection": (["370.5", "12", "-15", "abc"], 1), "GPSImgDirectionRef": (["T", "m", " M ", "Q"], 7), "FocalLength": (["4.2", "0", "-1"], 1), "FocalLengthIn35mmFormat": (["26", "0", "77.5", ""], 1),
    "Orientation": (["1", "6", "8", "9", "2.5"], 1), "ExifImageWidth": (["4032", "0"], 11), "ImageWidth": (["4000"], 1), "ExifImageHeight": (["3024", "5000", "-3"], 1), "ImageHeight": (["3000"], 1),
}


def photo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos' tags read to typed values."""
    pairs = []
    for at, (name, (values, by)) in enumerate(PHOTO_TAGS.items()):
        pairs += [F.lit(name), F.when((k() + at) % 13 != 0, pick(values, F.floor(k() / by).cast("long")))]
    out = c.photo_record(F.col("tags"))
    digits = {"lat": 6, "lon": 6, "hFovDeg": 4, "vFovDeg": 4, "imgDirectionDeg": 3}
    tagged = views.table(spark, sf_dir, "part").select(k().alias("k"), F.create_map(*pairs).alias("tags"))
    return tagged.select("k", *[(r(x, digits[n]) if n in digits else x).alias(n) for n, x in out.items()])


def peak_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map service's answers, ten elements each, as JSON: nodes and ways with heights in many spellings."""
    ele = pick(["1,200 m", "4 808", "14505 ft", "abc", "-12.5", "2500metres", "9 99", "1234,5"], k())
    node = F.struct(
        F.when(k() % 3 == 0, "way").otherwise("node").alias("type"), F.when(k() % 43 != 7, k()).alias("id"), F.when(k() % 3 != 0, num(45) + k() % 50).alias("lat"), F.when(k() % 3 != 0, num(7)).alias("lon"),
        F.when(k() % 6 == 0, F.struct(num(44.5).alias("lat"), (num(6) + k() % 9).alias("lon"))).alias("center"),
        F.create_map(F.lit("name"), F.when(k() % 10 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" Peak "), k().cast("string"))), F.lit("ele"), F.when(k() % 4 != 1, ele), F.lit("ele:ft"), F.when(k() % 5 != 1, pick(["12000", "100 m", "9,000 feet"], k()))).alias("tags"),
    )
    whole = views.table(spark, sf_dir, "part").groupBy(F.floor(k() / 10).cast("long").alias("key")).agg(F.collect_list(node).alias("elements"))
    remark = F.when(F.col("key") % 7 == 3, "runtime error: Query timed out").when(F.col("key") % 7 == 4, "all well")
    payload = F.to_json(F.struct(remark.alias("remark"), F.when(F.col("key") % 11 != 5, F.col("elements")).alias("elements")))
    return c.peak_candidates(whole.select("key", payload.alias("payload")), t.tagged_height)


_ALL = (tile_files, spacing_labels, manifest_grids, cell_files, dataset_coverage, resolved_observers, filled_samples, photo_records, peak_answers)
QUERIES = {f.__name__: f for f in _ALL}


def _pick(values: list, by: str) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in values) + f"][CAST({by} AS BIGINT) % {len(values)} + 1]"


def _width(w: str, e: str) -> str:
    return f"(CASE WHEN {e} - {w} >= 360 THEN 360e0 ELSE {s.fold(f'{e} - {w}')} END)"


def _box(la: str, lo: str, km: str) -> str:
    d = f"({km} * 1000e0 / {s.R})"
    half = f"degrees(asin(least(1e0, sin({d}) / cos(radians({la})))))"
    return f"{la} - degrees({d}) AS south, {la} + degrees({d}) AS north, {lo} - {half} AS west, {lo} + {half} AS east"


def _label(step: str) -> str:
    per, secs = f"(1e0 / {step})", f"({step} * 3600e0)"
    whole, scale = f"floor({per} + 0.5e0)", f"pow(10e0, 5e0 - floor(log10({secs})))"
    odd = f"{whole} < 1 OR abs({per} - {whole}) > 1e-6 * {whole}"
    named = f"CASE {whole} + 1 WHEN 3601 THEN 'srtm1' WHEN 1201 THEN 'srtm3' ELSE 'hgt-' || CAST(CAST({whole} + 1 AS BIGINT) AS VARCHAR) END"
    return f"CASE WHEN {odd} THEN 'hgt-' || regexp_replace(CAST(floor({secs} * {scale} + 0.5e0) / {scale} AS VARCHAR), '\\.0$', '') || 'arcsec' ELSE {named} END"


def _short(x: str) -> str:
    return f"regexp_replace(printf('%.4f', {x}), '\\.?0+$', '')"


def _tag(x: str, feet: str) -> str:
    """Metres of a tag, another grammar: one pattern for number and unit."""
    clean = f"regexp_replace(trim({x}), '([0-9])[, ]([0-9]{{3}})$|([0-9])[, ]([0-9]{{3}})([^0-9])', '\\1\\2\\3\\4\\5', 'g')"
    number = f"TRY_CAST(nullif(regexp_extract({clean}, '^([+-]?[0-9]+(\\.[0-9]+)?) *([A-Za-z]*)$', 1), '') AS DOUBLE)"
    unit = f"lower(regexp_extract({clean}, '^([+-]?[0-9]+(\\.[0-9]+)?) *([A-Za-z]*)$', 3))"
    ft = f"floor({number} * 0.3048e0 * 1000e0 + 0.5e0) / 1000e0"
    if feet:
        return f"CASE WHEN {unit} IN ('', 'ft', 'foot', 'feet') THEN {ft} END"
    return f"CASE WHEN {unit} IN ('ft', 'foot', 'feet') THEN {ft} WHEN {unit} IN ('', 'm', 'meter', 'meters', 'metre', 'metres') THEN {number} END"


def _number(name: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({name}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({name}) AS DOUBLE) END"


_TAGS = ", ".join(f"CASE WHEN (p_partkey + {at}) % 13 <> 0 THEN {_pick(v, f'p_partkey // {by}')} END AS {n}" for at, (n, (v, by)) in enumerate(PHOTO_TAGS.items()))
_NUMBERS = ", ".join(f"{_number(n)} AS {n}" for n in PHOTO_TAGS if n != "GPSImgDirectionRef")
P = "p_partkey"

ORACLES = {
    "tile_files": f"""WITH f AS (SELECT {_pick(NAMES, P)} AS name, CAST({_pick(SIZES, P + ' * 3')} AS BIGINT) AS bytes FROM part),
n AS (SELECT *, upper(trim(name)) AS u, CAST(round(sqrt(bytes / 2e0)) AS BIGINT) AS side FROM f),
q AS (SELECT *, regexp_full_match(u, '[NS][0-9][0-9][EW][0-9][0-9][0-9]') AND TRY_CAST(u[2:3] AS INTEGER) <= 90 AND TRY_CAST(u[5:7] AS INTEGER) <= 180 AS named, side * side * 2 = bytes AND side >= 2 AS sized FROM n),
z AS (SELECT *, CASE WHEN named THEN TRY_CAST(u[2:3] AS INTEGER) * CASE WHEN u[1] = 'S' THEN -1 ELSE 1 END END AS la, CASE WHEN named THEN TRY_CAST(u[5:7] AS INTEGER) * CASE WHEN u[4] = 'W' THEN -1 ELSE 1 END END AS lo FROM q)
SELECT name, bytes, any_value(CASE WHEN NOT named THEN 'bad-name' WHEN NOT sized THEN 'bad-size' END) AS reason, any_value(CASE WHEN named AND sized THEN side END) AS size,
  any_value(CASE WHEN named AND sized THEN CASE side WHEN 3601 THEN 'srtm1' WHEN 1201 THEN 'srtm3' ELSE 'hgt-' || CAST(side AS VARCHAR) END END) AS dataset, round(any_value(CASE WHEN named AND sized THEN 1e0 / (side - 1) END), 9) + 0e0 AS stepDeg,
  any_value(CASE WHEN named AND sized THEN la + 1 END) AS north, any_value(CASE WHEN named AND sized THEN la END) AS south, any_value(CASE WHEN named AND sized THEN lo END) AS west, any_value(CASE WHEN named AND sized THEN lo + 1 END) AS east, count(*) AS files
FROM z GROUP BY name, bytes""",
    "spacing_labels": f"WITH x AS (SELECT {P} AS k, CASE WHEN {P} % 2 = 0 THEN 1e0 / ({P} % 4000 + 1) ELSE {P} * 0.0137e0 END AS st FROM part) SELECT k, {_label('st')} AS dataset FROM x",
    "manifest_grids": f"""WITH x AS (SELECT {P} AS k, CASE WHEN {P} % 41 = 10 THEN 'not-an-object' WHEN {P} % 31 = 9 THEN 'unsupported-version' WHEN {P} % 37 = 8 THEN 'no-grids' END AS whole,
  CASE WHEN {P} % 5 = 1 THEN '' ELSE 'g' || CAST({P} AS VARCHAR) END AS name, CASE WHEN {P} % 17 = 3 THEN 2.5e0 ELSE {P} % 100 + 2e0 END AS rws, CASE WHEN {P} % 19 = 3 THEN 1e0 ELSE {P} % 50 + 3e0 END AS cls FROM part),
q AS (SELECT *, CASE WHEN name = '' THEN 'no-name' WHEN k % 7 = 2 THEN 'no-url' WHEN k % 11 = 6 THEN 'no-dataset' WHEN k % 29 = 7 THEN 'no-geometry' WHEN k % 13 = 4 THEN 'not-a-finite-number' WHEN k % 17 = 3 THEN 'bad-rows'
  WHEN k % 19 = 3 THEN 'bad-cols' WHEN k % 23 = 5 THEN 'bad-spacing' END AS rs FROM x WHERE whole IS NULL)
SELECT k AS label, -1 AS at, NULL AS name, whole AS reason, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS DOUBLE) AS south, CAST(NULL AS DOUBLE) AS east FROM x WHERE whole IS NOT NULL
UNION ALL SELECT k, 0, name, rs, CASE WHEN rs IS NULL THEN CAST(rws * cls * 2 AS BIGINT) END, CASE WHEN rs IS NULL THEN round(46e0 + k % 3 - (rws - 1) * 0.01e0, 6) + 0e0 END, CASE WHEN rs IS NULL THEN round(7e0 + (cls - 1) * 0.02e0, 6) + 0e0 END FROM q""",
    "cell_files": f"""WITH {s.SUMMIT}, p AS (SELECT id, CAST(substring(id, 2) AS BIGINT) AS k, {s.cell('lat', 'lon')} AS own FROM g_summit),
fl AS (SELECT upper(CASE WHEN k % 97 = 1 THEN 'n46e007' WHEN k % 89 = 5 THEN 'N10E010' ELSE own END) AS cell, count(*) AS held, count(*) FILTER (own <> upper(CASE WHEN k % 97 = 1 THEN 'n46e007' WHEN k % 89 = 5 THEN 'N10E010' ELSE own END)) AS stray FROM p WHERE id <> 'p50' GROUP BY 1),
ix AS (SELECT own AS cell, CASE WHEN own = 'N45E006' THEN -1 ELSE count(*) END AS peaks FROM p GROUP BY own UNION ALL SELECT 'N47E009', 4 UNION ALL SELECT 'N45E008', 4),
l AS (SELECT cell, count(*) AS times, min(peaks) AS promised FROM ix GROUP BY cell)
SELECT coalesce(l.cell, fl.cell) AS cell, CASE WHEN times > 1 THEN 'duplicate-cell' WHEN promised < 0 THEN 'bad-count' WHEN held IS NULL AND promised > 0 THEN 'no-file' WHEN times IS NULL THEN 'unlisted-file' WHEN stray > 0 THEN 'wrong-cell'
  WHEN coalesce(held, 0) <> promised THEN 'count-differs' END AS reason, coalesce(held, 0) AS held FROM l FULL JOIN fl ON l.cell = fl.cell""",
    "dataset_coverage": f"""WITH {s.OBSERVER}, {s.SUMMIT}, ci AS (SELECT observer_id * 2 AS key, lat, lon, {_box('lat', 'lon', '30e0')} FROM g_observer UNION ALL SELECT observer_id * 2 + 1, la, lon, {_box('la', 'lon', '90e0')} FROM (SELECT *, lat - 0.9e0 AS la FROM g_observer)),
hd AS (SELECT DISTINCT {s.cell('lat', 'lon')} AS cell FROM g_summit WHERE lat BETWEEN 45.3 AND 46.9 AND lon BETWEEN 7.0 AND 8.4),
nm AS (SELECT key, {s.cell('CAST(rr AS DOUBLE)', 'CAST(cc AS DOUBLE)')} AS cell FROM (SELECT *, unnest(range(CAST(floor(west) AS BIGINT), CAST(floor(east) AS BIGINT) + 1)) AS cc FROM (SELECT *, unnest(range(CAST(floor(south) AS BIGINT), CAST(floor(north) AS BIGINT) + 1)) AS rr FROM ci))),
ct AS (SELECT n.key, count(*) AS spanned, count(h.cell) AS held, coalesce(string_agg(CASE WHEN h.cell IS NULL THEN n.cell END, ' ' ORDER BY n.cell), '') AS missing FROM nm n LEFT JOIN hd h ON h.cell = n.cell GROUP BY n.key),
y AS (SELECT ci.*, spanned, held, missing, lon - 7e0 AS eo, south >= 45.3e0 AND north <= 46.9e0 AND west >= 7e0 AND (west - 7e0) + (east - west) <= 1.4e0 AS complete FROM ci JOIN ct ON ct.key = ci.key),
w AS (SELECT *, CASE WHEN lat < 45.3 OR lat > 46.9 OR eo < 0 OR eo > 1.4e0 THEN 0e0 ELSE least({s.R} / 1000e0 * radians(lat - 45.3e0), {s.R} / 1000e0 * radians(46.9e0 - lat), {s.R} / 1000e0 * asin(sin(radians(eo)) * cos(radians(lat))), {s.R} / 1000e0 * asin(sin(radians(1.4e0 - eo)) * cos(radians(lat)))) END AS rk FROM y)
SELECT key, complete, spanned AS cellsSpanned, held AS cellsHeld, round(rk, 3) + 0e0 AS coveredRadiusKm, missing, CASE WHEN NOT complete THEN 'covers 45.3 N to 46.9 N, 7 E to 8.4 E; spans ' || CAST(spanned AS VARCHAR) || CASE WHEN spanned = 1 THEN ' cell' ELSE ' cells' END
  || ', holds ' || CAST(held AS VARCHAR) || '; complete within ' || printf('%.1f', rk) || ' km' END AS note FROM w""",
    "resolved_observers": f"""WITH {s.OBSERVER}, x AS (SELECT observer_id AS i, CASE WHEN observer_id % 4 = 0 THEN 1000e0 + observer_id END AS sup, CASE WHEN observer_id % 3 <> 0 THEN groundElevationM END AS ter, CASE WHEN observer_id % 5 <> 0 THEN 700e0 END AS fb FROM g_observer),
y AS (SELECT *, CASE WHEN sup IS NOT NULL THEN 'supplied' WHEN ter IS NOT NULL THEN 'terrain' WHEN fb IS NOT NULL THEN 'fallback' END AS source FROM x)
SELECT i AS observer_id, round(coalesce(sup, ter, fb), 3) + 0e0 AS groundElevationM, source, CASE source WHEN 'terrain' THEN printf('%.1f', ter) || ' m from srtm1' WHEN 'fallback' THEN 'no data in srtm1' END AS note, round(coalesce(sup, ter, fb) + 1.6e0, 3) + 0e0 AS eyeElevationM FROM y""",
    "filled_samples": f"""WITH {s.SUMMIT} SELECT policy, samples, least, (SELECT count(*) FROM g_summit WHERE elevationM IS NULL) AS voids FROM (
SELECT 'drop' AS policy, count(elevationM) AS samples, round(min(elevationM), 3) + 0e0 AS least FROM g_summit UNION ALL SELECT 'fill', count(*), round(min(coalesce(elevationM, -5e0)), 3) + 0e0 FROM g_summit)""",
    "photo_records": f"""WITH x AS (SELECT {P} AS k, {_TAGS} FROM part), n AS (SELECT k, upper(trim(GPSImgDirectionRef)) AS rf, {_NUMBERS} FROM x),
o AS (SELECT *, CASE WHEN Orientation = floor(Orientation) AND Orientation BETWEEN 1 AND 8 THEN CAST(Orientation AS INTEGER) END AS ori, coalesce(ExifImageWidth, ImageWidth) AS sw, coalesce(ExifImageHeight, ImageHeight) AS sh, CASE WHEN FocalLengthIn35mmFormat > 0 THEN FocalLengthIn35mmFormat END AS fo FROM n),
d AS (SELECT *, CASE WHEN coalesce(ori >= 5, false) THEN sh ELSE sw END AS w0, CASE WHEN coalesce(ori >= 5, false) THEN sw ELSE sh END AS h0 FROM o),
e AS (SELECT *, CASE WHEN w0 > 0 THEN w0 END AS w, CASE WHEN h0 > 0 THEN h0 END AS h, 2e0 * atan(18e0 / fo) AS lg FROM d)
SELECT k, CASE WHEN longitude IS NOT NULL THEN round(latitude, 6) + 0e0 END AS lat, CASE WHEN latitude IS NOT NULL THEN round(longitude, 6) + 0e0 END AS lon, CASE WHEN GPSAltitudeRef = 1 THEN -abs(GPSAltitude) ELSE GPSAltitude END AS gpsAltitudeM,
  round({s.fold('GPSImgDirection')}, 3) + 0e0 AS imgDirectionDeg, CASE WHEN rf IN ('T', 'M') THEN rf END AS imgDirectionRef, CASE WHEN FocalLength > 0 THEN FocalLength END AS focalLengthMm, fo AS focalLength35mmMm, ori AS orientation, w AS imageWidthPx, h AS imageHeightPx,
  CASE WHEN w IS NOT NULL AND h IS NOT NULL THEN round(degrees(CASE WHEN w >= h THEN lg ELSE 2e0 * atan(tan(lg / 2e0) * w / h) END), 4) + 0e0 END AS hFovDeg, CASE WHEN w IS NOT NULL AND h IS NOT NULL THEN round(degrees(CASE WHEN w >= h THEN 2e0 * atan(tan(lg / 2e0) * h / w) ELSE lg END), 4) + 0e0 END AS vFovDeg FROM e""",
    "peak_answers": f"""WITH x AS (SELECT {P} AS k, {P} // 10 AS key, CASE WHEN {P} % 4 <> 1 THEN {_pick(["1,200 m", "4 808", "14505 ft", "abc", "-12.5", "2500metres", "9 99", "1234,5"], P)} END AS ele, CASE WHEN {P} % 5 <> 1 THEN {_pick(["12000", "100 m", "9,000 feet"], P)} END AS ft FROM part),
bad AS (SELECT DISTINCT key FROM x WHERE key % 7 = 3 OR key % 11 = 5)
SELECT key, CASE WHEN k % 3 = 0 THEN 'way/' ELSE 'node/' END || CAST(k AS VARCHAR) AS id, 'Peak ' || CAST(k AS VARCHAR) AS name, CASE WHEN k % 3 = 0 THEN 44.5e0 ELSE 45e0 + k % 50 END AS lat, CASE WHEN k % 3 = 0 THEN 6e0 + k % 9 ELSE 7e0 END AS lon, coalesce({_tag('ele', '')}, {_tag('ft', 'f')}) AS elevationM, CAST(NULL AS VARCHAR) AS reason
FROM x WHERE key NOT IN (SELECT key FROM bad) AND k % 43 <> 7 AND k % 10 <> 3 AND (k % 3 <> 0 OR k % 6 = 0)
UNION ALL SELECT key, NULL, NULL, NULL, NULL, NULL, 'bad-response' FROM bad""",
}
