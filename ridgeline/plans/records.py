"""Record queries: landform import, cells, boxes, heights, citations, request keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import geodesy as g
from ridgeline.functions import text as t
from ridgeline.functions.geodesy import num
from ridgeline.operators import landforms as lf
from ridgeline.operators import visibility as v
from ridgeline.plans import sqltext as s
from ridgeline.plans.scene import r
from ridgeline.sources import views

AREA = (45.1, 7.0, 46.7, 8.7)


def land_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lf.import_landforms(views.landforms(spark, sf_dir), AREA)
    return out.select("ord", "id", "outcome", "name", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), "cell")


def land_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.outcome_counts(lf.import_landforms(views.landforms(spark, sf_dir), AREA))


def land_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partition manifest: cells and their summits."""
    kept = lf.import_landforms(views.landforms(spark, sf_dir), AREA).where("outcome = 'kept'")
    return kept.groupBy("cell").agg(F.count("*").alias("peaks"), F.min("id").alias("firstId"), r(F.max("lat"), 6).alias("north"), r(F.min("lat"), 6).alias("south"), r(F.min("lon"), 6).alias("west"), r(F.max("lon"), 6).alias("east"))


def circle_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact box of a circle around each observer, and around a point near the pole for each."""
    o = views.observers(spark, sf_dir).select("observer_id", "lat", "lon").withColumn("far", F.col("lat") + num(44.6))
    boxes = [o.select("observer_id", F.lit(name).alias("at"), *[r(x, 6).alias(k) for k, x in g.bounding_box(F.col(c), F.col("lon"), 30.0).items()]) for name, c in (("observer", "lat"), ("pole", "far"))]
    return boxes[0].unionByName(boxes[1])


def peaks_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summits in the box of a circle of 12 km around each observer."""
    o = views.observers(spark, sf_dir).select("observer_id", "lat", "lon")
    boxes = o.select("observer_id", *[x.alias(k) for k, x in g.bounding_box(F.col("lat"), F.col("lon"), 12.0).items()])
    return v.within_boxes(boxes, views.summits(spark, sf_dir)).select("observer_id", "id")


def peaks_in_wide_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in boxes that cover more cells than their corners: 140 km around each observer."""
    o = views.observers(spark, sf_dir).select("observer_id", "lat", "lon")
    boxes = o.select("observer_id", *[x.alias(k) for k, x in g.bounding_box(F.col("lat") - num(0.5), F.col("lon"), 140.0).items()])
    return v.within_boxes(boxes, views.summits(spark, sf_dir)).groupBy("observer_id").agg(F.count("*").alias("peaks"), F.min("id").alias("firstId"))


def longitude_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modular intervals, cells and folds over the whole circle."""
    c = F.col("c_custkey")
    rows = views.table(spark, sf_dir, "customer").select(c.alias("k"), ((c * 37 % 720) - num(360)).alias("west"), ((c * 53 % 720) - num(360) + num(0.5)).alias("east"), ((c * 91 % 1080) - num(540)).alias("lon"), ((c * 7 % 181) - num(90)).alias("lat"))
    w, e, lon, lat = F.col("west"), F.col("east"), F.col("lon"), F.col("lat")
    return rows.select("k", g.lon_width_deg(w, e).alias("width"), g.lon_within(w, e, lon).alias("inside"), g.normalise_longitude_deg(lon).alias("folded"), g.fold(lon).alias("bearing"), g.cell_name(lat, lon).alias("cell"), g.angular_difference_deg(w, lon).alias("turn"))


def tagged_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights parsed from tags as people write them."""
    k = F.col("p_partkey")
    tag = (
        F.when(k % 8 == 0, F.concat((k % 4 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" m"))).when(k % 8 == 1, F.concat((k * 7 % 14000).cast("string"), F.lit(" ft")))
        .when(k % 8 == 2, F.lit("unknown")).when(k % 8 == 3, F.concat(F.lit("  +"), (k % 3000).cast("string"), F.lit(".5 "))).when(k % 8 == 4, F.concat((k % 5000).cast("string"), F.lit("m")))
        .when(k % 8 == 5, F.concat((k % 5000).cast("string"), F.lit(" m ASL"))).when(k % 8 == 6, F.concat((k % 5000).cast("string"), F.lit(" Feet"))).otherwise(F.concat(F.lit("-"), (k % 400).cast("string"), F.lit(" metres")))
    )
    return views.table(spark, sf_dir, "part").select(k.alias("k"), tag.alias("tag")).withColumn("metres", t.ele_metres(F.col("tag")))


def filled_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing heights from a second source that knows some of them."""
    peaks = views.summits(spark, sf_dir)
    second = peaks.where("cast(substring(id, 2) as bigint) % 20 = 0").select("id", views.terrain_m(F.col("lat"), F.col("lon")).alias("elevationM"))
    return lf.fill_elevations(peaks, second).select("id", r("elevationM", 3).alias("elevationM"), "elevationSource")


def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose foreign key finds nothing: orders of absent customers, and customers of absent nations."""
    orders, customers, nations = (views.table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    lost = orders.join(customers, orders.o_custkey == customers.c_custkey, "left_anti").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("k"))
    stray = customers.join(nations.where("n_regionkey <> 3"), customers.c_nationkey == nations.n_nationkey, "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"))
    return lost.unionByName(stray)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence, host, request key and its hash of every page."""
    pages = views.table(spark, sf_dir, "pages")
    key = F.concat(F.lit("GET "), t.canonical_query(F.col("url")))
    return pages.select("page_id", t.host(F.col("url")).alias("host"), key.alias("key"), t.fnv1a_32(key).alias("hash"))


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first licence that each document names; those that require a notice first."""
    x = F.col("text")
    found = F.when(x.rlike(r"(?i)\bgnu general public license\b"), "GPL").when(x.rlike(r"(?i)\bapache license\b"), "Apache-2.0").when(x.rlike(r"(?i)\bmit license\b"), "MIT").when(x.rlike(r"(?i)\bcc by-nc\b"), "CC-BY-NC").when(x.rlike(r"(?i)\bcc by\b"), "CC-BY")
    docs = views.table(spark, sf_dir, "documents").select("doc_id", found.alias("licence")).where("licence is not null")
    order = Window.orderBy(F.col("strong").desc(), "licence")
    counted = docs.groupBy("licence").agg(F.count("*").alias("n"), F.min("doc_id").alias("firstDoc")).withColumn("strong", F.col("licence").isin("GPL", "CC-BY-NC", "CC-BY"))
    return counted.select("licence", "n", "firstDoc", "strong", F.row_number().over(order).alias("nth"))


def location_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in batches of 100 in their order, as one request text each."""
    n = F.col("c_custkey")
    lat, lon = num(45) + (n * 7919 % 20000) / num(10000), num(6.9) + (n * 10473 % 20000) / num(10000)
    point = F.concat_ws(",", F.format_string("%.6f", lat), F.format_string("%.6f", lon))
    rows = views.table(spark, sf_dir, "customer").select(n.alias("n"), point.alias("point"))
    return lf.batches(rows, "n", 100).select("batch", F.concat_ws("|", F.transform("rows", lambda x: x["point"])).alias("locations"), F.size("rows").cast("long").alias("points"))


def label_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.summits(spark, sf_dir)
    detail = F.concat(F.floor(F.col("elevationM") + num(0.5)).cast("long").cast("string"), F.lit(" m"))
    return p.select("id", r(t.text_width_em(F.col("name")) * num(14), 4).alias("nameWidthPx"), detail.alias("detail"), r(t.text_width_em(detail) * num(11), 4).alias("detailWidthPx"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union with first-seen dedup, and except, of two summit tables."""
    p = views.summits(spark, sf_dir).select("id", "name")
    a, b = p.where("cast(substring(id, 2) as bigint) % 3 <> 0").withColumn("ord", F.lit(0)), p.where("cast(substring(id, 2) as bigint) % 2 = 0").withColumn("ord", F.lit(1))
    first = a.unionByName(b).groupBy("id").agg(F.min(F.struct("ord", "name")).alias("x")).select("id", "x.name", F.col("x.ord").alias("source"))
    only = a.select("id").exceptAll(b.select("id")).withColumn("only", F.lit(True))
    return first.join(only, "id", "left").select("id", "name", "source", F.coalesce("only", F.lit(False)).alias("onlyInFirst"))


PK = "p_partkey"
LAND = f"""land AS (
  SELECT CASE WHEN {PK} % 43 = 9 THEN NULL WHEN {PK} % 17 <> 5 THEN concat('land-', CAST({PK} - CASE WHEN {PK} % 23 = 22 THEN 1 ELSE 0 END AS VARCHAR)) END AS id,
    CASE WHEN {PK} % 11 = 3 THEN NULL ELSE trim(p_name) END AS name, {PK} % 7 = 2 AS water, {PK} % 5 = 1 AS valley, {PK} % 10 <> 0 AND {PK} % 41 <> 17 AS high, {PK} % 19 <> 6 AND {PK} % 37 <> 12 AS boxed, {PK} % 13 = 4 AS wide,
    45e0 + (({PK} * 7919) % 20000) / 10000e0 AS la, 6.9e0 + (({PK} * 10473) % 20000) / 10000e0 AS lo, {PK} AS ord FROM part),
sized AS (SELECT *, CASE WHEN wide THEN 0.01e0 ELSE 0.00004e0 END AS sz FROM land),
placed AS (SELECT *, CASE WHEN boxed THEN ((la - sz) + (la + sz)) / 2e0 END AS lat, CASE WHEN boxed THEN ((lo - sz) + (lo + sz)) / 2e0 END AS lon FROM sized),
judged AS (
  SELECT *, CASE WHEN id IS NULL OR NOT boxed THEN 'unreadable-row' WHEN water THEN 'not-a-landform' WHEN valley THEN 'not-a-summit-class' WHEN name IS NULL THEN 'unnamed' WHEN NOT high THEN 'no-elevation'
    WHEN wide THEN 'not-a-point' WHEN NOT (lat BETWEEN 45.1e0 AND 46.7e0 AND lon BETWEEN 7.0e0 AND 8.7e0) THEN 'outside-area' END AS reason FROM placed),
imported AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY id, reason IS NULL ORDER BY ord) > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM judged)"""


def _box(la: str, lo: str, km: str) -> dict[str, str]:
    d = f"({km} * 1000e0 / {s.R})"
    ratio = f"(sin({d}) / cos(radians({la})))"
    polar = f"({la} - degrees({d}) <= -90e0 OR {la} + degrees({d}) >= 90e0 OR {ratio} >= 1e0)"
    half = f"degrees(asin(greatest(-1e0, least(1e0, {ratio}))))"
    return {"south": f"greatest(-90e0, {la} - degrees({d}))", "north": f"least(90e0, {la} + degrees({d}))", "west": f"CASE WHEN {polar} THEN -180e0 ELSE {lo} - {half} END", "east": f"CASE WHEN {polar} THEN 180e0 ELSE {lo} + {half} END"}


_B = _box("lat", "lon", "12e0")
_WIDTH = f"CASE WHEN east - west >= 360 THEN 360e0 ELSE {s.fold('east - west')} END"
_OFF = f"CASE WHEN lon - west >= 0 AND lon - west < 360 THEN lon - west ELSE {s.fold('lon - west')} END"

_FUNCS = (land_classified, land_outcomes, land_cells, circle_boxes, peaks_in_box, peaks_in_wide_box, longitude_intervals, tagged_heights, filled_heights, reference_check, citations, licences, location_batches, label_widths, set_operations)
QUERIES = {f.__name__: f for f in _FUNCS}


def _count(x: str, chars: str) -> str:
    quoted = chars.replace("'", "''")
    return f"(length({x}) - length(translate({x}, '{quoted}', '')))"


def _width(x: str) -> str:
    thin, wide, cap, dig = (_count(x, c) for c in (t.THIN, t.WIDE, t.CAPITAL, t.DIGIT))
    return f"({thin} * 0.28e0 + {wide} * 0.87e0 + {cap} * 0.68e0 + {dig} * 0.556e0 + (length({x}) - {thin} - {wide} - {cap} - {dig}) * 0.55e0)"


ORACLES = {
    "land_classified": f"WITH {LAND} SELECT ord, id, outcome, name, round(lat, 6) + 0e0 AS lat, round(lon, 6) + 0e0 AS lon, CASE WHEN boxed THEN {s.cell('lat', 'lon')} END AS cell FROM imported",
    "land_outcomes": f"WITH {LAND} SELECT o.outcome, count(i.ord) AS n FROM (SELECT unnest({[*lf.REASONS, 'kept', 'duplicate']!r}) AS outcome) o LEFT JOIN imported i ON i.outcome = o.outcome GROUP BY o.outcome",
    "land_cells": f"WITH {LAND} SELECT {s.cell('lat', 'lon')} AS cell, count(*) AS peaks, min(id) AS firstId, round(max(lat), 6) + 0e0 AS north, round(min(lat), 6) + 0e0 AS south, round(min(lon), 6) + 0e0 AS west, round(max(lon), 6) + 0e0 AS east FROM imported WHERE outcome = 'kept' GROUP BY 1",
    "circle_boxes": " UNION ALL ".join(f"(WITH {s.OBSERVER} SELECT observer_id, '{name}' AS at, {', '.join(f'round({x}, 6) + 0e0 AS {k}' for k, x in _box(c, 'lon', '30e0').items())} FROM g_observer)" for name, c in (("observer", "lat"), ("pole", "(lat + 44.6e0)"))),
    "peaks_in_box": f"WITH {s.OBSERVER}, {s.SUMMIT}, b AS (SELECT observer_id, {', '.join(f'{x} AS {k}' for k, x in _B.items())} FROM g_observer) SELECT observer_id, id FROM b, g_summit p WHERE p.lat BETWEEN south AND north AND p.lon BETWEEN west AND east",
    "peaks_in_wide_box": f"""WITH {s.OBSERVER}, {s.SUMMIT}, b AS (SELECT observer_id, {', '.join(f'{x} AS {k}' for k, x in _box('(lat - 0.5e0)', 'lon', '140e0').items())} FROM g_observer)
SELECT observer_id, count(*) AS peaks, min(id) AS firstId FROM b, g_summit p WHERE p.lat BETWEEN south AND north AND p.lon BETWEEN west AND east GROUP BY observer_id""",
    "longitude_intervals": f"""WITH x AS (SELECT c_custkey AS k, CAST((c_custkey * 37) % 720 AS DOUBLE) - 360e0 AS west, CAST((c_custkey * 53) % 720 AS DOUBLE) - 359.5e0 AS east, CAST((c_custkey * 91) % 1080 AS DOUBLE) - 540e0 AS lon, CAST((c_custkey * 7) % 181 AS DOUBLE) - 90e0 AS lat FROM customer)
SELECT k, {_WIDTH} AS width, east - west >= 360 OR ({_OFF}) <= ({_WIDTH}) AS inside, {s.norm_lon('lon')} AS folded, {s.fold('lon')} AS bearing, {s.cell('lat', 'lon')} AS cell, {s.angdiff('west', 'lon')} AS turn FROM x""",
    "tagged_heights": f"""WITH x AS (SELECT {PK} AS k, CASE {PK} % 8 WHEN 0 THEN concat({PK} % 4 + 1, ',', lpad(CAST({PK} % 1000 AS VARCHAR), 3, '0'), ' m') WHEN 1 THEN concat(({PK} * 7) % 14000, ' ft') WHEN 2 THEN 'unknown' WHEN 3 THEN concat('  +', {PK} % 3000, '.5 ')
  WHEN 4 THEN concat({PK} % 5000, 'm') WHEN 5 THEN concat({PK} % 5000, ' m ASL') WHEN 6 THEN concat({PK} % 5000, ' Feet') ELSE concat('-', {PK} % 400, ' metres') END AS tag FROM part)
SELECT k, tag, CAST(CASE k % 8 WHEN 0 THEN (k % 4 + 1) * 1000 + k % 1000 WHEN 1 THEN floor(((k * 7) % 14000) * 0.3048e0 * 1000e0 + 0.5e0) / 1000e0 WHEN 3 THEN k % 3000 + 0.5e0 WHEN 4 THEN k % 5000 WHEN 6 THEN floor((k % 5000) * 0.3048e0 * 1000e0 + 0.5e0) / 1000e0 WHEN 7 THEN -(k % 400) END AS DOUBLE) + 0e0 AS metres FROM x""",
    "filled_heights": f"WITH {s.SUMMIT} SELECT id, round(coalesce(elevationM, CASE WHEN CAST(substring(id, 2) AS BIGINT) % 20 = 0 THEN {s.terrain('lat', 'lon')} END), 3) + 0e0 AS elevationM, CASE WHEN elevationM IS NOT NULL THEN 'first' WHEN CAST(substring(id, 2) AS BIGINT) % 20 = 0 THEN 'second' END AS elevationSource FROM g_summit",
    "reference_check": "SELECT 'order' AS kind, o_orderkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3)",
    "licences": """WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bgnu general public license\\b') THEN 'GPL' WHEN regexp_matches(text, '(?i)\\bapache license\\b') THEN 'Apache-2.0' WHEN regexp_matches(text, '(?i)\\bmit license\\b') THEN 'MIT'
  WHEN regexp_matches(text, '(?i)\\bcc by-nc\\b') THEN 'CC-BY-NC' WHEN regexp_matches(text, '(?i)\\bcc by\\b') THEN 'CC-BY' END AS licence FROM documents),
c AS (SELECT licence, count(*) AS n, min(doc_id) AS firstDoc, licence IN ('GPL', 'CC-BY-NC', 'CC-BY') AS strong FROM d WHERE licence IS NOT NULL GROUP BY licence)
SELECT licence, n, firstDoc, strong, CAST(row_number() OVER (ORDER BY strong DESC, licence) AS INTEGER) AS nth FROM c""",
    "location_batches": """SELECT batch, string_agg(printf('%.6f,%.6f', 45e0 + ((c_custkey * 7919) % 20000) / 10000e0, 6.9e0 + ((c_custkey * 10473) % 20000) / 10000e0), '|' ORDER BY c_custkey) AS locations, count(*) AS points FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS batch FROM customer) GROUP BY 1""",
    "label_widths": f"WITH {s.SUMMIT}, x AS (SELECT id, name, concat(CAST(floor(elevationM + 0.5e0) AS BIGINT), ' m') AS d0, elevationM FROM g_summit), y AS (SELECT *, CASE WHEN elevationM IS NULL THEN NULL ELSE d0 END AS detail FROM x) SELECT id, round({_width('name')} * 14e0, 4) + 0e0 AS nameWidthPx, detail, round({_width('detail')} * 11e0, 4) + 0e0 AS detailWidthPx FROM y",
    "set_operations": f"""WITH {s.SUMMIT}, a AS (SELECT id, name FROM g_summit WHERE CAST(substring(id, 2) AS BIGINT) % 3 <> 0), b AS (SELECT id, name FROM g_summit WHERE CAST(substring(id, 2) AS BIGINT) % 2 = 0)
SELECT p.id, p.name, CASE WHEN a.id IS NOT NULL THEN 0 ELSE 1 END AS source, a.id IS NOT NULL AND b.id IS NULL AS onlyInFirst FROM g_summit p LEFT JOIN a ON a.id = p.id LEFT JOIN b ON b.id = p.id WHERE a.id IS NOT NULL OR b.id IS NOT NULL""",
    "citations": """WITH RECURSIVE x AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[^#]*', 0) AS u FROM pages),
k AS (SELECT page_id, host, concat('GET ', string_split(u, '?')[1], CASE WHEN contains(u, '?') THEN concat('?', array_to_string(list_sort(string_split(string_split(u, '?')[-1], '&')), '&')) ELSE '' END) AS key FROM x),
h AS (SELECT page_id, key, 0 AS i, CAST(2166136261 AS BIGINT) AS h FROM k UNION ALL SELECT page_id, key, i + 1, CAST((xor(h, CAST(unicode(substring(key, i + 1, 1)) AS BIGINT)) * 16777619) % 4294967296 AS BIGINT) FROM h WHERE i < length(key))
SELECT k.page_id, k.host, k.key, lpad(lower(to_hex(h.h)), 8, '0') AS hash FROM k JOIN h ON h.page_id = k.page_id AND h.i = length(k.key)""",
}
