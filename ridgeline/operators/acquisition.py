"""What an import asks for and what it got: sweeps, sampling grids, listings, byte ranges, recorded answers, regions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import fold, num

#: Kilometres a degree on the flat map that coarse grids are laid out on.
KM_PER_DEG_LAT, KM_PER_DEG_LON = 110.574, 111.32


@dataclass(frozen=True)
class Sweep:
    """Which samples a sweep asks for; values that would leave rays empty are refused."""

    bearing_step_deg: float = 1
    range_step_m: float = 90
    min_range_m: float = 0
    max_range_km: float = 30
    start_bearing_deg: float = 0
    span_deg: float = 360

    def __post_init__(self):
        rules = {
            "bearing_step_deg must be above 0": self.bearing_step_deg > 0, "range_step_m must be above 0": self.range_step_m > 0, "min_range_m must be 0 or more": self.min_range_m >= 0,
            "min_range_m must be below the range": self.min_range_m < self.max_range_km * 1000, "max_range_km must be above 0": self.max_range_km > 0,
            "span_deg must be above 0 and at most 360": 0 < self.span_deg <= 360, "the range must hold a step": self.max_range_km * 1000 >= self.range_step_m,
        }
        for rule, kept in rules.items():
            if not kept:
                raise ValueError(rule)

    def bearings(self) -> Column:
        """Bearings of the sweep, folded; a full turn doesn't repeat its first."""
        n = int(self.span_deg / self.bearing_step_deg + 1e-9)
        last = n - 1 if self.span_deg >= 360 else n
        return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: fold(num(self.start_bearing_deg) + i * num(self.bearing_step_deg)))

    def ranges(self) -> Column:
        """Distances of a ray's samples in metres."""
        first = max(1, -int(-self.min_range_m // self.range_step_m))
        return F.transform(F.sequence(F.lit(first), F.lit(int(self.max_range_km * 1000 / self.range_step_m + 1e-9))), lambda i: i * num(self.range_step_m))


def sector(heading: Column, hfov: Column) -> tuple[Column, Column]:
    """Span and first bearing of the sector that a camera's sweep covers: twice its view."""
    span = F.least(num(360), hfov * num(2))
    return span, fold(heading - span / num(2))


def sampling_grid(centres: DataFrame, radius_km: float, rays: int, per_ray: int) -> DataFrame:
    """key, ray, sample, lat, lon: each centre (ray -1) and the points of a coarse grid on a flat map around it."""
    r = F.struct(F.lit(-1).alias("ray"), F.lit(0).alias("sample"))
    steps = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rays - 1)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(per_ray)), lambda j: F.struct(i.alias("ray"), j.alias("sample")))))
    out = centres.select("key", "lat", "lon", F.inline(F.concat(F.array(r), steps)))
    turn, km = F.radians(num(360) * F.greatest(F.col("ray"), F.lit(0)) / num(rays)), num(radius_km) * F.col("sample") / num(per_ray)
    return out.select("key", "ray", "sample", (F.col("lat") + km * F.cos(turn) / num(KM_PER_DEG_LAT)).alias("lat"), (F.col("lon") + km * F.sin(turn) / (num(KM_PER_DEG_LON) * F.cos(F.radians("lat")))).alias("lon"))


def listed_parts(listings: DataFrame) -> DataFrame:
    """key, name, bytes of the parquet parts that XML listings of a bucket (key, xml) name, in order of their names (of equal names the smaller first)."""
    entry = F.regexp_extract_all("xml", F.lit(r"(?s)<Contents>(.*?)</Contents>"), F.lit(1))
    parts = listings.select("key", F.explode(entry).alias("e"))
    name, size = F.regexp_extract("e", r"<Key>([^<]*)</Key>", 1), F.regexp_extract("e", r"<Size>(\d+)</Size>", 1)
    found = parts.select("key", name.alias("name"), size.try_cast("long").alias("bytes")).where("name like '%.parquet' and bytes is not null")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("name", "bytes")).cast("long"))


def segments(ranges: DataFrame) -> DataFrame:
    """key, start, end, offset: recorded byte ranges (key, start, end, offset) joined where both the file and the record go on."""
    order = Window.partitionBy("key").orderBy("start", "offset")
    on = (F.col("start") == F.lag("end").over(order)) & (F.col("offset") == F.lag("offset").over(order) + F.lag("end").over(order) - F.lag("start").over(order))
    island = F.sum(F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranges.withColumn("_i", island).groupBy("key", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("offset").alias("offset")).drop("_i")


def recorded_answers(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests (key) with the recorded answer (key, status, body; the first by body of several); a miss is 'fixture-missing'."""
    one = records.groupBy("key").agg(F.min(F.struct("body", "status")).alias("r")).select("key", F.col("r.status").alias("status"), F.col("r.body").alias("body"))
    out = requests.join(one, "key", "left")
    return out.withColumn("reason", F.when(F.col("status").isNull(), "fixture-missing").when(~F.col("status").between(200, 299), "http-status"))


def echoed_heights(batches: DataFrame) -> DataFrame:
    """key, at, lat, lon, elevationM, reason of batched height answers: asked (array of lat, lon) and payload (JSON).

    An answer holds for its point only if it echoes it within 1e-6 degrees and there are as many as were asked; null heights are no data.
    """
    schema = "status string, results array<struct<elevation double, location struct<lat double, lng double>>>"
    b = batches.withColumn("r", F.from_json("payload", schema))
    n = F.size("r.results")
    whole = F.when(~F.col("r.status").eqNullSafe(F.lit("OK")), "bad-response").when(F.coalesce(n, F.lit(-1)) != F.size("asked"), "count-differs")
    each = b.select("key", whole.alias("whole"), F.col("r.results").alias("results"), F.posexplode("asked").alias("at", "p"))
    got = F.when(F.col("whole").isNull(), F.get("results", F.col("at")))
    echoed = (F.abs(got["location"]["lat"] - F.col("p.lat")) <= 1e-6) & (F.abs(got["location"]["lng"] - F.col("p.lon")) <= 1e-6)
    reason = F.when(F.col("whole").isNotNull(), F.col("whole")).when(~F.coalesce(echoed, F.lit(False)), "not-echoed").when(got["elevation"].isNull(), "no-data")
    return each.select("key", "at", "p.lat", "p.lon", F.when(reason.isNull(), got["elevation"]).alias("elevationM"), reason.alias("reason"))


def region_summary(indexes: DataFrame) -> DataFrame:
    """regions, summits, citations of region indexes (path, peakCount, sources): names from paths, titles once each, the first by path."""
    name = F.element_at(F.split("path", "/"), -2)
    counts = indexes.agg(F.concat_ws(",", F.sort_array(F.collect_list(name))).alias("regions"), F.sum(F.coalesce("peakCount", F.lit(0))).cast("long").alias("summits"))
    titles = indexes.select("path", F.posexplode("sources").alias("at", "title")).where("trim(title) <> ''").groupBy("title").agg(F.min(F.struct("path", "at")).alias("o"))
    cited = titles.agg(F.concat_ws("; ", F.transform(F.sort_array(F.collect_list(F.struct("o", "title"))), lambda x: x["title"])).alias("citations"))
    return counts.join(F.broadcast(cited))  # one row each
