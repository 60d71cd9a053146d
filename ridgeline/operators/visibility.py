"""Sight lines over terrain: staircases, profiles, radius joins, circular as-of brackets, verdicts and classes.

Tables: observers (observer_id, lat, lon, groundElevationM, eyeElevationM), summits (id, lat, lon, elevationM) and rays
(observer_id, eyeElevationM, bearingDeg, distanceM, elevationM). What was not measured is absent, never zero.
Everything is keyed by observer (and bearing), so rays of a million observers shuffle on that key once; a ray is a short
array afterwards and joins to sightings by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import (
    COINCIDENT_DISTANCE_TOLERANCE, altitude_angle_deg, angular_difference_deg, bounding_box, cell_name, haversine_m, initial_bearing_deg, lon_width_deg, lon_within, num,
)
from ridgeline.tables import write_down

RAY = ("observer_id", "bearingDeg")
MAX_SAMPLE_GAP_FACTOR = 1.5


def with_altitude(rays: DataFrame) -> DataFrame:
    """Rays with altitudeDeg; a sample at distance 0 says nothing about a skyline and goes."""
    return rays.where("distanceM > 0").withColumn("altitudeDeg", altitude_angle_deg(F.col("eyeElevationM"), F.col("elevationM"), F.col("distanceM")))


def staircase(rays: DataFrame) -> DataFrame:
    """Samples that stand higher than everything nearer on their ray; of several at one distance the highest."""
    nearer = Window.partitionBy(*RAY).orderBy("distanceM", F.desc("altitudeDeg")).rowsBetween(Window.unboundedPreceding, -1)
    high = with_altitude(rays).withColumn("_high", F.max("altitudeDeg").over(nearer))
    return high.where("_high is null or altitudeDeg > _high").drop("_high")


def horizon_profile(rays: DataFrame) -> DataFrame:
    """One row for each measured bearing: the skyline's altitude, distance and elevation, and its steps."""
    last = F.struct("distanceM", "altitudeDeg", "elevationM")
    return staircase(rays).groupBy(*RAY).agg(F.max(last).alias("top"), F.sort_array(F.collect_list(last)).alias("steps")).select(*RAY, F.col("top.altitudeDeg").alias("altitudeDeg"), (F.col("top.distanceM") / num(1000)).alias("distanceKm"), F.col("top.elevationM").alias("elevationM"), "steps")


def within_radius(observers: DataFrame, summits: DataFrame, radius_km: float) -> DataFrame:
    """observer x summit pairs within a radius (inclusive): cells of the circle's box joined by name, then the exact distance.

    An equality join on 1 degree cells, so no pair outside a cell is ever compared.
    """
    box = bounding_box(F.col("lat"), F.col("lon"), radius_km)
    rows = F.sequence(F.floor(box["south"]).cast("int"), F.least(F.lit(89), F.floor(box["north"]).cast("int")))
    wide = box["east"] - box["west"] >= 359
    columns = F.when(wide, F.sequence(F.lit(-180), F.lit(179))).otherwise(F.sequence(F.floor(box["west"]).cast("int"), F.floor(box["east"]).cast("int")))
    covered = observers.select("*", F.explode(rows).alias("_r")).select("*", F.explode(columns).alias("_c"))
    covered = covered.withColumn("cell", cell_name(F.col("_r").cast("double"), F.col("_c").cast("double"))).drop("_r", "_c")
    placed = summits.withColumn("cell", cell_name(F.col("lat"), F.col("lon")))
    o, p = covered.alias("o"), placed.alias("p")
    distance = haversine_m(F.col("o.lat"), F.col("o.lon"), F.col("p.lat"), F.col("p.lon"))
    joined = o.join(p, "cell").withColumn("distanceM", distance).where(F.col("distanceM") <= radius_km * 1000)
    return joined.select("o.observer_id", "o.eyeElevationM", "o.groundElevationM", "p.id", "p.name", "p.elevationM", "distanceM", initial_bearing_deg(F.col("o.lat"), F.col("o.lon"), F.col("p.lat"), F.col("p.lon")).alias("bearingDeg"))


def sightings(observers: DataFrame, summits: DataFrame, radius_km: float) -> DataFrame:
    """Summits of known height within the radius, as seen: bearing, distance, altitude."""
    near = within_radius(observers, summits.where("elevationM is not null"), radius_km)
    return near.withColumn("altitudeDeg", altitude_angle_deg(F.col("eyeElevationM"), F.col("elevationM"), F.col("distanceM"))).withColumn("distanceKm", F.col("distanceM") / num(1000))


def within_boxes(boxes: DataFrame, summits: DataFrame) -> DataFrame:
    """Summits in boxes (observer_id, south, west, north, east; longitudes modular): by all cells of a box, then the exact test."""
    rows = F.sequence(F.floor("south").cast("int"), F.least(F.lit(89), F.floor("north").cast("int")))
    wide = lon_width_deg(F.col("west"), F.col("east")) >= 359
    columns = F.when(wide, F.sequence(F.lit(-180), F.lit(179))).otherwise(F.sequence(F.floor("west").cast("int"), F.floor(F.col("west") + lon_width_deg(F.col("west"), F.col("east"))).cast("int")))
    covered = boxes.select("*", F.explode(rows).alias("_r")).select("*", F.explode(columns).alias("_c"))
    covered = covered.withColumn("cell", cell_name(F.col("_r").cast("double"), F.col("_c").cast("double"))).drop("_r", "_c").distinct().alias("b")
    placed = summits.withColumn("cell", cell_name(F.col("lat"), F.col("lon"))).alias("p")
    inside = F.col("p.lat").between(F.col("b.south"), F.col("b.north")) & lon_within(F.col("b.west"), F.col("b.east"), F.col("p.lon"))
    return covered.join(placed, "cell").where(inside).select("b.observer_id", *[F.col(f"p.{c}") for c in summits.columns])


def bracketed(seen: DataFrame, profile: DataFrame) -> DataFrame:
    """Sightings with the measured bearings on both sides, across the seam: before, after, _b, _a (unwrapped), weight, nearest.

    A profile becomes arcs from each bearing to the next (the last to the first). An arc is found by whole degrees, which are
    joined by equality, so a sighting meets the few arcs of its degree. Steps of both ends, if the profile has them, come along.
    """
    order, every = Window.partitionBy("observer_id").orderBy("bearingDeg"), Window.partitionBy("observer_id")
    steps = ["steps"] if "steps" in profile.columns else []
    arcs = profile.select("observer_id", "bearingDeg", *steps).dropDuplicates(list(RAY))
    arcs = arcs.select(
        "observer_id", F.col("bearingDeg").alias("before"), F.coalesce(F.lead("bearingDeg").over(order), F.min("bearingDeg").over(every)).alias("after"),
        F.coalesce(F.lead("bearingDeg").over(order), F.min("bearingDeg").over(every) + num(360)).alias("_end"),
        *[x for s in steps for x in (F.col(s).alias("_before"), F.coalesce(F.lead(s).over(order), F.min_by(s, "bearingDeg").over(every)).alias("_after"))],
    )
    degrees = F.transform(F.sequence(F.floor("before").cast("int"), F.floor("_end").cast("int")), lambda d: F.pmod(d, F.lit(360)))
    arcs = arcs.select("*", F.explode(F.array_distinct(degrees)).alias("_degree"))
    out = seen.withColumn("_degree", F.floor("bearingDeg").cast("int")).join(arcs, ["observer_id", "_degree"])
    wrapped = F.when(F.col("bearingDeg") < F.col("before"), num(360)).otherwise(num(0))
    out = out.withColumn("_b", F.col("before") - wrapped).withColumn("_a", F.col("_end") - wrapped).where("bearingDeg >= _b and bearingDeg < _a")
    weight = F.when(F.col("_a") > F.col("_b"), (F.col("bearingDeg") - F.col("_b")) / (F.col("_a") - F.col("_b"))).otherwise(num(0))
    apart = lambda c: F.abs(angular_difference_deg(F.col(c), F.col("bearingDeg")))
    ends = [F.struct(apart(c).alias("sep"), F.col(c).alias("b")) for c in ("before", "after")]
    return out.withColumn("weight", weight).withColumn("nearest", F.least(*ends)["b"]).drop("_degree", "_end")


def nearer_step(steps: str) -> str:
    """The highest step nearer than the sighting, as SQL over ``steps``: stairs rise, so it is the last that is nearer."""
    limit = f"distanceKm - abs(distanceKm) * {COINCIDENT_DISTANCE_TOLERANCE!r}D"
    return f"try_element_at(filter({steps}, s -> s.distanceM / 1000D < {limit}), -1)"


def against_horizon(seen: DataFrame, rays: DataFrame) -> DataFrame:
    """Sightings with occludingAltitudeDeg, clearanceDeg and occluderDistanceKm (null if nothing stands nearer)."""
    return against_profile(seen, horizon_profile(rays))


def against_profile(seen: DataFrame, profile: DataFrame) -> DataFrame:
    """against_horizon() with a profile that is there already (with steps)."""
    out = bracketed(seen, profile)
    for side in ("_before", "_after"):
        out = out.withColumn(side, F.expr(nearer_step(side)))
    b, a = F.col("_before"), F.col("_after")
    low, high = b["altitudeDeg"], a["altitudeDeg"]
    angle = F.when(b.isNull(), high).when(a.isNull(), low).otherwise(low + F.col("weight") * (high - low))
    out = out.withColumn("occludingAltitudeDeg", F.coalesce(angle, num(-90))).withColumn("occluderDistanceKm", F.least(b["distanceM"], a["distanceM"]) / num(1000))
    return out.withColumn("clearanceDeg", F.col("altitudeDeg") - F.col("occludingAltitudeDeg")).drop("_before", "_after")


def ray_table(rays: DataFrame, spacing_m: float, near_m: float) -> DataFrame:
    """One row for each bearing with terrain: steps of its skyline, distances of its samples, what is so far at each of them, and its near ground.

    So far at a sample (states): gaps wider than 1.5 spacings between it and the observer (bad), the crest (its altitude, how near, its
    height and the gaps up to it) and the lowest ground since (low). All are running values over one sorting of the ray; a sighting then
    needs the last sample before it and looks through no other.
    """
    order = Window.partitionBy(*RAY).orderBy("distanceM", "elevationM")
    so_far, since = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*RAY, "crest").orderBy("distanceM", "elevationM").rowsBetween(Window.unboundedPreceding, 0)
    nearer = Window.partitionBy(*RAY).orderBy("distanceM", F.desc("altitudeDeg")).rowsBetween(Window.unboundedPreceding, -1)
    s = with_altitude(rays).withColumn("_high", F.max("altitudeDeg").over(nearer))
    wide = F.col("distanceM") - F.coalesce(F.lag("distanceM").over(order), num(0)) > spacing_m * MAX_SAMPLE_GAP_FACTOR
    s = s.withColumn("_wide", F.when(wide, 1).otherwise(0)).withColumn("bad", F.sum("_wide").over(so_far))
    crest = F.struct(F.col("altitudeDeg").alias("alt"), (-F.col("distanceM")).alias("near"), "elevationM", "bad")
    s = s.withColumn("crest", F.max(crest).over(so_far))
    s = s.withColumn("low", F.min(F.when(F.col("distanceM") > -F.col("crest.near"), F.col("elevationM"))).over(since))
    step = F.when(F.col("_high").isNull() | (F.col("altitudeDeg") > F.col("_high")), F.struct("distanceM", "altitudeDeg", "elevationM"))
    ground = F.when(F.col("distanceM") <= near_m, F.col("elevationM"))
    at = s.groupBy(*RAY).agg(F.sort_array(F.collect_list(F.struct("distanceM", "elevationM", "bad", "crest", "low"))).alias("s"), F.sort_array(F.collect_list(step)).alias("steps"), F.min(ground).alias("lowM"), F.max(ground).alias("highM"))
    return at.select(*RAY, F.col("s.distanceM").alias("distances"), F.transform("s", lambda x: F.struct(x["distanceM"].alias("distanceM"), x["bad"].alias("bad"), x["crest"].alias("crest"), x["low"].alias("low"))).alias("states"), "steps", "lowM", "highM")


def last_before(limit: Column) -> Column:
    """The state at the last sample of the nearest ray that is nearer than ``limit``; null if none is."""
    return F.get("states", F.size(F.filter("distances", lambda x: x < limit)) - 1)


def annotate(observers: DataFrame, summits: DataFrame, rays: DataFrame, swept_deg: list[float], radius_km: float, spacing_m: float, min_km: float = 0.2, near_m: float = 2000.0, tolerance_deg: float = 0.0, half_window_deg: float = 15.0) -> DataFrame:
    """The scene: each summit in reach with its status and, if it was judged, its verdict and class.

    status, first that holds: too-near, unmeasured-bearing, unmeasured-range, judged. visibility of the judged: marginal
    where ground too near to be resolved decides, visible, self-occluded, or foreground-occluded, with the evidence.
    """
    table = write_down(ray_table(rays, spacing_m, near_m), "rays")  # terrain is evaluated once; all that follows reads this
    seen = against_profile(sightings(observers, summits, radius_km), table.select(*RAY, "steps"))
    # bearings that were asked for and have no terrain: once for each observer
    missing = horizon_coverage(table, swept_deg).groupBy("observer_id").agg(F.collect_list("bearingDeg").alias("_missing"))
    seen = seen.join(missing, "observer_id", "left")
    between = F.exists("_missing", lambda u: ((u > F.col("_b")) & (u < F.col("_a"))) | ((u - 360 > F.col("_b")) & (u - 360 < F.col("_a"))) | ((u + 360 > F.col("_b")) & (u + 360 < F.col("_a"))))
    hole = F.coalesce(between, F.lit(False)) & (F.col("weight") != 0)
    own = table.select("observer_id", F.col("bearingDeg").alias("nearest"), "distances", "states")
    out = seen.withColumn("hole", hole).join(own, ["observer_id", "nearest"], "left")
    gap, d = num(spacing_m * MAX_SAMPLE_GAP_FACTOR), F.col("distanceM")
    out = out.withColumns({"_at": last_before(d), "_before": last_before(d * num(1 - COINCIDENT_DISTANCE_TOLERANCE))}).drop("states")
    whole = F.when(F.col("_at").isNull(), d <= gap).otherwise((F.col("_at.bad") == 0) & (d - F.col("_at.distanceM") <= gap))
    out = out.withColumn("measured", F.coalesce(whole & F.col("distances").isNotNull(), F.lit(False))).drop("distances", "_at")
    status = F.when(F.col("distanceKm") < min_km, "too-near").when(F.col("hole"), "unmeasured-bearing").when(~F.col("measured"), "unmeasured-range").otherwise("judged")

    # half the relief of the unresolvable ground around the observer, towards the summit
    near = table.where("lowM is not null").groupBy("observer_id").agg(F.collect_list(F.struct("bearingDeg", F.col("lowM").alias("low"), F.col("highM").alias("high"))).alias("_near"))  # one for each bearing
    out = out.join(near, "observer_id", "left").withColumn("_near", F.filter("_near", lambda n: F.abs(angular_difference_deg(F.col("bearingDeg"), n["bearingDeg"])) <= num(half_window_deg)))
    relief = F.greatest(F.array_max(F.col("_near.high")), F.col("groundElevationM")) - F.least(F.array_min(F.col("_near.low")), F.col("groundElevationM"))
    band_m = F.when(F.size("_near") > 0, relief / num(2)).otherwise(num(0))
    occluder_m = F.col("occluderDistanceKm") * num(1000)
    band = F.when((band_m > 0) & (occluder_m > 0) & (occluder_m < near_m), F.degrees(F.atan(band_m / occluder_m))).otherwise(num(0))
    out = out.withColumn("status", status).withColumn("clearanceBandDeg", F.coalesce(band, num(0)))
    high, low = F.col("clearanceDeg") + F.col("clearanceBandDeg") >= -tolerance_deg, F.col("clearanceDeg") - F.col("clearanceBandDeg") >= -tolerance_deg
    out = classify(out, spacing_m, tolerance_deg)
    visibility = F.when(high != low, "marginal").when(F.col("clearanceDeg") >= -tolerance_deg, "visible").otherwise(F.when(F.col("evidence") == "unbroken-rise-to-summit", "self-occluded").otherwise("foreground-occluded"))
    judged = F.col("status") == "judged"
    hidden = judged & F.col("visibility").isin("self-occluded", "foreground-occluded")
    out = out.withColumn("visibility", F.when(judged, visibility))
    return out.select(
        "observer_id", "id", "bearingDeg", "distanceKm", "altitudeDeg", "status", F.when(judged, F.col("occludingAltitudeDeg")).alias("occludingAltitudeDeg"), F.when(judged, F.col("clearanceDeg")).alias("clearanceDeg"),
        F.when(judged, F.col("clearanceBandDeg")).alias("clearanceBandDeg"), "visibility", F.when(hidden, F.col("evidence")).alias("evidence"), F.when(hidden, F.col("crestDistanceKm")).alias("crestDistanceKm"), F.when(hidden, F.col("colDepthM")).alias("colDepthM"),
    )


def classify(seen: DataFrame, spacing_m: float, tolerance_deg: float = 0.0) -> DataFrame:
    """Adds evidence, crestDistanceKm and colDepthM from ``_before``, the state of the nearest ray at the last sample before each sighting."""
    crest, gap = F.col("_before.crest"), num(spacing_m * MAX_SAMPLE_GAP_FACTOR)
    blocked = F.coalesce(crest["alt"] > F.col("altitudeDeg") + num(tolerance_deg), F.lit(False))
    covered = (F.col("_before.bad") == crest["bad"]) & (F.col("distanceM") - F.col("_before.distanceM") <= gap)
    depth = F.coalesce(F.greatest(num(0), crest["elevationM"] - F.col("_before.low")), num(0))
    evidence = F.when(~blocked, "occluder-not-on-this-ray").when(~covered, "unsampled-gap-between-occluder-and-summit").when(depth > 0, "col-between-occluder-and-summit").otherwise("unbroken-rise-to-summit")
    return seen.withColumn("evidence", evidence).withColumn("crestDistanceKm", F.when(blocked, -crest["near"] / num(1000))).withColumn("colDepthM", F.when(blocked & covered, depth)).drop("_before")


def horizon_coverage(rays: DataFrame, swept_deg: list[float]) -> DataFrame:
    """observer_id, bearingDeg of the swept bearings without any terrain."""
    wanted = rays.select("observer_id").distinct().select("observer_id", F.explode(F.array(*map(num, sorted({b % 360 for b in swept_deg})))).alias("bearingDeg"))
    return wanted.join(rays.select(*RAY).distinct(), list(RAY), "left_anti")


def near_field(rays: DataFrame, radius_m: float) -> DataFrame:
    """How many bearings' horizons rest on ground nearer than the radius, their share, and the highest of them."""
    profile = horizon_profile(rays)
    near = F.col("distanceKm") * num(1000) < radius_m
    return profile.groupBy("observer_id").agg(F.count("*").alias("bearings"), F.count(F.when(near, 1)).alias("near"), F.coalesce(F.max(F.when(near, F.col("altitudeDeg"))), num(0)).alias("maxAltitudeDeg")).withColumn("fraction", F.col("near") / F.col("bearings"))


def profile_coverage(profile: DataFrame, gap_multiple: float = 4.0) -> DataFrame:
    """The one large gap of each observer's profile, if it is wider than so many median gaps."""
    order = Window.partitionBy("observer_id").orderBy("bearingDeg")
    whole = Window.partitionBy("observer_id")
    gaps = profile.select("observer_id", "bearingDeg", (F.coalesce(F.lead("bearingDeg").over(order), F.min("bearingDeg").over(whole) + num(360)) - F.col("bearingDeg")).alias("gap"))
    found = gaps.groupBy("observer_id").agg(F.max(F.struct(F.col("gap"), (-F.col("bearingDeg")).alias("start"))).alias("g"), F.sort_array(F.collect_list("gap")).alias("all"))
    wide = F.col("g.gap") > F.element_at("all", (F.size("all") / 2).cast("int") + 1) * num(gap_multiple)
    return found.select("observer_id", F.when(wide, -F.col("g.start") + num(0)).alias("gapFromDeg"), F.when(wide, F.pmod(F.col("g.gap") - F.col("g.start"), num(360))).alias("gapToDeg"), F.when(wide, num(360) - F.col("g.gap")).otherwise(num(360)).alias("coveredSpanDeg"))


def peaks_for(areas: DataFrame, summits: DataFrame, allow_empty: bool = False) -> DataFrame:
    """key, id, distanceM of the summits in areas: circles (key, lat, lon, radiusKm) sorted by ``nth``, nearest first.

    An area without a summit is a row with reason 'empty-result', unless ``allow_empty``.
    """
    d = areas.select("key", *[x.alias(k) for k, x in bounding_box(F.col("lat"), F.col("lon"), F.col("radiusKm")).items()]).withColumnRenamed("key", "observer_id")
    near = within_boxes(d, summits.select("id", F.col("lat"), F.col("lon"))).withColumnRenamed("observer_id", "key")
    centre = areas.select("key", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "radiusKm")
    found = near.join(centre, "key").withColumn("distanceM", haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).where("distanceM <= radiusKm * 1000")
    found = found.select("key", "id", "distanceM", F.row_number().over(Window.partitionBy("key").orderBy("distanceM", "id")).cast("long").alias("nth"))
    if allow_empty:
        return found.withColumn("reason", F.lit(None).cast("string"))
    empty = areas.select("key").join(found.select("key").distinct(), "key", "left_anti").withColumn("reason", F.lit("empty-result"))
    return found.unionByName(empty, allowMissingColumns=True)


def stored_within_radius(observers: DataFrame, store: DataFrame, radius_km: float) -> DataFrame:
    """within_radius() over a store of summits partitioned by ``cell`` (landforms.write_cells): partitions that no circle touches are pruned at run time.

    The cells that observers need are the small side of a join on the partition column, so their names, once known, prune the
    store's folders before a file is opened.
    """
    box = bounding_box(F.col("lat"), F.col("lon"), radius_km)
    rows = F.sequence(F.floor(box["south"]).cast("int"), F.least(F.lit(89), F.floor(box["north"]).cast("int")))
    columns = F.when(box["east"] - box["west"] >= 359, F.sequence(F.lit(-180), F.lit(179))).otherwise(F.sequence(F.floor(box["west"]).cast("int"), F.floor(box["east"]).cast("int")))
    cells = observers.select(F.explode(rows).alias("_r"), columns.alias("_cs")).select("_r", F.explode("_cs").alias("_c"))
    needed = cells.select(cell_name(F.col("_r").cast("double"), F.col("_c").cast("double")).alias("cell")).distinct()  # at most one for each square degree
    needed = needed.where((F.col("cell") >= "N") & (F.col("cell") < "T"))  # all names; Spark prunes by a side only if it is filtered
    near = store.join(F.broadcast(needed), "cell", "left_semi")
    return within_radius(observers, near, radius_km)
