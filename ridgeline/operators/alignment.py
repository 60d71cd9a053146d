"""How far a camera's heading and pitch are off, from its photograph's skyline against the terrain's profile - or why nothing can be said.

Each level scores candidates: the skylines of an image and the arcs of its profile (an arc is two neighbouring bearings) meet by
one shuffle for all levels, and weighted sums over a skyline's columns, in arrays, give correlation, relief and misfit of each
candidate. The levels are headings (at no change of pitch, by a correlation that no constant offset changes), then pitches (by
misfit), then a small grid of both about what was found, with the exact rotation.

Tables: skyline (key, image, bearingDeg, altitudeDeg, weight, headingDeg) as skyline.observations() gives it with the camera's
heading; columns (key, columns: how many columns a skyline has); profile (image, bearingDeg, altitudeDeg). A key is one
alignment; several keys may share an image's profile. A task holds one image's skylines and arcs at once, some hundred rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ridgeline.functions.geodesy import angular_difference_deg, clamp, num
from ridgeline.operators.visibility import profile_coverage
from ridgeline.shipping import ship

# Bounds below (above, for misfit) which nothing is said, and from which on nothing is wrong.
MIN_USED, GOOD_USED = 0.25, 0.5
MIN_RELIEF_DEG, GOOD_RELIEF_DEG = 0.35, 1.0
MIN_SCORE, GOOD_SCORE = 0.35, 0.9
MIN_MARGIN, GOOD_MARGIN = 0.03, 0.25
MAX_RESIDUAL_DEG, GOOD_RESIDUAL_DEG = 1.5, 0.4
PEAK_EXCLUSION_DEG = 2.0
GRID, HEADING_STEPS, PITCH_STEPS = 12, 1.5, 3.0
COMPASS_BUDGET_DEG, NEAR_FIELD_M, COMB_STEP_DEG, COMB_HALF_DEG, COMB_HEADING_STEP = 6.0, 150.0, 1.0, 0.6, 0.1
LOWEST, GAP_MULTIPLE = float("-inf"), 4.0
_POSED = ("key", "image", "bearingDeg", "altitudeDeg", "weight", "headingDeg")


def arcs(profile: DataFrame) -> DataFrame:
    """image, start, end, a, b: what lies between neighbouring bearings; a profile's one hole has none."""
    order, whole = Window.partitionBy("image").orderBy("bearingDeg"), Window.partitionBy("image")
    points = profile.select("image", "bearingDeg", "altitudeDeg").dropDuplicates(["image", "bearingDeg"])
    nxt, first = F.lead("bearingDeg").over(order), F.min("bearingDeg").over(whole)
    pairs = points.select(
        "image", F.col("bearingDeg").alias("start"), F.coalesce(nxt, first + num(360)).alias("end"), F.col("altitudeDeg").alias("a"),
        F.coalesce(F.lead("altitudeDeg").over(order), F.min_by("altitudeDeg", "bearingDeg").over(whole)).alias("b"), F.count("*").over(whole).alias("_n"),
    ).where("_n > 1").drop("_n")
    hole = profile_coverage(points.withColumnRenamed("image", "observer_id"), GAP_MULTIPLE).select(F.col("observer_id").alias("image"), "gapFromDeg")
    return pairs.join(hole.hint("merge"), "image").where(F.col("gapFromDeg").isNull() | (F.col("start") != F.col("gapFromDeg"))).drop("gapFromDeg")


def arcs_of(bearing: np.ndarray, altitude: np.ndarray) -> dict[str, np.ndarray]:
    """arcs() of one image's profile, by their starts."""
    known = ~np.isnan(bearing)
    start, first = np.unique(bearing[known], return_index=True)
    if len(start) < 2:
        return {k: np.zeros(0) for k in ("start", "end", "a", "b")}
    a, end = altitude[known][first], np.append(start[1:], start[0] + 360.0)
    gap = end - start
    wide = int(gap.argmax())
    kept = np.ones(len(start), bool)
    kept[wide] = gap[wide] <= np.sort(gap)[len(gap) // 2] * GAP_MULTIPLE
    return {k: x[kept] for k, x in {"start": start, "end": end, "a": a, "b": np.roll(a, -1)}.items()}


def folded(x: np.ndarray) -> np.ndarray:
    """geodesy.fold() of an array."""
    low, high = (x.min(), x.max()) if x.size else (0.0, 0.0)
    if not (low >= -360.0 and high < 720.0):
        turn = np.mod(x, 360.0)
    elif low >= 0.0 and high < 360.0:  # within a turn of it sums are the same, without a division
        return x + 0.0
    else:
        turn = x - 360.0 if low >= 360.0 else x + 360.0 if high < 0.0 else np.where(x < 0.0, x + 360.0, np.where(x >= 360.0, x - 360.0, x))
    return np.where(turn >= 360.0, 0.0, turn) + 0.0


def met(bearing: np.ndarray, altitude: np.ndarray, weight: np.ndarray, arc: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Weights (0 off the profile), altitudes, the profile's, how many columns meet it and their weight, of each candidate (a row of bearings and altitudes)."""
    at = folded(bearing)
    arc_of = np.searchsorted(arc["start"], at, side="right") - 1  # the last one goes on across north
    start, width, a, rise = (x.take(arc_of, mode="wrap") for x in (arc["start"], arc["end"] - arc["start"], arc["a"], arc["b"] - arc["a"]))
    inside = at - start
    if inside.size and inside.min() < 0.0:
        inside = np.where(inside < 0.0, inside + 360.0, inside)
    on = inside < width
    with np.errstate(all="ignore"):
        p = a + inside / width * rise
    if on.all():
        w, o, used, total = weight, altitude, np.full(len(on), on.shape[1]), np.full(len(on), weight.sum())
    else:
        w, o, p, used = np.where(on, weight, 0.0), np.where(on, altitude, 0.0), np.where(on, p, 0.0), on.sum(axis=1)
        total = w.sum(axis=1)
    return w, o, p, np.where((total > 0) & (used > 1), used, 0), total


def misfits(bearing: np.ndarray, altitude: np.ndarray, weight: np.ndarray, arc: dict[str, np.ndarray]) -> np.ndarray:
    """residualDeg of each candidate; no finite number where there is nothing to say."""
    w, o, p, used, total = met(bearing, altitude, weight, arc)
    with np.errstate(all="ignore"):
        return np.where(used > 0, np.round(np.sqrt((w * ((o - p) * (o - p))).sum(axis=1) / total), 9), np.inf)


def fits(bearing: np.ndarray, altitude: np.ndarray, weight: np.ndarray, arc: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """used, score, photoReliefDeg, profileReliefDeg, residualDeg of each candidate; used is 0 where there is nothing to say."""
    w, o, p, used, total = met(bearing, altitude, weight, arc)
    with np.errstate(all="ignore"):
        mo, mp, oo, pp, op, rr = ((w * x).sum(axis=1) / total for x in (o, p, o * o, p * p, o * p, (o - p) * (o - p)))
        photo, terrain = np.maximum(0.0, oo - mo * mo), np.maximum(0.0, pp - mp * mp)
        spread = np.sqrt(photo * terrain)
        score = np.where(spread > 1e-12, (op - mo * mp) / spread, 0.0)
    return {"used": used, "score": score, "photoReliefDeg": np.sqrt(photo), "profileReliefDeg": np.sqrt(terrain), "residualDeg": np.sqrt(rr)}


def by_key(skyline: DataFrame, arc: DataFrame, run: Callable, fields: str) -> DataFrame:
    """key and ``fields`` that ``run`` (rows of one key as arrays, arcs of its image as arrays) finds, as many rows as it gives.

    ``arc``: arcs (none: nothing is found) or a profile, whose arcs are made on the way (``run`` gets them even if there are none).
    They meet skylines by image: a few hundred rows of each, whatever the number of candidates.
    """
    ship(skyline.sparkSession)
    schema = f"key {skyline.schema['key'].dataType.simpleString()}, {fields}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    names = [c for c in skyline.columns if c not in ("key", "image")]
    made = "start" not in arc.columns
    sides = ["bearingDeg", "altitudeDeg"] if made else ["start", "end", "a", "b"]

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not (made or right.num_rows):
            return kinds.empty_table()
        parts = {c: right.column(c).to_numpy() for c in sides}
        if made:
            parts = arcs_of(*parts.values())
        else:
            order = np.argsort(parts["start"], kind="stable")
            parts = {c: x[order] for c, x in parts.items()}
        columns = {c: left.column(c).to_numpy() for c in names}
        rows: dict[str, list[int]] = {}
        for i, key in enumerate(left.column("key").to_pylist()):
            rows.setdefault(repr(key), []).append(i)
        out, firsts = [], []
        for at in rows.values():
            found = run({c: v[at] for c, v in columns.items()}, parts)
            out.append(found)
            firsts += [at[0]] * len(next(iter(found.values())))
        values = [pa.array(np.concatenate([x[f.name] for x in out]), f.type, from_pandas=True) for f in list(kinds)[1:]]
        return pa.Table.from_arrays([left.column("key").take(pa.array(firsts, pa.int64())).combine_chunks().cast(kinds.field(0).type), *values], schema=kinds)

    return skyline.groupBy("image").cogroup(arc.select("image", *sides).groupBy("image")).applyInArrow(match, schema)


def tilted(rows: dict[str, np.ndarray], pitches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bearings and altitudes (a row for each pitch) after a tilt about the level axis across the frame (exact rotation; a turn only adds to the bearing)."""
    b, a, h, t = (np.radians(x) for x in (rows["bearingDeg"], rows["altitudeDeg"], rows["headingDeg"], pitches[:, None]))
    e, n, u = np.sin(b) * np.cos(a), np.cos(b) * np.cos(a), np.sin(a)
    x, y, cosine, sine = np.cos(h), -np.sin(h), np.cos(t), np.sin(t)
    along = (x * e + y * n) * (1.0 - cosine)
    east, north, up = e * cosine + y * u * sine + x * along, n * cosine - x * u * sine + y * along, u * cosine + (x * n - y * e) * sine
    return folded(np.degrees(np.arctan2(east, north))), np.degrees(np.arcsin(np.clip(up, -1.0, 1.0)))


def parabola(left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place of the extremum of three neighbouring values, within half a step."""
    with np.errstate(all="ignore"):
        curve = left - 2.0 * centre + right
        at = 0.5 * (left - right) / curve
    return np.where((np.abs(curve) >= 1e-12) & np.isfinite(curve) & np.isfinite(at), np.clip(at, -0.5, 0.5), 0.0)


def beside(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row the value at a place and its neighbours (itself at an end): left, centre, right."""
    rows, last = np.arange(len(x)), x.shape[1] - 1
    return x[rows, np.maximum(at - 1, 0)], x[rows, at], x[rows, np.minimum(at + 1, last)]


def turned(rows: dict[str, np.ndarray], arc: dict[str, np.ndarray], turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """used and score (the lowest where too little meets the profile) of every turn."""
    found = fits(rows["bearingDeg"] + turns[:, None], np.broadcast_to(rows["altitudeDeg"], (len(turns), len(rows["altitudeDeg"]))), rows["weight"], arc)
    return found["used"], np.where(found["used"] >= max(2.0, len(rows["weight"]) * MIN_USED), np.round(found["score"], 9), LOWEST)


def heading_scores(skyline: DataFrame, arc: DataFrame, offsets: list[float]) -> DataFrame:
    """key, k, offset, used, score of every heading offset that enough of the skyline meets the profile at."""
    turns = np.array(offsets)

    def run(rows: dict[str, np.ndarray], arc: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        used, score = turned(rows, arc, turns)
        k = np.flatnonzero(score > LOWEST)
        return {"k": k, "offset": turns[k], "used": used[k], "score": score[k]}

    return by_key(skyline.select("key", "image", "bearingDeg", "altitudeDeg", "weight"), arc, run, "k int, offset double, used bigint, score double")


def best_headings(score: np.ndarray, first: float, step: float) -> dict[str, np.ndarray]:
    """heading (between candidates), peak, margin over the best score outside the peak's own basin, atEdge of rows of scores of evenly spaced headings."""
    k, last, least = np.arange(score.shape[1]), score.shape[1] - 1, -int(-PEAK_EXCLUSION_DEG // step)
    best = score.argmax(axis=1)
    left, peak, right = beside(score, best)
    # a basin ends where the curve rises again, or with the window
    falls, at = np.ones(score.shape, bool), best[:, None]
    falls[:, 1:] = score[:, :-1] > score[:, 1:]
    low = np.where(falls & (k <= at), k, -1).max(axis=1)
    rises = np.ones(score.shape, bool)
    rises[:, :-1] = score[:, 1:] > score[:, :-1]
    high = np.where(rises & (k >= at), k, last + 1).min(axis=1)
    outside = (k < np.minimum(low, best - least)[:, None]) | (k > np.maximum(high, best + least)[:, None])
    rival = np.where(outside, score, LOWEST).max(axis=1)
    margin = np.where(rival > LOWEST, peak - np.where(rival > LOWEST, rival, 0.0), peak)
    return {"heading": first + best * step + step * parabola(left, peak, right), "peak": peak, "margin": margin, "atEdge": (best == 0) | (best == last)}


def locked_headings(skyline: DataFrame, profile: DataFrame, offsets: list[float], step: float) -> DataFrame:
    """key, heading, peak, margin, atEdge: best_headings() of every skyline that meets its profile at any offset. Scores are arrays of one key, no rows."""
    turns = np.array(offsets)

    def run(rows: dict[str, np.ndarray], arc: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        score = turned(rows, arc, turns)[1][None] if len(arc["start"]) else np.zeros((1, 0))
        return best_headings(score if (score > LOWEST).any() else score[:0].reshape(0, len(turns)), offsets[0], step)

    return by_key(skyline.select("key", "image", "bearingDeg", "altitudeDeg", "weight"), profile, run, "heading double, peak double, margin double, atEdge boolean")


_FIT = ("score", "photoReliefDeg", "profileReliefDeg", "residualDeg")


def searched(skyline: DataFrame, profile: DataFrame, centres: list[float], offsets: list[float], step: float, pitches: list[float], pitch_step: float) -> DataFrame:
    """key, window, observed, heading, pitch, peak, margin, atEdge and the fit there: all levels of each key's search about each of ``centres`` (turns of its camera).

    Of a key all windows are found at once from one copy of its rows. What a level doesn't find is null.
    """
    m, tilts, search_pitch = len(centres), np.array(pitches), len(pitches) > 1
    spans = HEADING_STEPS * step, PITCH_STEPS * pitch_step if search_pitch else 0.0
    grid = [np.array([2 * span * i / GRID - span for i in range(n)]) for span, n in ((spans[0], GRID + 1), (spans[1], GRID + 1 if search_pitch else 1))]
    turns = (np.array(centres)[:, None] + np.array(offsets)).ravel()
    at_turn, at_tilt = (x.ravel() for x in np.meshgrid(*grid, indexing="ij"))

    def run(rows: dict[str, np.ndarray], arc: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {c: np.full(m, np.nan) for c in ("heading", "pitch", "peak", "margin", "used", *_FIT)} | {"atEdge": np.zeros(m, bool), "window": np.arange(m), "observed": np.full(m, len(rows["weight"]))}
        if not len(arc["start"]):
            return out
        weight, score = rows["weight"], turned(rows, arc, turns)[1].reshape(m, -1)
        said = np.flatnonzero((score > LOWEST).any(axis=1))
        if not len(said):
            return out
        lock = best_headings(score[said], offsets[0], step)
        for c in ("peak", "margin", "atEdge"):
            out[c][said] = lock[c]
        tilt = np.zeros(len(said))
        heading = np.array(centres)[said] + lock["heading"]
        if search_pitch:
            # a turn only adds to the bearings of a tilt
            bearing, altitude = tilted(rows, tilts)
            cost = np.stack([misfits(bearing + h, altitude, weight, arc) for h in heading])
            k = cost.argmin(axis=1)
            left, least, right = beside(cost, k)
            tilt = np.where(np.isfinite(least), tilts[0] + k * pitch_step + pitch_step * parabola(left, least, right), 0.0)
        for w, h, t, own in zip(said, heading, tilt, lock["heading"], strict=True):
            bearing, altitude = tilted(rows, t + grid[1])
            cost = misfits(((bearing + h)[None] + grid[0][:, None, None]).reshape(-1, len(weight)), np.tile(altitude, (len(grid[0]), 1)), weight, arc)
            k = int(cost.argmin())
            if np.isfinite(cost[k]):
                one = k % len(grid[1])
                fit = fits((bearing[one] + h + at_turn[k])[None], altitude[one][None], weight, arc)
                out["heading"][w], out["pitch"][w] = own + at_turn[k], t + at_tilt[k]
                for c in ("used", *_FIT):
                    out[c][w] = fit[c][0]
        return out

    fields = "window int, observed bigint, heading double, pitch double, peak double, margin double, atEdge boolean, used double, " + ", ".join(f"{c} double" for c in _FIT)
    return by_key(skyline.select(*_POSED), profile, run, fields).withColumn("used", F.col("used").cast("long"))


def ramp(x: Column, low: float, high: float) -> Column:
    sound = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return F.coalesce(clamp((sound - num(low)) / num(high - low), 0, 1), num(0))


def steps(half: float, step: float) -> list[float]:
    """Evenly from -half to half."""
    return [-half + i * step for i in range(round(2 * half / step) + 1)]


def align_skylines(
    skyline: DataFrame, columns: DataFrame, profile: DataFrame, heading_range: float = 25.0, heading_step: float = 0.2, pitch_range: float = 10.0, pitch_step: float = 0.1, search_pitch: bool = True,
) -> DataFrame:
    """One row for each key of ``columns``: status (aligned, low-confidence, failed), reason, offsets, confidence01, concerns and diagnostics.

    A failure has a reason and no offsets. Reasons, the most fundamental first: profile-does-not-cover-frame, insufficient-skyline,
    featureless-terrain-profile, featureless-photo-skyline, no-correlation, search-range-exhausted, ambiguous-correlation, residual-too-large.
    """
    return aligned_windows(skyline, columns, profile, [0.0], heading_range, heading_step, pitch_range, pitch_step, search_pitch).drop("window")


def aligned_windows(
    skyline: DataFrame, columns: DataFrame, profile: DataFrame, centres: list[float], heading_range: float, heading_step: float, pitch_range: float = 10.0, pitch_step: float = 0.1, search_pitch: bool = True,
) -> DataFrame:
    """align_skylines() about each of ``centres`` (turns of the camera, by which offsets are less): one row for each key and window."""
    if not (heading_range > 0 and heading_step > 0):
        raise ValueError("the heading's range and step must be above 0")
    found = searched(skyline, profile, centres, steps(heading_range, heading_step), heading_step, steps(pitch_range, pitch_step) if search_pitch else [0.0], pitch_step)
    # two bearings are an arc at least
    points = profile.groupBy("image").agg((F.min("bearingDeg") < F.max("bearingDeg")).alias("_points")).where("_points")
    units = columns.select("key", "image", "columns").join(points.hint("merge"), "image", "left")
    units = units.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(len(centres) - 1))))
    out = units.join(found.hint("merge"), ["key", "window"], "left").fillna(0, ["observed"])
    total = F.greatest(F.lit(1), F.col("columns"))
    early = F.when(F.col("_points").isNull(), "profile-does-not-cover-frame").when(F.col("observed") / total < MIN_USED, "insufficient-skyline")
    out = out.withColumn("early", early)
    # what is too little to be tried has no fit
    out = out.withColumns({c: F.when(F.col("early").isNull(), F.col(c)) for c in ("heading", "pitch", "peak", "margin", "atEdge", "used", *_FIT)})
    # without a fit there is nothing to measure
    out = out.withColumns({"usedFraction01": F.coalesce(F.col("used"), F.col("observed")) / total, "relief": F.least("photoReliefDeg", "profileReliefDeg")})
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("peak").isNull() | (F.col("peak") == LOWEST), "profile-does-not-cover-frame")
        .when(F.col("used").isNull() | (F.col("usedFraction01") < MIN_USED), "insufficient-skyline").when(F.col("profileReliefDeg") < MIN_RELIEF_DEG, "featureless-terrain-profile")
        .when(F.col("photoReliefDeg") < MIN_RELIEF_DEG, "featureless-photo-skyline").when(F.col("score") < MIN_SCORE, "no-correlation").when(F.col("atEdge"), "search-range-exhausted")
        .when(F.col("margin") < MIN_MARGIN, "ambiguous-correlation").when(F.col("residualDeg") > MAX_RESIDUAL_DEG, "residual-too-large")
    )
    worries = F.array_compact(F.array(
        F.when(F.col("usedFraction01") < GOOD_USED, "insufficient-skyline"), F.when(F.col("score") < GOOD_SCORE, "no-correlation"), F.when(F.col("margin") < GOOD_MARGIN, "ambiguous-correlation"),
        F.when(F.col("residualDeg") > GOOD_RESIDUAL_DEG, "residual-too-large"), F.when(F.col("relief") < GOOD_RELIEF_DEG, "featureless-terrain-profile"),
    ))
    sure = (
        ramp(F.col("usedFraction01"), MIN_USED, GOOD_USED) * ramp(F.col("score"), MIN_SCORE, GOOD_SCORE) * ramp(F.col("margin"), MIN_MARGIN, GOOD_MARGIN)
        * ramp(-F.col("residualDeg"), -MAX_RESIDUAL_DEG, -GOOD_RESIDUAL_DEG) * ramp(F.col("relief"), MIN_RELIEF_DEG, GOOD_RELIEF_DEG)
    )
    out = out.withColumn("reason", reason)
    said = F.col("reason").isNull()
    status = F.when(~said, "failed").when(F.size(worries) > 0, "low-confidence").otherwise("aligned")
    return out.select(
        "key", "image", "window", status.alias("status"), "reason", F.when(said, F.col("heading")).alias("headingOffsetDeg"), F.when(said, F.col("pitch")).alias("pitchOffsetDeg"),
        F.when(said, sure).alias("confidence01"), F.when(said, worries).alias("concerns"), "usedFraction01", "score", "margin", "residualDeg", "photoReliefDeg", "profileReliefDeg", F.coalesce("atEdge", F.lit(False)).alias("atSearchEdge"),
    )


def suggested_trims(skyline: DataFrame, cameras: DataFrame, profile: DataFrame, budget: float = COMPASS_BUDGET_DEG, near_field_m: float = NEAR_FIELD_M) -> DataFrame:
    """One row for each image of ``cameras`` (image, headingDeg, hFovDeg, columns): a trim within what a compass may be wrong by, or why there is none.

    The budget is searched by a comb of narrow windows that overlap; a window whose best is at its rim says nothing. Of what is
    left, one of two that lie within half a step stays (the better), and the nearest to the compass is suggested; the others are
    listed. A profile that rests on ground nearer than ``near_field_m`` anywhere in reach is declined first. profile: also distanceKm.
    """
    if not budget > 0:
        raise ValueError("the compass's budget must be above 0")
    centres = [-budget + i * COMB_STEP_DEG for i in range(int(2 * budget / COMB_STEP_DEG + 1e-9) + 1)]
    reach = F.col("hFovDeg") / num(2) + num(budget)
    near = profile.where(F.col("distanceKm") * 1000 < near_field_m).join(cameras.select("image", "headingDeg", "hFovDeg").hint("merge"), "image")
    near = near.where(F.abs(angular_difference_deg(F.col("headingDeg"), F.col("bearingDeg"))) <= reach).groupBy("image").agg(F.count("*").alias("nearPoints"))
    tried = cameras.select(F.col("image").alias("key"), "image", "columns").join(near.hint("merge"), "image", "left_anti")
    posed = skyline.withColumn("key", F.col("image")).join(near.hint("merge"), "image", "left_anti")
    found = aligned_windows(posed, tried, profile, centres, COMB_HALF_DEG, COMB_HEADING_STEP)
    found = found.withColumn("total", F.element_at(F.array(*map(num, centres)), F.col("window") + 1) + F.col("headingOffsetDeg"))
    fits = F.when((F.col("status") != "failed") & (F.abs("total") <= budget + 1e-9), F.struct("window", "total", F.col("pitchOffsetDeg").alias("pitch"), F.col("score").alias("score"), "status", "confidence01"))
    wrong = F.when(F.col("reason") != "search-range-exhausted", F.struct("window", "reason"))
    by_image = found.groupBy("image").agg(F.sort_array(F.collect_list(fits)).alias("fits"), F.min(wrong).alias("wrong"))

    def merge(kept: Column, x: Column) -> Column:
        same = F.transform(kept, lambda e: F.abs(e["total"] - x["total"]) < num(COMB_STEP_DEG / 2))
        first = F.array_position(same, F.lit(True))
        better = F.transform(kept, lambda e, i: F.when((i + 1 == first) & (x["score"] > e["score"]), x).otherwise(e))
        return F.when(first > 0, better).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("fits", F.slice("fits", 1, 0), merge)
    nearest = F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(F.abs(e["total"]).alias("far"), e["window"].alias("nth"), e.alias("e")))), lambda x: x["e"])
    listed = cameras.select("image").join(by_image.withColumn("kept", nearest), "image", "left").join(near, "image", "left")
    best = F.get("kept", F.lit(0))
    declined = F.when(F.col("nearPoints") > 0, "near-field-in-profile").when(best.isNull(), "no-alignment")
    return listed.select(
        "image", F.when(declined.isNull(), "suggested").otherwise("declined").alias("status"), declined.alias("reason"),
        F.when(declined == "near-field-in-profile", F.col("nearPoints").cast("string")).when(declined == "no-alignment", F.coalesce("wrong.reason", F.lit("every window ran to its rim"))).alias("detail"),
        F.when(declined.isNull(), best["total"]).alias("headingTrimDeg"), F.when(declined.isNull(), best["pitch"]).alias("pitchTrimDeg"), F.when(declined.isNull(), best["confidence01"]).alias("confidence01"),
        F.when(declined.isNull(), F.transform(F.slice("kept", 2, F.greatest(F.lit(0), F.size("kept") - 1)), lambda e: e["total"])).alias("otherHeadingsDeg"),
    )
