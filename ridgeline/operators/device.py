"""Readings of a device's sensors, a pose from them, and a stored scene drawn for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import camera as cam
from ridgeline.functions.geodesy import fold, num

# Standard gravity, and the accuracy that each calibration class of a compass stands for.
GRAVITY_MS2 = 9.80665
ACCURACY_DEG = [-1.0, 50.0, 35.0, 20.0]
DRAWN_SPAN_FACTOR = 1.5


def _finite(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return out


def gravity_samples(motion: DataFrame) -> DataFrame:
    """device, ms, x, y, z (in g), contaminated, refusal of motion events (device, ms, gravity struct, linear struct).

    Gravity is what is left when the device's own movement is taken away; where that is not known the sample is contaminated. The
    stamp is the time of receipt.
    """
    g, own = F.col("gravity"), F.col("linear")
    contaminated = own.isNull() | ~_finite(own["x"], own["y"], own["z"])
    refusal = F.when(g.isNull(), "no-gravity-channel").when(~_finite(g["x"], g["y"], g["z"]), "not-finite")
    axis = lambda k: F.when(refusal.isNull(), (g[k] - F.when(contaminated, num(0)).otherwise(own[k])) / num(GRAVITY_MS2))
    return motion.select("device", "ms", axis("x").alias("x"), axis("y").alias("y"), axis("z").alias("z"), F.when(refusal.isNull(), contaminated).alias("contaminated"), refusal.alias("refusal"))


def heading_samples(readings: DataFrame) -> DataFrame:
    """device, ms, trueDeg, magneticDeg, accuracyDeg, refusal of compass events (device, ms, trueHeading, magHeading, bucket).

    Negative or undefined headings are none; a bucket that there isn't says that the compass is not calibrated (-1).
    """
    known = lambda c: F.when(_finite(F.col(c)) & (F.col(c) >= 0), F.col(c))
    refusal = F.when(known("trueHeading").isNull() & known("magHeading").isNull(), "no-heading")
    at = F.when((F.col("bucket") == F.floor("bucket")) & F.col("bucket").between(0, 3), F.col("bucket").cast("int"))
    accuracy = F.coalesce(F.get(F.array(*map(num, ACCURACY_DEG)), at), num(-1))
    return readings.select("device", "ms", known("trueHeading").alias("trueDeg"), known("magHeading").alias("magneticDeg"), F.when(refusal.isNull(), accuracy).alias("accuracyDeg"), refusal.alias("refusal"))


def pose_with_sensors(poses: DataFrame, answers: DataFrame) -> DataFrame:
    """Poses (key, headingDeg, pitchDeg, rollDeg) with the fields that sensors answered (key, heading, pitch, roll; null: no answer) and their names."""
    out = poses.join(answers, "key", "left")
    pairs = [("heading", "headingDeg"), ("pitch", "pitchDeg"), ("roll", "rollDeg")]
    applied = F.array_compact(F.array(*[F.when(F.col(a).isNotNull(), F.lit(a)) for a, _ in pairs]))
    return out.select("key", *[F.coalesce(a, b).alias(b) for a, b in pairs], F.concat_ws(",", applied).alias("applied"))


def uncovered_span_deg(heading: Column, hfov: Column, start: Column, span: Column) -> Column:
    """Degrees of the drawn span that a swept sector doesn't cover."""
    wide = F.least(num(360), hfov * num(DRAWN_SPAN_FACTOR))
    offset = fold(heading - wide / num(2) - start)
    direct = F.when(offset < span, F.least(span - offset, wide)).otherwise(num(0))
    wrapped = F.greatest(num(0), F.least(offset + wide - num(360), span))
    return F.when(span >= 360, num(0)).otherwise(wide - direct - wrapped)


def live_overlay(ticks: DataFrame, scenes: DataFrame, peaks: DataFrame) -> DataFrame:
    """tick, id, reason, x, y, inFrame: each tick's pose over its stored scene; 'resweep-needed' where the view leaves the swept sector.

    ticks (a table or a stream): scene, tick, headingDeg, pitchDeg, rollDeg, hFovDeg, vFovDeg; scenes: scene, startDeg, spanDeg;
    peaks: scene, id, bearingDeg, altitudeDeg. Both joins are by scene, so a stream needs no state.
    """
    seen = ticks.join(scenes, "scene")
    open_deg = uncovered_span_deg(F.col("headingDeg"), F.col("hFovDeg"), F.col("startDeg"), F.col("spanDeg"))
    seen = seen.withColumn("uncoveredDeg", open_deg)
    drawn = seen.where("uncoveredDeg <= 0").join(peaks, "scene")
    at = cam.project(*[F.col(c) for c in ("headingDeg", "pitchDeg", "rollDeg", "hFovDeg", "vFovDeg", "bearingDeg", "altitudeDeg")])
    placed = drawn.select("tick", "id", F.lit(None).cast("string").alias("reason"), at["x"].alias("x"), at["y"].alias("y"), at["inFrame"].alias("inFrame"), "uncoveredDeg")
    return placed.unionByName(seen.where("uncoveredDeg > 0").select("tick", F.lit("resweep-needed").alias("reason"), "uncoveredDeg"), allowMissingColumns=True)


def drag_trim_deg(start: Column, end: Column, size: Column, fov: Column) -> Column:
    """Angle between two places of a frame along one side, as a drag from one to the other turns the view."""
    def angle(px: Column) -> Column:
        return F.degrees(F.atan((px - size / num(2)) / (size / num(2)) * F.tan(F.radians(fov / num(2)))))

    return F.when((size > 0) & (fov > 0), angle(end) - angle(start)).otherwise(num(0)) + num(0)
