"""Compass and gravity traces at given instants: trailing windows, exponential weights, circular means, refusals.

A trace joins its device's instants by equality and a closed time window; each answer is one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import clamp, fold, num

MAX_AGE_MS, TIME_CONSTANT_MS, GIMBAL_LIMIT_DEG = 1500, 400.0, 80.0
GRAVITY_RANGE = (0.5, 1.5)


def circular_mean(sin_sum: Column, cos_sum: Column, weight: Column) -> tuple[Column, Column]:
    """Mean in [0, 360) and circular deviation in degrees."""
    length = F.sqrt(sin_sum * sin_sum + cos_sum * cos_sum) / weight
    spread = F.when(length >= 1, num(0)).otherwise(F.degrees(F.sqrt(F.greatest(num(0), num(-2) * F.log(F.greatest(length, num(1e-12)))))))
    return fold(F.degrees(F.atan2(sin_sum, cos_sum))), spread


def pitch_deg(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.asin(clamp(z / F.sqrt(x * x + y * y + z * z), -1, 1)))


def aged(samples: DataFrame, max_age_ms: int) -> DataFrame:
    """Samples with the stretch of time that they are in, as long as the window."""
    return samples.withColumn("_age", F.floor(F.col("ms") / max_age_ms))


def by_age(instants: DataFrame, max_age_ms: int) -> DataFrame:
    """Each instant with the two stretches that its window reaches into: an instant meets the samples of these, not all of its device."""
    own = F.floor(F.col("atMs") / max_age_ms)
    return instants.withColumn("_age", F.explode(F.array(own - 1, own)))


def smoothed_headings(samples: DataFrame, instants: DataFrame, declination_deg: float | None, max_age_ms: int = MAX_AGE_MS, tau_ms: float = TIME_CONSTANT_MS) -> DataFrame:
    """instants: device, atMs. samples: device, ms, magneticDeg, trueDeg, accuracyDeg.

    headingDeg and spreadDeg (null for one sample), samples, and refusal: no-samples (the device has none), stale,
    needs-declination (one sample that can't be turned to true north refuses all).
    """
    true = F.coalesce("trueDeg", F.col("magneticDeg") + (num(declination_deg) if declination_deg is not None else F.lit(None).cast("double")))
    usable = (F.col("accuracyDeg").isNull() | (F.col("accuracyDeg") >= 0)) & (F.col("trueDeg").isNotNull() | F.col("magneticDeg").isNotNull())
    s = samples.where(usable).select("device", "ms", true.alias("t"))
    i, ages = by_age(instants, max_age_ms).alias("i"), F.col("i.atMs") - F.col("s.ms")
    joined = i.join(aged(s, max_age_ms).alias("s"), (F.col("i.device") == F.col("s.device")) & (F.col("i._age") == F.col("s._age")) & (ages >= 0) & (ages <= max_age_ms), "left")
    w, rad = F.exp(-ages / num(tau_ms)), F.radians(F.col("t"))
    out = joined.groupBy("i.device", "i.atMs").agg(F.sum(w * F.sin(rad)).alias("sn"), F.sum(w * F.cos(rad)).alias("cs"), F.sum(w).alias("w"), F.count("s.ms").alias("n"), F.count("t").alias("good"))
    known = samples.select("device").distinct().withColumn("known", F.lit(True))
    out = out.join(known, "device", "left")
    mean, spread = circular_mean(F.col("sn"), F.col("cs"), F.col("w"))
    refusal = F.when(F.col("known").isNull(), "no-samples").when(F.col("n") == 0, "stale").when(F.col("good") < F.col("n"), "needs-declination")
    return out.withColumn("refusal", refusal).select("device", "atMs", F.when(F.col("refusal").isNull(), mean).alias("headingDeg"), F.when(F.col("refusal").isNull() & (F.col("n") > 1), spread).alias("spreadDeg"), F.when(F.col("refusal").isNull(), F.col("n")).alias("samples"), "refusal")


def smoothed_orientation(samples: DataFrame, instants: DataFrame, max_age_ms: int = MAX_AGE_MS, tau_ms: float = TIME_CONSTANT_MS, limit_deg: float = GIMBAL_LIMIT_DEG) -> DataFrame:
    """pitchDeg, pitchSpreadDeg, rollDeg, with refusals of each; samples that are no gravity are left out."""
    x, y, z = (F.col(f"s.{k}") for k in "xyz")
    i, ages = by_age(instants, max_age_ms).alias("i"), F.col("i.atMs") - F.col("s.ms")
    joined = i.join(aged(samples, max_age_ms).alias("s"), (F.col("i.device") == F.col("s.device")) & (F.col("i._age") == F.col("s._age")) & (ages >= 0) & (ages <= max_age_ms), "left")
    size = F.sqrt(x * x + y * y + z * z)
    joined = joined.select("i.device", "i.atMs", "s.ms", size.between(*GRAVITY_RANGE).alias("ok"), pitch_deg(x, y, z).alias("p"), F.atan2(x, -y).alias("r"), F.exp(-ages / num(tau_ms)).alias("w"))
    good, rolls = F.col("ok"), F.col("ok") & (F.abs("p") <= limit_deg)
    w, p, r = F.col("w"), F.col("p"), F.col("r")
    out = joined.groupBy("device", "atMs").agg(
        F.count("ms").alias("seen"), F.count(F.when(good, 1)).alias("n"), F.sum(F.when(good, w)).alias("sw"), F.sum(F.when(good, w * p)).alias("sp"), F.sum(F.when(good, w * p * p)).alias("sq"),
        F.count(F.when(rolls, 1)).alias("rolls"), F.sum(F.when(rolls, w * F.sin(r))).alias("sn"), F.sum(F.when(rolls, w * F.cos(r))).alias("cs"), F.sum(F.when(rolls, w)).alias("rw"),
    )
    mean = F.col("sp") / F.col("sw")
    pitch_refusal = F.when(F.col("seen") == 0, "stale").when(F.col("n") == 0, "not-gravity")
    roll_refusal = F.coalesce(pitch_refusal, F.when((F.abs(mean) > limit_deg) | (F.col("rolls") == 0), "gimbal-degenerate"))
    roll = circular_mean(F.col("sn"), F.col("cs"), F.col("rw"))[0]
    return out.select("device", "atMs", mean.alias("pitchDeg"), F.when(F.col("n") > 1, F.sqrt(F.greatest(num(0), F.col("sq") / F.col("sw") - mean * mean))).alias("pitchSpreadDeg"), pitch_refusal.alias("pitchRefusal"), F.when(roll_refusal.isNull(), F.when(roll > 180, roll - num(360)).otherwise(roll)).alias("rollDeg"), roll_refusal.alias("rollRefusal"))


def fused_poses(headings: DataFrame, gravity: DataFrame, instants: DataFrame, declination_deg: float | None, max_age_ms: int = MAX_AGE_MS, tau_ms: float = TIME_CONSTANT_MS, limit_deg: float = GIMBAL_LIMIT_DEG) -> DataFrame:
    """device, atMs and headingDeg, pitchDeg, rollDeg, each answered or refused by itself: both traces of a device at one instant."""
    turned = smoothed_headings(headings, instants, declination_deg, max_age_ms, tau_ms).select("device", "atMs", "headingDeg", F.col("refusal").alias("headingRefusal"))
    tilted = smoothed_orientation(gravity, instants, max_age_ms, tau_ms, limit_deg)
    out = turned.join(tilted, ["device", "atMs"]).join(gravity.select("device").distinct().withColumn("_known", F.lit(True)), "device", "left")
    why = lambda c: F.when(F.col("_known").isNull(), "no-samples").otherwise(F.col(c)).alias(c)
    return out.select("device", "atMs", "headingDeg", "headingRefusal", "pitchDeg", why("pitchRefusal"), "rollDeg", why("rollRefusal"))


#: Expected gravity of each hold of a calibration.
HOLDS = (("upright-portrait", 0, -1, 0), ("flat-face-up", 0, 0, -1), ("flat-face-down", 0, 0, 1), ("right-edge-down", 1, 0, 0))


def axis_maps(observations: DataFrame) -> DataFrame:
    """For each device the best of the 48 signed axis maps: least worst angle to the expected gravity; the first of equals.

    observations: device, hold, x, y, z.
    """
    spark = observations.sparkSession
    holds = spark.createDataFrame([(h, float(a), float(b), float(c)) for h, a, b, c in HOLDS], "hold string, ex double, ey double, ez double")
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    maps = spark.createDataFrame([(i * 8 + j, *o, 1 - 2 * (j >> 2 & 1), 1 - 2 * (j >> 1 & 1), 1 - 2 * (j & 1)) for i, o in enumerate(orders) for j in range(8)], "map int, ox int, oy int, oz int, sx int, sy int, sz int")
    tried = observations.join(F.broadcast(holds), "hold").crossJoin(F.broadcast(maps))  # 48 rows of maps for each observation
    e = F.array("ex", "ey", "ez")
    px, py, pz = (F.col(f"s{k}") * e[F.col(f"o{k}")] for k in "xyz")
    cosine = (px * F.col("x") + py * F.col("y") + pz * F.col("z")) / F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    worst = tried.withColumn("err", F.degrees(F.acos(clamp(cosine, -1, 1)))).groupBy("device", "map").agg(F.max("err").alias("worst"))
    best = worst.groupBy("device").agg(F.min(F.struct(F.round("worst", 9).alias("worst"), "map")).alias("b"))
    return best.select("device", F.col("b.map").alias("map"), F.col("b.worst").alias("worstErrorDeg"))
