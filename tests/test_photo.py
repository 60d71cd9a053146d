"""Alignments against a plain program, recovered offsets on closed-form skylines, skylines read off pictures, poses and trims."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import num
from ridgeline.operators import alignment as al
from ridgeline.operators import pose as po
from ridgeline.operators import skyline as sk
from ridgeline.operators.profiles import analytic_profile

BELLS = [(-18.0, 4.0, 5.5), (-2.0, 1.6, 9.0), (14.0, 7.0, 3.0)]


def height(off):
    return 3 + sum(h * math.exp(-0.5 * ((off - c) / w) ** 2) for c, w, h in BELLS)


def turned(bearing, altitude, heading, turn, tilt):
    """A direction after a tilt about the level axis and a turn, by vectors."""
    b, a, h, t = (math.radians(x) for x in (bearing, altitude, heading, tilt))
    d, axis = np.array([math.sin(b) * math.cos(a), math.cos(b) * math.cos(a), math.sin(a)]), np.array([math.cos(h), -math.sin(h), 0])
    d = d * math.cos(t) + np.cross(axis, d) * math.sin(t) + axis * axis.dot(d) * (1 - math.cos(t))
    return (math.degrees(math.atan2(d[0], d[1])) + turn) % 360, math.degrees(math.asin(max(-1, min(1, d[2]))))


def plain_alignment(seen, n_columns, profile, heading, half, step, pitch_half, pitch_step):
    """The whole search with loops. seen: (bearing, altitude, weight); profile: sorted (bearing, altitude)."""
    gaps = [((profile[(i + 1) % len(profile)][0] - b) % 360 or 360, i) for i, (b, _) in enumerate(profile)]
    wide = max(gaps, key=lambda g: (g[0], -g[1]))
    hole = wide[1] if wide[0] > 4 * sorted(g for g, _ in gaps)[len(gaps) // 2] else None

    def at(bearing):
        for i, (b, a) in enumerate(profile):
            inside = (bearing - b) % 360
            if inside < gaps[i][0] and i != hole:
                return a + inside / gaps[i][0] * (profile[(i + 1) % len(profile)][1] - a)
        return None

    def fit(turn, tilt):
        rows = [(w, alt, at(b)) for (b, alt), w in ((turned(b, a, heading, turn, tilt), w) for b, a, w in seen)]
        rows = np.array([r for r in rows if r[2] is not None])
        if len(rows) < 2:
            return 0, -math.inf, math.inf, 0, 0
        w, o, p = rows.T
        mo, mp = np.average(o, weights=w), np.average(p, weights=w)
        vo, vp = np.average((o - mo) ** 2, weights=w), np.average((p - mp) ** 2, weights=w)
        score = np.average((o - mo) * (p - mp), weights=w) / math.sqrt(vo * vp) if vo * vp > 1e-20 else 0
        return len(rows), score, math.sqrt(np.average((o - p) ** 2, weights=w)), math.sqrt(vo), math.sqrt(vp)

    def peak(l, c, r):
        d = l - 2 * c + r
        return max(-0.5, min(0.5, 0.5 * (l - r) / d)) if math.isfinite(d) and abs(d) >= 1e-12 else 0

    if len(seen) / n_columns < 0.25:
        return "insufficient-skyline", None, None
    offs = [-half + i * step for i in range(round(2 * half / step) + 1)]
    scores = [f[1] if f[0] >= max(2, len(seen) * 0.25) else -math.inf for f in (fit(o, 0) for o in offs)]
    best = max(range(len(offs)), key=lambda i: (round(scores[i], 9), -i))
    if scores[best] == -math.inf:
        return "profile-does-not-cover-frame", None, None
    low = high = best
    while low > 0 and scores[low - 1] <= scores[low]:
        low -= 1
    while high < len(offs) - 1 and scores[high + 1] <= scores[high]:
        high += 1
    least = math.ceil(2 / step)
    rival = max((s for i, s in enumerate(scores) if i < min(low, best - least) or i > max(high, best + least)), default=-math.inf)
    margin = scores[best] - rival if rival > -math.inf else scores[best]
    turn = offs[best] + step * peak(scores[best - 1] if best else scores[best], scores[best], scores[best + 1] if best < len(offs) - 1 else scores[best])
    tilts = [-pitch_half + i * pitch_step for i in range(round(2 * pitch_half / pitch_step) + 1)]
    costs = [fit(turn, t)[2] for t in tilts]
    b = int(np.argmin(costs))
    tilt = tilts[b] + pitch_step * peak(costs[b - 1] if b else costs[b], costs[b], costs[b + 1] if b < len(tilts) - 1 else costs[b])
    grid = [(turn - 1.5 * step + 3 * step * i / 12, tilt - 3 * pitch_step + 6 * pitch_step * j / 12) for i in range(13) for j in range(13)]
    turn, tilt = min(grid, key=lambda g: fit(*g)[2])
    used, score, rms, photo, terrain = fit(turn, tilt)
    tests = [(used / n_columns < 0.25, "insufficient-skyline"), (terrain < 0.35, "featureless-terrain-profile"), (photo < 0.35, "featureless-photo-skyline"), (score < 0.35, "no-correlation"),
             (best in (0, len(offs) - 1), "search-range-exhausted"), (margin < 0.03, "ambiguous-correlation"), (rms > 1.5, "residual-too-large")]
    return next((why for wrong, why in tests if wrong), None), turn, tilt


CASES = {  # key: (turn, tilt, what is odd)
    1: (3.3, 0.8, ""), 2: (-6.1, -1.7, ""), 3: (0.0, 0.0, "flat terrain"), 4: (1.0, 0.0, "flat photo"), 5: (0.0, 0.0, "few"), 6: (30.0, 0.0, ""), 7: (2.0, 0.5, "noise"), 8: (0.0, 0.0, "elsewhere"), 9: (-4.0, 9.5, "high"),
}


@pytest.fixture(scope="module")
def scene(spark):
    seen, profile, columns = [], [], []
    pick = np.random.default_rng(5)
    for key, (turn, tilt, odd) in CASES.items():
        heading, offs = 350.0 + key, np.arange(-30, 30.1, 1.5)
        for d in (offs[:6] if odd == "few" else offs):
            b, a = turned((heading + turn + d) % 360, height(d), heading + turn, 0, -tilt)
            if odd == "flat photo":
                a = 3.0
            if odd == "noise":
                a = 3 + float(pick.normal()) * 3
            if odd == "high":
                a += 4
            seen.append((key, key, (b - turn) % 360, float(a), 0.5 + (d % 3) / 6, heading))
        columns.append((key, key, len(offs)))
        about = heading + turn + (170 if odd == "elsewhere" else 0)
        profile += [(key, (about + d) % 360, 3.0 if odd == "flat terrain" else height(d)) for d in np.arange(-60, 60.1, 1).tolist()]
    return (
        spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in seen], "key long, image long, bearingDeg double, altitudeDeg double, weight double, headingDeg double"),
        spark.createDataFrame(columns, "key long, image long, columns int"), spark.createDataFrame(profile, "image long, bearingDeg double, altitudeDeg double"), seen, profile, columns,
    )


def test_the_whole_search_against_loops(scene):
    skyline, columns, profile, seen, points, n = scene
    got = {r.key: r for r in al.align_skylines(skyline, columns, profile, 10.0, 0.5, 4.0, 0.5).collect()}
    assert len(got) == len(CASES)
    for key, _, n_columns in n:
        mine = [(b, a, w) for k, _, b, a, w, _ in seen if k == key]
        reason, turn, tilt = plain_alignment(mine, n_columns, sorted((b, a) for k, b, a in points if k == key), 350.0 + key, 10.0, 0.5, 4.0, 0.5)
        assert got[key].reason == reason, (key, got[key], reason)
        if reason is None:
            assert abs(got[key].headingOffsetDeg - turn) < 1e-6 and abs(got[key].pitchOffsetDeg - tilt) < 1e-6
        else:
            assert got[key].headingOffsetDeg is None and got[key].concerns is None


def test_offsets_are_recovered_on_closed_forms(spark, scene):
    """Within 0.03 degrees at the usual steps, terrain as analytic_profile() gives it."""
    skyline, columns, _, *_ = scene
    centres = spark.createDataFrame([(k, 350.0 + k + CASES[k][0]) for k in (1, 2)], "key long, centreDeg double")
    profile = analytic_profile(centres, 60.0, 0.5, 3.0, BELLS).withColumnRenamed("key", "image")
    for r in al.align_skylines(skyline.where("key in (1, 2)"), columns.where("key in (1, 2)"), profile).collect():
        turn, tilt, _ = CASES[r.key]
        assert r.status == "aligned" and abs(r.headingOffsetDeg - turn) <= 0.03 and abs(r.pitchOffsetDeg - tilt) <= 0.03 and r.confidence01 > 0.5


def test_no_rows_and_no_profile(spark, scene):
    skyline, columns, profile, *_ = scene
    assert {r.reason for r in al.align_skylines(skyline, columns, profile.where("false")).collect()} == {"profile-does-not-cover-frame"}
    assert {r.reason for r in al.align_skylines(skyline.where("false"), columns, profile).collect()} == {"insufficient-skyline"}
    with pytest.raises(ValueError):
        al.align_skylines(skyline, columns, profile, 0.0)


def test_trims_within_the_compass(spark, scene):
    skyline, _, profile, *_ = scene
    cameras = spark.createDataFrame([(k, 350.0 + k, 65.0, 41) for k in CASES], "image long, headingDeg double, hFovDeg double, columns int")
    far = profile.withColumn("distanceKm", F.when((F.col("image") == 2) & (F.col("altitudeDeg") > 11.5), num(0.05)).otherwise(num(9)))
    got = {r.image: r for r in al.suggested_trims(skyline, cameras, far).collect()}
    assert got[1].status == "suggested" and abs(got[1].headingTrimDeg - 3.3) < 0.1 and abs(got[1].pitchTrimDeg - 0.8) < 0.1
    assert (got[2].status, got[2].reason) == ("declined", "near-field-in-profile") and int(got[2].detail) > 0
    assert (got[5].reason, got[5].detail) == ("no-alignment", "insufficient-skyline") and got[6].status == "declined" and got[6].headingTrimDeg is None


def test_skylines_of_pictures(spark):
    """A clear ridge is read to the row; fog, a bare gradient and a picture upside down are not read at all."""
    rows, ridge = 60, [20 + int(6 * math.sin(c / 4)) for c in range(40)]
    value = {
        "ridge": lambda c, r: 0.85 - 0.001 * r if r < ridge[c] else 0.35 + 0.02 * ((c * 31 + r * 17) % 7), "fog": lambda c, r: 0.6, "gradient": lambda c, r: 0.9 - 0.01 * r,
        "upside": lambda c, r: 0.3 if r < 30 else 0.9,
    }
    signal = spark.createDataFrame([(k, c, r, float(f(c, r))) for k, f in value.items() for c in range(40) for r in range(rows)], "image string, col int, row int, value double")
    read = sk.read_skyline(signal, rows).collect()
    assert all(abs(r.rowNorm * rows - 0.5 - ridge[r.col]) <= 1 for r in read if r.image == "ridge")
    assert not any(r.rowNorm is not None or r.confidence01 for r in read if r.image != "ridge")
    assert {r.image: r.coverage01 for r in sk.skyline_summary(sk.read_skyline(signal, rows)).collect()} == {"ridge": 1.0, "fog": 0.0, "gradient": 0.0, "upside": 0.0}


def test_poses_of_odd_layers(spark):
    rows = spark.createDataFrame([(1, (95.0, float("nan"), None), (10.0, 20.0, 100.0))], "k int, user struct<lat:double,lon:double,eyeHeightM:double>, exif struct<lat:double,lon:double,gpsAltitudeM:double>")
    f = po.resolve_pose(rows).first().fields
    assert (f.lat.value, f.lat.reason) == (None, "out-of-range") and (f.lon.value, f.lon.source) == (20.0, "exif")  # a typed value that can't be true stops; a half-typed one doesn't
    assert f.groundElevationM.reason == "eye-height-required" and f.vFovDeg.reason == "absent-from-exif"
    bare = po.resolve_pose(spark.createDataFrame([(1,)], "k int")).first()
    assert bare.missing == list(po.POSE_FIELDS) and not bare.complete and bare.observer is None
