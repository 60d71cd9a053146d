"""Label placement, staircases, sweeps, errors and missing data against plain rules."""

import random

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from ridgeline.errors import RequestError, SourceError
from ridgeline.operators import acquisition as ac
from ridgeline.operators import catalog, overlay, profiles, visibility


def overlaps(a, b, height):
    return a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + height and b[1] < a[1] + height


@pytest.mark.parametrize("seed", range(5))
def test_labels_take_the_first_free_place(seed):
    rng, frame = random.Random(seed), overlay.Frame()
    rows = pd.DataFrame([(1, f"p{i}", i, rng.random() * 1600, rng.random() * 1200, rng.choice([60.0, 150.0, 400.0])) for i in range(60)], columns=["observer_id", "id", "rank", "xPx", "yPx", "labelWidthPx"])
    got = overlay.place(rows.sample(frac=1, random_state=seed), frame).set_index("id")
    taken = []
    for row in rows.itertuples():
        places = [(b[2], b[3], row.labelWidthPx) for b in overlay.boxes(row.xPx, row.yPx, row.labelWidthPx, frame) if b[4]]
        free = [p for p in places if not any(overlaps(p, t, frame.block_px) for t in taken)]
        at = got.loc[row.id]
        if free:
            assert at.status == "labelled" and (at.boxX, at.boxY) == free[0][:2] and not at.overlapped
        elif places:
            assert at.status == "crowded-out"
            continue
        else:
            assert at.status == "labelled" and at.overlapped
        taken.append((at.boxX, at.boxY, row.labelWidthPx))
    assert len(got) == 60


def test_frames_scale_with_their_size():
    frame = overlay.Frame()
    assert (frame.name_px, frame.detail_px, frame.padding_px, frame.pole_px, frame.step_px, frame.margin_px, frame.reachable) == (26, 19, 9, 72, 79, 16, 4)
    assert overlay.Frame(200, 100).name_px == 12


def test_of_samples_at_one_distance_the_highest_stays(spark):
    rows = [(1, 0.0, 0.0, d, e) for d, e in ((100.0, 5.0), (100.0, 9.0), (200.0, 6.0), (300.0, 90.0), (300.0, 90.0))]
    rays = spark.createDataFrame(rows, "observer_id long, eyeElevationM double, bearingDeg double, distanceM double, elevationM double")
    for df in (rays, rays.orderBy("elevationM"), rays.orderBy(rays.elevationM.desc())):
        assert sorted((r.distanceM, r.elevationM) for r in visibility.staircase(df).collect()) == [(100.0, 9.0), (300.0, 90.0)]


def test_merged_points_unite_their_steps(spark):
    step = "array<struct<distanceKm:double,altitudeDeg:double,elevationM:double>>"
    rows = [(1, 0.0, 2.0, 5.0, 50.0, [(1.0, 1.0, 10.0), (2.0, 5.0, 50.0)], 0), (1, 360.0, 3.0, 5.0, 70.0, [(1.0, 2.0, 20.0), (3.0, 5.0, 70.0)], 1), (1, -360.0, 1.5, 3.0, 30.0, None, 2)]
    points = spark.createDataFrame(rows, f"observer_id long, bearingDeg double, distanceKm double, altitudeDeg double, elevationM double, steps {step}, ord int")
    (got,) = profiles.normalised_profile(points).collect()
    assert (got.bearingDeg, got.altitudeDeg, got.elevationM) == (0.0, 5.0, 50.0)
    assert [tuple(s) for s in got.steps] == [(1.0, 2.0, 20.0), (1.5, 3.0, 30.0), (2.0, 5.0, 50.0)]


def test_sweeps_that_leave_rays_empty_are_refused():
    for wrong in ({"bearing_step_deg": 0}, {"range_step_m": -1}, {"min_range_m": -1}, {"min_range_m": 30_000}, {"max_range_km": 0}, {"span_deg": 361}, {"max_range_km": 0.05}):
        with pytest.raises(ValueError):
            ac.Sweep(**wrong)


def test_errors_have_codes():
    error = SourceError("bad-tile", "no grid", tile="N45E007")
    assert error.code == "bad-tile" and error.detail == {"tile": "N45E007"} and str(error) == "no grid"
    with pytest.raises(ValueError):
        RequestError("bad-tile", "not one of its codes")


def test_missing_heights_are_refused_dropped_or_filled(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.5, None)], "lat double, lon double, elevationM double")
    assert catalog.elevation_samples(df, "drop").count() == 1
    assert [r.elevationM for r in catalog.elevation_samples(df, -1.0).orderBy("lon").collect()] == [3.0, -1.0]
    with pytest.raises(PySparkException):
        catalog.elevation_samples(df, "throw").collect()
