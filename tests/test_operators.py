"""Closed forms, round trips and corner cases of the operators."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import camera, geodesy, text
from ridgeline.functions.geodesy import num
from ridgeline.operators import landforms, raster, skyline, visibility
from ridgeline.streaming.sensors import windowed_headings


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_published_anchors(spark):
    dip, distance, fov = one(spark, geodesy.flat_horizon_dip_deg(num(100)), geodesy.flat_horizon_distance_m(num(100)), camera.hfov_deg(num(24)))
    assert dip == pytest.approx(-0.299427, abs=2e-6) and distance / 1000 == pytest.approx(38.27, abs=0.01)
    assert fov == pytest.approx(73.74, abs=0.01)


def test_seams_and_folds(spark):
    got = one(spark, geodesy.normalise_longitude_deg(num(-180)), geodesy.normalise_longitude_deg(num(540)), geodesy.angular_difference_deg(num(350), num(10)), geodesy.angular_difference_deg(num(0), num(180)), geodesy.fold(num(-0.0)), geodesy.cell_name(num(90), num(-180)), geodesy.cell_name(num(-0.5), num(7.2)))
    assert got == (180.0, 180.0, 20.0, 180.0, 0.0, "N89W180", "S01E007") and math.copysign(1, got[4]) == 1
    with pytest.raises(ValueError):
        geodesy.effective_radius_m(1.0)


def test_projection_round_trip(spark):
    pose = [num(x) for x in (12, 3, 5, 60, 40)]
    frame = spark.createDataFrame([(b, a) for b in map(float, range(-15, 40, 6)) for a in map(float, range(-10, 20, 5))], "b double, a double")
    at = camera.project(*pose, F.col("b"), F.col("a"))
    placed = frame.select("b", "a", *[c.alias(k) for k, c in at.items()])
    back = camera.unproject(*pose, F.col("x"), F.col("y"))
    for r in placed.where("depth > 0").select("b", "a", back[0].alias("bb"), back[1].alias("aa")).collect():
        assert (r.bb - r.b) % 360 == pytest.approx(0, abs=1e-9) or (r.bb - r.b) % 360 == pytest.approx(360, abs=1e-9)
        assert r.aa == pytest.approx(r.a, abs=1e-9)


def ray_table(spark, heights, bearings=(0.0,), step=500.0):
    rows = [(1, 0.0, b, (i + 1) * step, float(h)) for b in bearings for i, h in enumerate(heights) if h is not None]
    return spark.createDataFrame(rows, "observer_id int, eyeElevationM double, bearingDeg double, distanceM double, elevationM double")


def test_staircase_keeps_strict_records_only(spark):
    got = [r.distanceM for r in visibility.staircase(ray_table(spark, [100, 50, 400, 10, 2000, 2000])).orderBy("distanceM").collect()]
    assert got == [500.0, 1500.0, 2500.0]


def test_a_summit_does_not_hide_itself_and_holes_refuse(spark):
    rays = ray_table(spark, [10, 10, 10, 900], bearings=(0.0, 10.0))
    seen = spark.createDataFrame([(1, "own", 5.0, 2000.0, 24.0, 2.0), (1, "behind", 5.0, 9000.0, 1.0, 9.0), (1, "far side", 200.0, 9000.0, 1.0, 9.0)], "observer_id int, id string, bearingDeg double, distanceM double, altitudeDeg double, distanceKm double")
    got = {r.id: r for r in visibility.against_horizon(seen, rays).collect()}
    assert got["own"].clearanceDeg > 0 and got["own"].occluderDistanceKm < 2
    assert got["behind"].clearanceDeg < 0 and got["behind"].occluderDistanceKm == 2.0
    assert got["far side"]._b == 10.0 and got["far side"]._a == 360.0
    assert sorted(r.bearingDeg for r in visibility.horizon_coverage(rays, [0, 5, 10, 365]).collect()) == [5.0]


@pytest.mark.parametrize(("heights", "evidence"), [([10, 900, 950, 1000], "unbroken-rise-to-summit"), ([10, 900, 500, 950], "col-between-occluder-and-summit"), ([10, 900, None, None, None, 950], "unsampled-gap-between-occluder-and-summit"), ([10, 20, 30, 40], "occluder-not-on-this-ray")])
def test_occlusion_classes(spark, heights, evidence):
    rays = visibility.ray_table(ray_table(spark, heights), 500.0, 2000.0)
    top = (len(heights)) * 500.0
    seen = rays.select("observer_id", num(top).alias("distanceM"), num(12).alias("altitudeDeg"), visibility.last_before(num(top - 1e-3)).alias("_before"))
    assert visibility.classify(seen, 500.0).first().evidence == evidence


def test_tagged_heights(spark):
    tags = {"4808": 4808.0, " 4,808 m": 4808.0, "1 100": 1100.0, "+30": 30.0, "14505 ft": 4421.124, "unknown": None, "approx 3000": None, "4808 m ASL": None, "12,34": None, "812.5M": 812.5}
    df = spark.createDataFrame([(k,) for k in tags], "tag string")
    assert {r.tag: r.m for r in df.select("tag", text.ele_metres(F.col("tag")).alias("m")).collect()} == tags


def test_hashes_and_hosts(spark):
    assert one(spark, text.fnv1a_32(F.lit("a")), text.host(F.lit("HTTPS://u@News.Example.com:80/x?y")), text.canonical_query(F.lit("http://h/p?b=2&a=1#f"))) == ("e40c292c", "news.example.com", "http://h/p?a=1&b=2")


def test_import_accounts_for_every_row(spark, tmp_path):
    box = lambda x, y, s=0.0: (x - s, x + s, y - s, y + s)
    rows = [("a", ("A",), "physical", "peak", 100, box(7.5, 46.0), 1), ("a", ("A2",), "physical", "peak", 100, box(7.5, 46.0), 2), (None, ("B",), "physical", "peak", 1, box(7.5, 46.0), 3), ("c", (" \t",), "physical", "peak", 1, box(7.5, 46.0), 4), ("d", ("D",), "physical", "peak", None, box(7.5, 46.0), 5), ("e", ("E",), "physical", "peak", 1, box(7.5, 46.0, 0.1), 6), ("f", ("F",), "physical", "peak", 1, box(17.5, 46.0), 7), ("g", ("G",), None, "peak", 1, box(7.5, 46.0), 8), ("h", ("H",), "physical", "hill", 1, box(7.5, 46.0), 9)]
    df = spark.createDataFrame(rows, "id string, names struct<primary: string>, subtype string, class string, elevation int, bbox struct<xmin: double, xmax: double, ymin: double, ymax: double>, ord int")
    out = landforms.import_landforms(df, (45.0, 7.0, 47.0, 9.0))
    counts = {r.outcome: r.n for r in landforms.outcome_counts(out).collect()}
    assert counts == {**dict.fromkeys(landforms.REASONS, 1), "kept": 1, "duplicate": 1} and sum(counts.values()) == len(rows)
    index = landforms.write_cells(out, str(tmp_path / "cells")).collect()
    assert [(r.cell, r.peaks) for r in index] == [("N46E007", 1)]
    assert spark.read.parquet(str(tmp_path / "cells")).where("cell = 'N46E007'").first().id == "overture/a"


def test_tiles_round_trip_with_voids(spark, tmp_path):
    heights = np.arange(25).reshape(5, 5) * 10
    heights[2, 3] = raster.VOID
    (tmp_path / "N45E007.hgt").write_bytes(raster.encode_samples(heights.ravel()))
    (tmp_path / "n46e008.hgt.gz").write_bytes(gzip.compress(raster.encode_samples(np.full(25, 1234))))
    got = raster.read_tiles(spark, str(tmp_path)).collect()
    assert len(got) == 50 and {r.tile for r in got} == {"N45E007", "N46E008"}
    own = {(r.row, r.col): r.elevationM for r in got if r.tile == "N45E007"}
    assert own[(2, 3)] is None and own[(4, 4)] == 240.0
    with pytest.raises(ValueError):
        raster.grid_size(26)


def test_bilinear_is_exact_and_voids_are_never_averaged(spark):
    cells = spark.createDataFrame([(r, c, None if (r, c) == (2, 2) else float(100 * r + 10 * c)) for r in range(5) for c in range(5)], "row int, col int, elevationM double")
    points = spark.createDataFrame([(1, 9.0, 1.0), (2, 9.6, 0.3), (3, 8.1, 2.1), (4, 8.0, 2.0), (5, 20.0, 1.0), (6, 6.0, 4.0), (7, 8.0, 1.0)], "point_id int, lat double, lon double")
    got = {r.point_id: (r.status, r.method, r.elevationM) for r in raster.read_bilinear(points, cells, 10.0, 0.0, 1.0, 5, 5).collect()}
    assert got[1] == ("ok", "bilinear", 110.0) and got[2][2] == pytest.approx(43.0)
    assert got[3][1] == "nearest-valid" and got[4][:2] == ("ok", "nearest-valid")
    assert got[5] == ("outside", None, None) and got[6] == ("ok", "bilinear", 440.0) and got[7] == ("ok", "bilinear", 210.0)


def brute_path(scores, penalty, free):
    n_cols, n_rows = scores.shape
    cost = lambda q, r: penalty * max(0, abs(q - r) - free)
    best = {r: scores[0][r] for r in range(n_rows)}
    for c in range(1, n_cols):
        best = {r: max(best[q] - cost(q, r) for q in range(n_rows)) + scores[c][r] for r in range(n_rows)}
    return max(best.values())


@pytest.mark.parametrize(("free", "penalty"), [(0, 0.3), (1, 0.1), (2, 0.3), (3, 0.0)])
def test_the_path_is_optimal(free, penalty):
    scores = np.random.default_rng(free).random((12, 9))
    path = skyline.best_path(scores, penalty, free)
    value = sum(scores[c, r] for c, r in enumerate(path)) - penalty * np.maximum(0, np.abs(np.diff(path)) - free).sum()
    assert value == pytest.approx(brute_path(scores, penalty, free))


def test_the_path_follows_a_cliff():
    scores = np.zeros((6, 50))
    scores[:3, 2] = scores[3:, 47] = 1
    assert skyline.best_path(scores, 0.01, 1).tolist() == [2, 2, 2, 47, 47, 47]


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 3).alias("device"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), (F.col("id") * 17 % 360).cast("double").alias("headingDeg"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_headings(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("headings").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.device, r.start): (r.samples, round(r.headingDeg, 6)) for r in spark.table("headings").collect()}
    batch = {(r.device, r.start): (r.samples, round(r.headingDeg, 6)) for r in windowed_headings(rows).collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(got) >= len(batch) - 12
