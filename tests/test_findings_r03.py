"""Faults that a review found on larger tables, each in small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import image
from ridgeline.operators import acquisition, alignment, catalog, cloud, surroundings, tiles, visibility
from ridgeline.operators import photo as photo_op
from ridgeline.operators import skyline as skyline_op
from ridgeline.operators.raster import VOID, encode_samples
from ridgeline.tables import spread


def test_parts_of_one_name_are_numbered_by_size(spark):
    entry = "<Contents><Key>part-10000.parquet</Key><Size>{}</Size></Contents>"
    xml = spark.createDataFrame([(1, "".join(entry.format(n) for n in (300, 100, 200)))], "key int, xml string")
    got = sorted((r.bytes, r.nth) for r in acquisition.listed_parts(xml).collect())
    assert got == [(100, 1), (200, 2), (300, 3)]


def test_wide_spacings_are_written_without_an_exponent(spark):
    steps = spark.createDataFrame([(x,) for x in (10000100 / 3600, 12345700 / 3600, 0.3, 250.5 / 3600 * 7)], "s double")
    got = [r.x for r in steps.select(catalog.dataset_label(F.col("s")).alias("x")).collect()]
    assert got == ["hgt-10000100arcsec", "hgt-12345700arcsec", "hgt-1080arcsec", "hgt-1753.5arcsec"]


def test_halfway_between_two_samples_no_bits_are_lost(spark):
    lon = [6.9 + k / 10000 for k in range(20000)]
    at = tiles.in_blocks(spark.createDataFrame([(i, 45.25, x) for i, x in enumerate(lon)], "point_id long, lat double, lon double"))
    for row in at.select("point_id", "lon", "_along").collect():
        assert row._along == row.lon - int(row.lon)
    odd = tiles.in_blocks(spark.createDataFrame([(0, 0.5, 187.25), (1, 0.5, 6.999999999999999), (2, 0.5, -180.0), (3, 0.5, 180.0)], "point_id long, lat double, lon double"))
    assert [(r.tile, r.block_col) for r in odd.orderBy("point_id").collect()] == [("N00W173", 16), ("N00E007", 0), ("N00W180", 0), ("N00W180", 0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_and_samples_of_one_place_are_compared_once(spark, monkeypatch):
    met, one_round = [], cloud.one_round

    def counted(points, samples, size):
        met.append((points.count(), samples.count()))
        return one_round(points, samples, size)

    monkeypatch.setattr(cloud, "one_round", counted)
    points = spark.createDataFrame([(i, 45.0, 7.0) for i in range(50)] + [(50, None, 7.0)], "point_id int, lat double, lon double")
    samples = spark.createDataFrame([(45.0, 7.001, float(i)) for i in range(40)], "lat double, lon double, elevationM double")
    assert {(r.point_id, r.elevationM) for r in cloud.within_tolerance(points, samples, 0.01).collect()} == {(i, 0.0) for i in range(50)} | {(50, None)}
    assert met == [(2, 1)]
    assert {(r.point_id, r.elevationM) for r in cloud.nearest(points.where("lat is not null"), samples, 0.01).collect()} == {(i, 0.0) for i in range(50)}


def test_refined_rows_broadcast_nothing(spark):
    scores = spark.range(3).select(F.col("id").alias("image"), F.lit(0).alias("strip"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("row"), F.lit(1).alias("between"), F.lit(1).alias("evidence"))
    assert "Broadcast" not in plan(image.refined_rows(scores, scores.where("row = 4").select("image", "strip", "row"), 2))


def test_short_rows_are_dealt_out_before_they_are_exploded(spark):
    assert spread(spark.range(100).coalesce(1), 10, "id").rdd.getNumPartitions() == 10
    assert spread(spark.range(10).coalesce(1), 10, "id").rdd.getNumPartitions() == 1


def test_candidates_and_factors_are_no_rows(spark):
    skyline = spark.createDataFrame([(1, 1, 10.0, 2.0, 1.0)], "key int, image int, bearingDeg double, altitudeDeg double, weight double")
    arc = spark.createDataFrame([(1, 0.0, 20.0, 1.0, 2.0)], "image int, start double, end double, a double, b double")
    assert "Generate" not in plan(alignment.heading_scores(skyline, arc, [0.0, 1.0]))
    signal = spark.createDataFrame([(1, 0, 0, 0.5)], "image int, col int, row int, value double")
    assert "Window" not in plan(skyline_op.step_factors(signal, 48))


def test_verdicts_of_arrays_are_those_of_rows(spark, monkeypatch):
    """Seams, a missing tile, voids, the date line, a pole, copies of summits, lots of two observers and rows of three ids."""
    monkeypatch.setattr(surroundings, "LOT", 2)
    monkeypatch.setattr(surroundings, "IDS", 3)
    monkeypatch.setattr(surroundings, "AT_ONCE", 40)
    pick, files = np.random.default_rng(7), []
    for name in ("N45E006", "N45E007", "N44E007", "N00E179", "S01W180", *(f"N89E{k:03}" for k in range(0, 180, 3))):
        grid = np.clip(1500 + np.cumsum(pick.normal(0, 60, (61, 61)), axis=1), 0, 4000).astype(int)
        grid[pick.random((61, 61)) < 0.1] = VOID
        grid[20:24, 20:26] = VOID
        files.append((f"{name}.hgt", bytearray(encode_samples(grid))))
    blocks = tiles.tile_blocks(spark.createDataFrame(files, "path string, content binary"))
    centres = [(45.02, 7.03), (45.5, 6.99), (45.65, 7.4), (45.01, 7.02), (45.02, 7.04), (44.99, 6.999), (0.004, 179.98), (-0.01, -179.99), (89.93, 10.0), (-45.0, 7.0)]
    observers = spark.createDataFrame([(i, a, b, g, g + 2) for i, (a, b) in enumerate(centres) for g in [1500.0 + 300 * (i % 4)]], "observer_id long, lat double, lon double, groundElevationM double, eyeElevationM double")
    rows = []
    for a, b in centres[:-1]:
        for k in range(60):
            lat, lon = a + float(pick.uniform(-0.12, 0.12)), b + float(pick.uniform(-0.17, 0.17))
            lat, lon = min(lat, 89.999), (lon + 180) % 360 - 180
            h = None if k % 9 == 0 else float(pick.integers(500, 4500))
            rows += [(f"s{len(rows)}-{c}", "n", lat, lon, h) for c in range(8 if k % 20 == 1 else 1)]
    rows.append(("here", "n", 45.02, 7.03, 3000.0))
    summits = spark.createDataFrame(rows, "id string, name string, lat double, lon double, elevationM double")
    bearings, ranges = [float(b) for b in range(0, 360, 15)], [700.0 * k for k in range(1, 16)]
    rays = photo_op.write_down(photo_op.swept_rays(observers, blocks, bearings, ranges), "rays")
    want = {(r.observer_id, r.id): r for r in visibility.annotate(observers, summits, rays, bearings, 12.0, 700.0).collect()}
    scenes = surroundings.annotated_surroundings(observers, ["observer_id"], summits, blocks, bearings, ranges, 12.0, 700.0)
    found = scenes.collect()
    got = {(r.observer_id, i): r for r in found for i in r.ids}
    assert sum(len(r.ids) for r in found) == len(got) == len(want) > 300 and got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert (g.status, g.visibility) == (w.status, w.visibility), (key, g, w)
        assert abs(g.bearingDeg - w.bearingDeg) < 1e-9 and abs(g.altitudeDeg - w.altitudeDeg) < 1e-9
        assert (g.clearanceDeg is None) == (w.clearanceDeg is None) and (w.clearanceDeg is None or abs(g.clearanceDeg - w.clearanceDeg) < 1e-9)
    assert {w.status for w in want.values()} == set(surroundings.STATUS) and {w.visibility for w in want.values()} == {None, *surroundings.VISIBILITY}
    assert {k for k, _ in want} == set(range(9)) and max(len(r.ids) for r in found) > 1 and len(found) < len(got)
    assert "Window" not in plan(scenes)  # no sample is a row


def test_no_surroundings_no_verdicts(spark):
    observers = spark.createDataFrame([(1, 45.5, 7.5, 1000.0, 1002.0)], "observer_id long, lat double, lon double, groundElevationM double, eyeElevationM double")
    summits = spark.createDataFrame([("a", 45.51, 7.5, 2000.0), ("b", -45.5, 7.5, 2000.0)], "id string, lat double, lon double, elevationM double")
    blocks = tiles.tile_blocks(spark.createDataFrame([("N45E007.hgt", bytearray(encode_samples(np.full((61, 61), 900))))], "path string, content binary"))
    args = [0.0, 180.0], [1000.0, 2000.0], 5.0, 1000.0
    run = lambda o, s, b: surroundings.annotated_surroundings(o, ["observer_id"], s, b, *args).collect()
    assert [(r.observer_id, r.ids, r.visibility) for r in run(observers, summits, blocks)] == [(1, ["a"], "visible")]
    assert run(observers.where("false"), summits, blocks) == run(observers, summits.where("id = 'b'"), blocks) == run(observers, summits, blocks.where("false")) == []
    with pytest.raises(ValueError):
        surroundings.annotated_surroundings(observers, ["observer_id"], summits, blocks, [], [1.0], 5.0, 1.0)
