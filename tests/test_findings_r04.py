"""Faults that the next review found, each in small."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import image
from ridgeline.operators import alignment as al
from ridgeline.operators import skyline as sk
from ridgeline.operators import surroundings, tiles
from ridgeline.operators.raster import encode_samples
from ridgeline.plans import photo

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_without_evidence_do_not_compete(spark):
    """Of row, between and evidence about row 4: a row of no evidence never wins, unless it is the chosen one."""
    fields = "image int, strip int, row int, between int, evidence int"
    scores = spark.createDataFrame(
        [(1, 0, 3, 9, 0), (1, 0, 4, 2, 1), (1, 0, 5, 3, 1), (1, 1, 3, 9, 0), (1, 1, 4, 5, 0), (1, 1, 5, 4, 1), (1, 2, 3, 9, None), (1, 2, 4, 2, 0), (1, 2, 6, 7, 2), (1, 2, 7, 8, 2)], fields
    )
    chosen = spark.createDataFrame([(1, k, 4) for k in range(3)], "image int, strip int, row int")
    assert sorted(tuple(r) for r in image.refined_rows(scores, chosen, 2).collect()) == [(1, 0, 5), (1, 1, 4), (1, 2, 6)]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the tables")
def test_scores_of_headings_are_no_rows(spark):
    """They were rows that windows and joins went through, and a join by the size of their compressed table was broadcast."""
    found = plan(photo.heading_locks(spark, FOLDER))
    assert "CoGroup" in found and not any(x in found for x in ("Window", "Join", "Broadcast"))


def test_peaks_of_scores_against_loops():
    pick, low = np.random.default_rng(3), float("-inf")
    rows = [np.round(pick.normal(size=40), 1) for _ in range(200)] + [np.zeros(40), np.r_[[low] * 39, 0.5], np.r_[0.5, [low] * 39], np.r_[[low] * 20, 0.1, 0.2, [low] * 18]]
    rows += [np.where(pick.random(40) < 0.5, low, x) for x in rows[:100]]
    got = al.best_headings(np.array(rows), -4.0, 0.2)
    for i, s in enumerate(rows):
        best = min(k for k in range(40) if s[k] == s.max())
        a = b = best
        while a > 0 and s[a - 1] <= s[a]:
            a -= 1
        while b < 39 and s[b + 1] <= s[b]:
            b += 1
        rival = max([s[k] for k in range(40) if k < min(a, best - 10) or k > max(b, best + 10)], default=low)
        l, c, r = (s[min(max(k, 0), 39)] for k in (best - 1, best, best + 1))
        curve = l - 2 * c + r
        move = float(np.clip(0.5 * (l - r) / curve, -0.5, 0.5)) if np.isfinite(curve) and abs(curve) >= 1e-12 else 0.0
        assert got["peak"][i] == s.max() and abs(got["heading"][i] - (-4.0 + 0.2 * (best + move))) < 1e-9 and got["atEdge"][i] == (best in (0, 39))
        assert abs(got["margin"][i] - (c - rival if rival > low else c)) < 1e-12


def test_arcs_in_arrays_are_those_of_tables(spark):
    """Doubled bearings, a wide gap, none, one alone, two."""
    pick = np.random.default_rng(4)
    of = {1: pick.choice(3600, 60) / 10, 2: np.arange(40.0, 100.0), 3: np.arange(0.0, 360.0, 2.0), 4: np.array([5.0]), 5: np.array([5.0, 200.0]), 6: np.array([7.0, 7.0])}
    of[1] = np.r_[of[1], of[1][:5]]
    points = [(k, float(b), float(b) % 7) for k, bs in of.items() for b in bs]
    rows = al.arcs(spark.createDataFrame(points, "image int, bearingDeg double, altitudeDeg double")).collect()
    for k, bs in of.items():
        got = al.arcs_of(bs, bs % 7)
        assert sorted(zip(*(got[c].tolist() for c in ("start", "end", "a", "b")), strict=True)) == sorted((r.start, r.end, r.a, r.b) for r in rows if r.image == k)


def test_pictures_in_arrays_are_read_as_their_pixels(spark, monkeypatch):
    """Ridges, fog and unknown pixels, more pictures than are read at once."""
    monkeypatch.setattr(sk, "PICTURES", 3)
    pick, cols, rows = np.random.default_rng(6), 24, 40
    pictures = []
    for k in range(7):
        ridge = 12 + np.cumsum(pick.integers(-1, 2, cols))
        value = np.where(np.arange(rows) < ridge[:, None], 0.85, 0.35) + pick.normal(0, 0.002 if k % 3 else 0.03, (cols, rows))
        if k == 4:
            value[:] = 0.6
        pictures.append((f"i{k}", [None if pick.random() < (0.03 if k > 4 else 0) else float(x) for x in value.ravel()], 10.0 * k))
    arrays = spark.createDataFrame(pictures, "image string, value array<double>, turn double").coalesce(1)
    pixels = arrays.select("image", F.posexplode("value").alias("i", "value")).selectExpr("image", f"int(i / {rows}) as col", f"i % {rows} as row", "value")
    want = {(r.image, r.col): r for r in sk.read_skyline(pixels, rows).collect()}
    got = sk.read_pictures(arrays, cols, rows).collect()
    assert len(got) == len(want) == 7 * cols and len({r.turn for r in got}) == 7
    for r in got:
        assert tuple(r[c] for c in sk.READ) == tuple(want[r.image, r.col][c] for c in sk.READ) and r.turn == 10.0 * int(r.image[1])
    assert 40 < sum(r.rowNorm is not None for r in got) < 7 * cols and {r.confidence01 for r in got if r.image == "i4"} == {0.0}
    with pytest.raises(Exception, match="no 23 times 40 pixels"):
        sk.read_pictures(arrays, 23, rows).collect()


def test_agreement_of_rows_against_loops():
    pick = np.random.default_rng(8)
    row, evidence = pick.integers(-1, 40, (3, 50)), pick.random((3, 50)) * 0.3
    got = sk.agreement(row, evidence, 48, 5)
    for i in range(3):
        for c in range(50):
            near = [int(row[i, k]) for k in range(max(0, c - 5), min(50, c + 6)) if k != c and row[i, k] >= 0 and evidence[i, k] >= sk.READABLE]
            apart = abs(row[i, c] - float(np.median(near))) / 48 / sk.AGREEMENT if near else 0.0
            assert abs(got[i, c] - (1 / (1 + apart * apart) if len(near) >= 3 and row[i, c] >= 0 else 1.0)) < 1e-12


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the tables")
def test_pixels_and_windows_of_a_comb_are_no_rows(spark):
    """A photograph is an array from its exposure to its skyline, and its skyline meets its profile once for all levels and windows."""
    assert "Exchange hashpartitioning(image" not in plan(photo.observed(spark, FOLDER))
    assert plan(photo.pose_trims(spark, FOLDER)).count("FlatMapCoGroups") == 1


def test_watchers_of_one_place_are_judged_once(spark, monkeypatch):
    """Seven watchers at one place (three to a row), two at another without ground, one alone: each sees what it sees alone, with its own camera beside."""
    monkeypatch.setattr(surroundings, "WATCHERS", 3)
    pick, fields = np.random.default_rng(9), "observer_id string, lat double, lon double, groundElevationM double, eyeElevationM double, headingDeg double"
    grid = np.clip(1500 + np.cumsum(pick.normal(0, 60, (61, 61)), axis=1), 0, 4000).astype(int)
    blocks = tiles.tile_blocks(spark.createDataFrame([("N45E007.hgt", bytearray(encode_samples(grid)))], "path string, content binary"))
    places = [(45.5, 7.5, 1000.0, 1002.0, 7), (45.52, 7.48, None, 2502.0, 2), (45.5, 7.5, 1000.0, 1802.0, 1)]
    rows = [(f"o{p}-{i}", a, b, g, e, float(i) if i else None) for p, (a, b, g, e, n) in enumerate(places) for i in range(n)]
    observers = spark.createDataFrame(rows, fields)
    summits = spark.createDataFrame([(f"s{i}", 45.5 + float(x), 7.5 + float(y), 3000.0 - 40 * i) for i, (x, y) in enumerate(pick.uniform(-0.08, 0.08, (40, 2)))], "id string, lat double, lon double, elevationM double")
    groups = surroundings.grouped_observers(observers, ["observer_id", "headingDeg"]).collect()
    assert sorted(w.observer_id for g in groups for w in g.watchers) == sorted(r[0] for r in rows) and 3 <= len(groups) <= 5

    def seen(who):
        found = surroundings.annotated_surroundings(who, ["observer_id", "headingDeg"], summits, blocks, [float(b) for b in range(0, 360, 15)], [700.0 * k for k in range(1, 16)], 12.0, 700.0)
        return sorted((tuple(r) for r in found.collect()), key=repr)

    got = seen(observers)
    alone = {r[0].split("-")[0]: [x[2:] for x in seen(observers.where(F.col("observer_id") == r[0]))] for r in rows if r[0].endswith("-0")}
    assert min(map(len, alone.values())) > 20 and alone["o0"] != alone["o2"]
    for name, _, _, _, _, heading in rows:
        assert [x[2:] for x in got if x[0] == name] == alone[name.split("-")[0]] and {x[1] for x in got if x[0] == name} == {heading}
