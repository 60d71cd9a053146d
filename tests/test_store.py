"""Tile stores, photographs' bytes, nearest samples, drawn backdrops."""

import gzip
import math

import numpy as np
import pytest

from ridgeline.operators import backdrop, cloud
from ridgeline.operators import tiles as ti
from ridgeline.operators.raster import VOID, encode_samples
from ridgeline.sources import exif as ex
from ridgeline.sources.heif import Unreadable

TILES = {"N45E006": 121, "N45E007": 121, "S01W001": 61, "N44E007": 1201}


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    folder, grids = tmp_path_factory.mktemp("store"), {}
    pick = np.random.default_rng(2)
    for name, n in TILES.items():
        grid = pick.integers(-100, 4000, (n, n))
        grid[pick.random((n, n)) < 0.02] = VOID
        grids[name] = grid
        (folder / name[:3]).mkdir(exist_ok=True)
        raw = encode_samples(grid)
        (folder / name[:3] / f"{name}.hgt{'.gz' if name == 'N45E007' else ''}").write_bytes(gzip.compress(raw) if name == "N45E007" else raw)
    (folder / "N10E010.hgt").write_bytes(b"odd")  # never opened: no point lies in it
    return str(folder), grids


def plain(grids, lat, lon, policy):
    name = f"{'N' if math.floor(lat) >= 0 else 'S'}{abs(math.floor(lat)):02}{'E' if math.floor(lon) >= 0 else 'W'}{abs(math.floor(lon)):03}"
    if name not in grids:
        return "missing-tile", None, None
    g, n = grids[name], len(grids[name])
    r, c = (math.floor(lat) + 1 - lat) * (n - 1), (lon - math.floor(lon)) * (n - 1)
    r0, c0 = min(math.floor(r), n - 2), min(math.floor(c), n - 2)
    corners = [((r - r0 if k // 2 else 1 - (r - r0)) * (c - c0 if k % 2 else 1 - (c - c0)), -k, int(g[r0 + k // 2, c0 + k % 2])) for k in range(4)]
    void = sum(w for w, _, h in corners if h == VOID)
    if void <= 1e-3 / 32767:
        return "ok", sum(w * h for w, _, h in corners if h != VOID), "bilinear"
    valid = [x for x in corners if x[2] != VOID]
    return ("ok", max(valid)[2], "nearest-valid") if valid and policy == "nearest-valid" else ("void", None, None)


@pytest.mark.parametrize("policy", ["nearest-valid", "no-data"])
def test_points_over_several_tiles(spark, store, policy):
    folder, grids = store
    pick = np.random.default_rng(3)
    places = [(float(a), float(b)) for a, b in zip(pick.uniform(44, 46, 400), pick.uniform(6, 8, 400), strict=True)] + [(45.0, 7.0), (45.0, 6.999999), (-0.5, -0.25), (-1.0, -1.0), (45.5, 7.5), (44.0, 7.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "point_id int, lat double, lon double")
    out = ti.sample_terrain(points, ti.tile_blocks(ti.tile_files(spark, folder, points)), void_policy=policy).collect()
    assert len(out) == len(places)
    for r in out:
        status, h, method = plain(grids, *places[r.point_id], policy)
        assert (r.status, r.method) == (status, method) and (h is None) == (r.elevationM is None) and (h is None or abs(h - r.elevationM) < 1e-6)
    assert {r.dataset for r in out} == {"hgt-121", "hgt-61", "srtm3", "local-tiles(missing)"}


def test_only_needed_tiles_are_opened(spark, store):
    folder, _ = store
    points = spark.createDataFrame([(1, 45.5, 6.5), (2, 45.2, 7.2)], "point_id int, lat double, lon double")
    files = ti.tile_files(spark, folder, points)
    assert files.count() == 2
    files.collect()  # the odd file would not decode; files that no point needs are left out by their metadata
    scan = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "file_name" in scan
    with pytest.raises(Exception, match="no local tile N80E010"):
        ti.sample_terrain(spark.createDataFrame([(1, 80.5, 10.5)], "point_id int, lat double, lon double"), ti.tile_blocks(files), missing="throw").collect()
    with pytest.raises(ValueError):
        ti.sample_terrain(points, ti.tile_blocks(files), void_policy="guess")


def test_tags_of_bytes():
    tags = {"Orientation": (ex.SHORT, [6]), "GPSLatitude": (ex.RATIONAL, [45, 1, 30, 1, 0, 1]), "GPSLatitudeRef": (ex.ASCII, [b"S"]), "GPSLongitude": (ex.RATIONAL, [7, 1, 0, 1, 36, 1]), "GPSLongitudeRef": (ex.ASCII, [b"E"]), "FocalLength": (ex.RATIONAL, [42, 0])}
    for order in "<>":
        block = ex.tiff_block(tags, order)
        want = {"Orientation": "6", "latitude": "-45.5", "longitude": "7.01"}  # a rational by zero is no number
        assert ex.photo_tags(ex.jpeg_with(block)) == want == ex.photo_tags(block)
    assert ex.photo_tags(ex.jpeg_with(None)) == {}
    good = ex.tiff_block(tags)
    damaged = {
        b"": "unknown-container", b"GIF89a": "unknown-container", b"\xff\xd8\xff\xe1\xff\xff": "segment-out-of-bounds", b"\xff\xd8nonsense": "bad-segment", good[:4] + b"\0\0\xff\xff" + good[8:]: "directory-out-of-bounds",
        good[:8] + b"\xff\xff" + good[10:]: "directory-out-of-bounds", ex.jpeg_with(b"XX" + good[2:]): "not-tiff",
    }
    for data, why in damaged.items():
        with pytest.raises(Unreadable, match=why):
            ex.photo_tags(data)
    loop = bytearray(good)
    at = loop.index(b"\x87\x69")
    loop[at + 8 : at + 12] = (8).to_bytes(4, "big")  # the photograph's directory is the main one
    with pytest.raises(Unreadable, match="directory-cycle"):
        ex.photo_tags(bytes(loop))
    for cut in range(len(good)):  # however much is missing, it is a named reason or fewer tags
        try:
            ex.photo_tags(good[:cut])
        except Unreadable:
            pass


def test_nearest_samples(spark):
    pick = np.random.default_rng(4)
    samples = [(45 + float(a), 7 + float(b), float(i)) for i, (a, b) in enumerate(pick.normal(0, 0.02, (300, 2)))]
    places = [(i, 45 + float(a), 7 + float(b)) for i, (a, b) in enumerate(pick.normal(0, 0.05, (80, 2)))] + [(80, -60.0, 170.0)]
    points, table = spark.createDataFrame(places, "point_id int, lat double, lon double"), spark.createDataFrame(samples, "lat double, lon double, elevationM double")
    best = {i: min((math.hypot(lat - a, lon - b), h) for a, b, h in samples) for i, lat, lon in places}
    assert {r.point_id: (round(r.apartDeg, 9), r.elevationM) for r in cloud.nearest(points, table, 0.01).collect()} == {i: (round(d, 9), h) for i, (d, h) in best.items()}
    assert {r.point_id: r.elevationM for r in cloud.within_tolerance(points, table, 0.01).collect()} == {i: h if d <= 0.01 else None for i, (d, h) in best.items()}
    assert [r.elevationM for r in cloud.nearest(points, table.where("false"), 90.0).collect()] == [None] * 81


def test_backdrops(spark):
    """Two viewpoints: a line with a hole, and one that never enters the frame."""
    line = [(1, 0, -10.0, 50.0), (1, 1, 30.0, 20.0), (1, 2, None, None), (1, 3, 60.0, 40.0), (1, 4, 90.0, 10.0), (2, 0, -50.0, -5.0), (2, 1, -20.0, -5.0)]
    points = spark.createDataFrame(line, "observer_id int, at int, xPx double, yPx double")
    lines = backdrop.polylines(points, 100, 80)
    assert {(r.observer_id, r.first): [(p.x, p.y) for p in r.points] for r in lines.collect()} == {(1, 0): [(0.0, 42.5), (30.0, 20.0)], (1, 3): [(60.0, 40.0), (90.0, 10.0)]}
    captions = spark.createDataFrame([(1, "A & <B>"), (2, "none")], "observer_id int, caption string")
    svg = {r.observer_id: r.svg for r in backdrop.backdrops(lines, captions, backdrop.Frame(width_px=100, height_px=80)).collect()}
    assert svg[1].count("<polygon") == 2 and '<polygon points="0,42.5 30,20 30,80 0,80" fill="#20262b"/>\n<polygon points="60,40 90,10 90,80 60,80"' in svg[1]
    assert "A &amp; &lt;B&gt;" in svg[1] and backdrop.CAPTION in svg[1] and svg[1].index("url(#sky)") < svg[1].index("<polygon") < svg[1].index("url(#hatch)")
    assert "<polygon" not in svg[2] and backdrop.CAPTION in svg[2]


def test_windows_beside_their_sidecars(spark, tmp_path):
    import json

    sound = {"name": "w", "data": "w.raw", "format": ti.LAYOUT, "geometry": {"northLat": 46.0, "westLon": 7.0, "rows": 3, "cols": 2, "latStepDeg": 0.1, "lonStepDeg": 0.1}, "source": {"tile": "N45E007", "extractedFromRow": 0, "extractedFromCol": 5}}
    wrong = {"unsupported-format": {"format": "float"}, "no-geometry": {"geometry": None}, "no-provenance": {"source": None}, "no-name-or-data": {"data": None}, "bad-count": {"geometry": sound["geometry"] | {"rows": 1.5}}, "bad-spacing": {"geometry": sound["geometry"] | {"latStepDeg": 0}}}
    for i, (why, change) in enumerate({"": {}, **wrong, "short": {"name": "short", "data": "short.raw"}, "lost": {"name": "lost", "data": "nowhere.raw"}}.items()):
        (tmp_path / f"{i}{why}.json").write_text(json.dumps(sound | {"name": why or "w"} | change))
    (tmp_path / "w.raw").write_bytes(encode_samples([1, 2, VOID, -4, 5, 6]))
    (tmp_path / "short.raw").write_bytes(b"xx")
    found = ti.window_catalog(spark, str(tmp_path))
    assert {r["name"]: r.reason for r in found.collect()} == {"w": None, "short": None, "lost": None} | {k: k for k in wrong}
    assert [r.source.url for r in found.where("name = 'w'").collect()] == ["unknown"]
    rows = ti.window_samples(found, str(tmp_path)).collect()
    assert sorted((r.row, r.col, r.elevationM) for r in rows if r["name"] == "w") == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, -4.0), (2, 0, 5.0), (2, 1, 6.0)]
    assert {r["name"]: r.reason for r in rows if r["name"] != "w"} == {"short": "wrong-length", "lost": "wrong-length"}


def test_settings_are_filled_in_or_refused():
    from ridgeline.operators.config import SceneConfig

    assert SceneConfig().resolved() == SceneConfig(0.0, 0.0, 0.0, 200.0, 0.05, False, {})
    assert SceneConfig(tolerance_deg=0.5).resolved().tolerance_deg == 0.5
    for name in ("tolerance_deg", "col_tolerance_m", "near_field_m"):
        for bad in (-1.0, float("nan")):
            with pytest.raises(ValueError):
                SceneConfig(**{name: bad}).resolved()


def test_photographs_to_verdicts(spark, tmp_path):
    """A wall north of the camera: what stands above it is seen at the middle of the frame, what stands behind it is not; no terrain, no verdict."""
    from ridgeline.operators.photo import annotate_photos

    grid = np.full((121, 121), 1000)
    grid[48:54, :] = 2500  # latitudes about 45.55 to 45.6
    (tmp_path / "N45E007.hgt").write_bytes(encode_samples(grid))
    rational = lambda x: [int(x), 1, 0, 1, round((x - int(x)) * 360_000), 100]
    base = {
        "GPSLatitude": (ex.RATIONAL, rational(45.5)), "GPSLatitudeRef": (ex.ASCII, [b"N"]), "GPSLongitude": (ex.RATIONAL, rational(7.5)), "GPSLongitudeRef": (ex.ASCII, [b"E"]), "GPSImgDirection": (ex.RATIONAL, [0, 1]),
        "GPSImgDirectionRef": (ex.ASCII, [b"T"]), "FocalLengthIn35mmFormat": (ex.SHORT, [28]), "ExifImageWidth": (ex.SHORT, [4000]), "ExifImageHeight": (ex.SHORT, [3000]),
    }
    photos = {
        "a": base, "no lens": {k: v for k, v in base.items() if k != "FocalLengthIn35mmFormat"}, "magnetic": base | {"GPSImgDirectionRef": (ex.ASCII, [b"M"])},
        "no terrain": base | {"GPSLatitudeRef": (ex.ASCII, [b"S"]), "GPSAltitude": (ex.RATIONAL, [1500, 1])}, "no ground": base | {"GPSLatitudeRef": (ex.ASCII, [b"S"])},
    }
    files = spark.createDataFrame([(k, bytearray(ex.jpeg_with(ex.tiff_block(v)))) for k, v in photos.items()] + [("broken", bytearray(b"no photo"))], "path string, content binary")
    summits = spark.createDataFrame([("high", "High", 45.65, 7.5, 6000.0), ("behind", "Behind", 45.65, 7.5, 1400.0), ("south", "South", 45.42, 7.5, 1900.0), ("unknown", "None", 45.6, 7.5, None), ("near S", "S", -45.42, 7.5, 2000.0)], "id string, name string, lat double, lon double, elevationM double")
    blocks = ti.tile_blocks(ti.tile_files(spark, str(tmp_path)))
    got = {(r.path, r.id): r for r in annotate_photos(files, summits, blocks, [float(b) for b in range(0, 360, 5)], [1000.0 * k for k in range(1, 21)], 20.0).collect()}
    assert {k for k in got} == {("a", "high"), ("a", "behind"), ("a", "south")}  # others have no pose, no height or no terrain
    high, behind, south = (got["a", k] for k in ("high", "behind", "south"))
    assert high.visibility == "visible" and high.inFrame and abs(high.x - 0.5) < 1e-3 and high.y < 0.5 and high.groundSource == "terrain"
    assert behind.visibility == "foreground-occluded" and behind.clearanceDeg < -5
    assert south.visibility == "visible" and not south.inFrame
