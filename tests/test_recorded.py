"""Stores that are written once, catalogued without reading, and pruned at run time."""

from pyspark.sql import functions as F

from ridgeline.operators import landforms as lf
from ridgeline.operators import visibility as v
from ridgeline.operators.raster import encode_samples
from ridgeline.sources import recorded, views


def test_writes_are_idempotent(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "key string, body string"
    first = spark.createDataFrame([(f"GET /{i}", f"b{i}") for i in range(40)] + [("GET /1", "a1"), ("GET /2", "b2")], schema)
    assert recorded.write_exchanges(first, path) == 40 and recorded.write_exchanges(first, path) == 0
    more = spark.createDataFrame([("GET /1", "other"), ("GET /99", None), ("POST /1", "x")], schema)
    assert recorded.write_exchanges(more, path) == 2
    held = {r.key: r.body for r in recorded.read_exchanges(spark, path).collect()}
    assert len(held) == 42 and held["GET /1"] == "a1" and held["GET /99"] is None and held["POST /1"] == "x"


def test_manifests_come_from_names_and_lengths(spark, tmp_path):
    for name, n in (("N45E006", 61), ("S01W001", 11)):
        (tmp_path / f"{name}.hgt").write_bytes(encode_samples([0] * (n * n)))
    (tmp_path / "N45E007.hgt").write_bytes(b"odd")
    (tmp_path / "notes.hgt").write_bytes(b"x")
    found = recorded.terrain_manifest(spark, str(tmp_path))
    assert {r["name"]: (r["reason"], r["size"], r["dataset"]) for r in found.collect()} == {
        "N45E006": (None, 61, "hgt-61"), "S01W001": (None, 11, "hgt-11"), "N45E007": ("bad-size", None, None), "notes": ("bad-name", None, None)
    }
    scan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in scan.split("Relation")[0]


def test_a_stored_search_prunes_folders(spark, tmp_path):
    folder, path = "/root/testdata/sf0.001", str(tmp_path / "cells")
    whole = (-90.0, -180.0, 90.0, 180.0)
    lf.write_cells(lf.import_landforms(views.landforms(spark, folder), whole), path)
    store = spark.read.parquet(path).withColumnRenamed("elevation", "elevationM")
    observers = views.observers(spark, folder).where("observer_id = 3")
    found = v.stored_within_radius(observers, store, 5.0)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    plain = v.within_radius(observers, store.drop("cell"), 5.0)
    assert {r.id for r in found.collect()} == {r.id for r in plain.collect()}
    wide = v.stored_within_radius(views.observers(spark, folder), store, 200.0)
    assert wide.count() == v.within_radius(views.observers(spark, folder), store.drop("cell"), 200.0).count() > 0
    assert found.agg(F.count("*")).first()[0] == plain.count()
