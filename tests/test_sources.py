"""Parquet read plans against the footers, and HEIF containers built byte by byte."""

import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ridgeline.sources import heif, parquet_plan


def test_read_plans_follow_the_footers(spark, tmp_path):
    sides = [{"xmin": float(i), "xmax": i + 0.5, "ymin": 45.0 + i / 10, "ymax": 45.05 + i / 10} for i in range(100)]
    table = pa.table({"id": list(range(100)), "bbox": sides, "name": ["n" * 50] * 100})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=25)
    pq.write_table(table.slice(0, 10), tmp_path / "b.parquet", write_statistics=False)
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.parquet",), (str(tmp_path / "b.parquet"),)], "path string")
    groups = parquet_plan.row_groups(paths, ["id", "bbox"])
    by_path = {r.path.rsplit("/", 1)[1]: r for r in parquet_plan.planned_read(groups, 45.0, 30.0, 60.0, 40.0).collect()}
    a, b = by_path["a.parquet"], by_path["b.parquet"]
    footer = pq.read_metadata(tmp_path / "a.parquet").row_group(1)
    wanted = sum(footer.column(k).total_compressed_size for k in range(footer.num_columns) if footer.column(k).path_in_schema != "name")
    assert (a.groups, a.rows, a.touched_groups, a.touched_rows, a.planned_bytes, a.planned_bytes_all) == (4, 100, 1, 25, wanted, footer.total_byte_size)
    assert (b.groups, b.touched_groups, b.touched_rows) == (1, 1, 10)  # no statistics: never skipped
    first = {r.part: r.first_row for r in groups.where("path like '%a.parquet'").collect()}
    assert first == {0: 0, 1: 25, 2: 50, 3: 75}
    with pytest.raises(ValueError):
        parquet_plan.checked_rows(spark.range(3), 4)


def box(kind, content):
    return struct.pack(">I4s", 8 + len(content), kind) + content


def photo(brand=b"heic", item=b"Exif", method=0, tiff=b"MM\0*" + b"t" * 20, skip=0, told=None, iloc=True, iinf=True, beyond=0):
    ftyp = box(b"ftyp", brand + b"\0\0\0\0" + brand)
    payload = struct.pack(">I", skip if told is None else told) + b"x" * skip + tiff
    infe = box(b"infe", b"\x02\0\0\0" + struct.pack(">HH4s", 7, 0, item) + b"\0")
    parts = box(b"iinf", b"\0\0\0\0\0\x01" + infe) if iinf else b""

    def meta(offset):
        loc = b"\x01\0\0\0" + bytes([0x44, 0x00]) + struct.pack(">HHHHHII", 1, 7, method, 0, 1, offset, len(payload) + beyond)
        return box(b"meta", b"\0\0\0\0" + parts + (box(b"iloc", loc) if iloc else b""))

    start = len(ftyp) + len(meta(0)) + 8
    return ftyp + meta(start) + box(b"mdat", payload)


def test_the_exif_item_is_found_or_the_reason_named(spark):
    cases = {
        "plain": photo(), "skipped": photo(skip=6), "wrong offset": photo(skip=5, told=1), "not-heif": photo(brand=b"isom"), "no-exif-item": photo(item=b"mime"), "no-item-info": photo(iinf=False), "no-item-location": photo(iloc=False),
        "unsupported-construction-method": photo(method=1), "not-tiff": photo(tiff=b"PNG" + b"t" * 20), "extent-out-of-bounds": photo(beyond=9), "no-meta-box": box(b"ftyp", b"heic\0\0\0\0heic"), "empty": b"",
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()] + [("null", None)], "path string, content binary")
    got = {r.path: r for r in heif.located_exif(files).collect()}
    for name in ("plain", "skipped", "wrong offset"):
        assert bytes(got[name].tiff) == b"MM\0*" + b"t" * 20 and got[name].failure is None and got[name].brands == ["heic", "heic"]
    for name in ("empty", "null"):
        assert got[name].failure == "not-heif" and got[name].brands == []
    for name in set(cases) - {"plain", "skipped", "wrong offset", "empty"}:
        assert got[name].failure == name and got[name].tiff is None
