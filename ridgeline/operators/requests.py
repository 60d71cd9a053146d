"""Texts by which areas, tiles and imports are asked for and recorded: one column expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import num

# The request language of map services, and kilometres of a degree of latitude in naive boxes.
TIMEOUT_S, KM_PER_DEG = 60, 111.32


def coord(x: Column) -> Column:
    return F.format_string("%.6f", x.cast("double"))


def circle_filter(lat: Column, lon: Column, radius_km: Column) -> Column:
    metres = F.floor(radius_km * num(1000) + num(0.5)).cast("long").cast("string")
    return F.concat(F.lit("(around:"), metres, F.lit(","), coord(lat), F.lit(","), coord(lon), F.lit(")"))


def box_filter(south: Column, west: Column, north: Column, east: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", *map(coord, (south, west, north, east))), F.lit(")"))


def peaks_request(area: Column, timeout_s: float = TIMEOUT_S) -> Column:
    """The request for named peaks, as points and as outlines, in an area (a filter from circle_filter or box_filter)."""
    kinds = [F.concat(F.lit(f'  {kind}["natural"="peak"]["name"]'), area, F.lit(";")) for kind in ("node", "way")]
    return F.concat_ws("\n", F.lit(f"[out:json][timeout:{int(timeout_s + 0.5)}];"), F.lit("("), *kinds, F.lit(");"), F.lit("out body center;"))


def tile_path(name: Column) -> Column:
    """Where a store keeps a tile: by its row of latitude."""
    return F.concat(F.substring(name, 1, 3), F.lit("/"), name, F.lit(".hgt.gz"))


def naive_bounds(lat: Column, lon: Column, radius_km: Column) -> dict[str, Column]:
    """A box that holds a circle, its width taken at the side nearer to a pole; half a turn each way where a circle wraps one."""
    half = radius_km / num(KM_PER_DEG)
    south, north = F.greatest(num(-90), lat - half), F.least(num(90), lat + half)
    shrink = F.cos(F.radians(F.greatest(F.abs(south), F.abs(north))))
    wide = F.when(shrink < 1e-6, num(180)).otherwise(F.least(num(180), half / shrink))
    return {"south": south, "north": north, "west": lon - wide, "east": lon + wide}


def source_record(release: Column, south: Column, west: Column, north: Column, east: Column, retrieved: Column) -> Column:
    """What an import is from, as a struct: id, title, retrieved, access, note."""
    area = F.concat_ws(" ", F.concat_ws(",", south.cast("string"), west.cast("string")), F.lit("to"), F.concat_ws(",", north.cast("string"), east.cast("string")))
    return F.struct(
        F.concat(F.lit("overture-"), release, F.lit("-base-land")).alias("id"), F.concat(F.lit("Land features, release "), release, F.lit(": summits (ODbL-1.0)")).alias("title"),
        retrieved.alias("retrieved"), F.lit("fetched").alias("access"), F.concat(F.lit("Positions are midpoints of boxes, heights are tagged, none is sampled from terrain. Area: "), area).alias("note"),
    )
