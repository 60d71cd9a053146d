"""Geodesy and sight lines on a sphere as Column expressions. Metres end in M, angles in Deg, bearings are true north."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
REFRACTION_COEFFICIENT = 0.13
#: Two distances that differ by less, relative to the farther, are the same place.
COINCIDENT_DISTANCE_TOLERANCE = 1e-9
#: Occluding altitude where nothing nearer was measured; the one sentinel of the engine.
NO_NEARER_TERRAIN_ALTITUDE_DEG = -90.0


def num(x: float) -> Column:
    return F.lit(float(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(num(low), F.least(num(high), x))


def fold(x: Column, turn: float = 360.0) -> Column:
    """x modulo a turn in [0, turn); no negative zero."""
    return F.pmod(x, num(turn)) + num(0)


def normalise_longitude_deg(x: Column) -> Column:
    """(-180, 180]."""
    shifted = fold(x - num(180))
    return F.when(shifted == 0, num(180)).otherwise(shifted - num(180))


def angular_difference_deg(start: Column, end: Column) -> Column:
    """Signed shortest turn from start to end; half a turn is +180."""
    turn = fold(end - start)
    return F.when(turn > 180, turn - num(360)).otherwise(turn)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / num(2)), num(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / num(2)), num(2))
    a = clamp(a, 0, 1)
    return num(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(num(1) - a))


def initial_bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return fold(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))))


def destination(lat: Column, lon: Column, bearing_deg: Column, distance_m: Column) -> tuple[Column, Column]:
    """Latitude and longitude at the end of a great circle."""
    p, b, d = F.radians(lat), F.radians(bearing_deg), distance_m / num(EARTH_RADIUS_M)
    sine = clamp(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b), -1, 1)
    east = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * sine)
    return F.degrees(F.asin(sine)), normalise_longitude_deg(lon + F.degrees(east))


def effective_radius_m(k: float = REFRACTION_COEFFICIENT, radius_m: float = EARTH_RADIUS_M) -> float:
    if not k < 1:
        raise ValueError("the refraction coefficient must be below 1")
    return radius_m / (1 - k)


def curvature_drop_m(distance_m: Column, k: float = REFRACTION_COEFFICIENT) -> Column:
    return distance_m * distance_m / num(2 * effective_radius_m(k))


def altitude_angle_deg(eye_m: Column, target_m: Column, distance_m: Column, k: float = REFRACTION_COEFFICIENT) -> Column:
    return F.degrees(F.atan2(target_m - eye_m - curvature_drop_m(distance_m, k), distance_m))


def height_above(height_m: Column) -> Column:
    """A height above the ground; one below it is refused."""
    return F.when(height_m < 0, F.raise_error(F.concat(F.lit("height below the ground: "), height_m.cast("string"))).cast("double")).otherwise(height_m)


def flat_horizon_distance_m(height_m: Column, k: float = REFRACTION_COEFFICIENT) -> Column:
    return F.sqrt(num(2 * effective_radius_m(k)) * height_above(height_m))


def flat_horizon_dip_deg(height_m: Column, k: float = REFRACTION_COEFFICIENT) -> Column:
    return F.degrees(F.atan(-F.sqrt(num(2) * height_above(height_m) / num(effective_radius_m(k)))))


def exact_altitude_deg(eye_m: Column, target_m: Column, ground_m: Column, k: float = REFRACTION_COEFFICIENT) -> Column:
    """Altitude on the exact sphere: an independent check of the plane drop."""
    r = effective_radius_m(k)
    angle = ground_m / num(r)
    return F.degrees(F.atan2((num(r) + target_m) * F.cos(angle) - (num(r) + eye_m), (num(r) + target_m) * F.sin(angle)))


def bounding_box(lat: Column, lon: Column, radius_km: float | Column) -> dict[str, Column]:
    """South, west, north, east of a circle; the whole world where it reaches a pole."""
    d = radius_km * num(1000) / num(EARTH_RADIUS_M) if isinstance(radius_km, Column) else num(radius_km * 1000 / EARTH_RADIUS_M)
    south, north = lat - F.degrees(d), lat + F.degrees(d)
    ratio = F.sin(d) / F.cos(F.radians(lat))
    polar = (south <= -90) | (north >= 90) | (ratio >= 1)
    half = F.degrees(F.asin(clamp(ratio, -1, 1)))
    return {
        "south": F.greatest(num(-90), south), "north": F.least(num(90), north),
        "west": F.when(polar, num(-180)).otherwise(lon - half), "east": F.when(polar, num(180)).otherwise(lon + half),
    }


def lon_width_deg(west: Column, east: Column) -> Column:
    return F.when(east - west >= 360, num(360)).otherwise(fold(east - west))


def lon_offset_east_deg(west: Column, lon: Column) -> Column:
    """Direct where in range, folded otherwise (folding costs an ulp)."""
    direct = lon - west
    return F.when((direct >= 0) & (direct < 360), direct).otherwise(fold(direct))


def lon_within(west: Column, east: Column, lon: Column) -> Column:
    return (east - west >= 360) | (lon_offset_east_deg(west, lon) <= lon_width_deg(west, east))


def cell_name(lat: Column, lon: Column) -> Column:
    """Name of the 1 degree cell, such as N45E007; latitude 90 belongs to the row below it."""
    south = F.least(num(89), F.floor(lat).cast("double")).cast("int")
    west = F.floor(fold(lon + num(180)) - num(180)).cast("int")
    return F.concat(F.when(south >= 0, "N").otherwise("S"), F.lpad(F.abs(south).cast("string"), 2, "0"), F.when(west >= 0, "E").otherwise("W"), F.lpad(F.abs(west).cast("string"), 3, "0"))
