"""Rectilinear cameras as Column expressions: fields of view, projection, rotation, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import clamp, fold, num

FULL_FRAME_WIDTH_MM = 36.0
Vec = tuple[Column, Column, Column]


def hfov_deg(focal_35mm: Column) -> Column:
    return num(2) * F.degrees(F.atan(num(FULL_FRAME_WIDTH_MM) / (num(2) * focal_35mm)))


def focal_35mm(hfov: Column) -> Column:
    return num(FULL_FRAME_WIDTH_MM) / (num(2) * F.tan(F.radians(hfov) / num(2)))


def vfov_deg(hfov: Column, aspect: Column) -> Column:
    return num(2) * F.degrees(F.atan(F.tan(F.radians(hfov) / num(2)) / aspect))


def direction(bearing_deg: Column, altitude_deg: Column) -> Vec:
    """Unit vector: east, north, up."""
    b, a = F.radians(bearing_deg), F.radians(altitude_deg)
    return F.sin(b) * F.cos(a), F.cos(b) * F.cos(a), F.sin(a)


def dot(x: Vec, y: Vec) -> Column:
    return x[0] * y[0] + x[1] * y[1] + x[2] * y[2]


def axes(heading_deg: Column, pitch_deg: Column, roll_deg: Column) -> tuple[Vec, Vec, Vec]:
    """Forward, right and up of a camera; roll turns it clockwise as seen from behind."""
    h, p, r = (F.radians(x) for x in (heading_deg, pitch_deg, roll_deg))
    forward = direction(heading_deg, pitch_deg)
    right0 = (F.cos(h), -F.sin(h), num(0))
    up0 = (-F.sin(h) * F.sin(p), -F.cos(h) * F.sin(p), F.cos(p))
    right = tuple(a * F.cos(r) - b * F.sin(r) for a, b in zip(right0, up0, strict=True))
    up = tuple(a * F.sin(r) + b * F.cos(r) for a, b in zip(right0, up0, strict=True))
    return forward, right, up


def project(heading_deg: Column, pitch_deg: Column, roll_deg: Column, hfov: Column, vfov: Column, bearing_deg: Column, altitude_deg: Column) -> dict[str, Column]:
    """depth, x, y in [0, 1] across the frame from its top left, and inFrame; x and y are null behind the camera."""
    forward, right, up = axes(heading_deg, pitch_deg, roll_deg)
    ray = direction(bearing_deg, altitude_deg)
    depth = dot(ray, forward)
    front = F.when(depth > 0, depth)
    x = num(0.5) + dot(ray, right) / front / (num(2) * F.tan(F.radians(hfov) / num(2)))
    y = num(0.5) - dot(ray, up) / front / (num(2) * F.tan(F.radians(vfov) / num(2)))
    inside = F.coalesce((depth > 0) & x.between(0, 1) & y.between(0, 1), F.lit(False))
    return {"depth": depth, "x": x, "y": y, "inFrame": inside}


def unproject(heading_deg: Column, pitch_deg: Column, roll_deg: Column, hfov: Column, vfov: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Bearing and altitude of a point of the frame."""
    forward, right, up = axes(heading_deg, pitch_deg, roll_deg)
    a = (x - num(0.5)) * num(2) * F.tan(F.radians(hfov) / num(2))
    b = (num(0.5) - y) * num(2) * F.tan(F.radians(vfov) / num(2))
    e, n, u = (f + a * r + b * v for f, r, v in zip(forward, right, up, strict=True))
    return fold(F.degrees(F.atan2(e, n))), F.degrees(F.asin(clamp(u / F.sqrt(e * e + n * n + u * u), -1, 1)))


def clip_segment(ax: Column, ay: Column, bx: Column, by: Column, width: Column, height: Column) -> dict[str, Column]:
    """Parameters of the part of a segment inside the frame (Liang-Barsky); null if none is."""
    dx, dy = bx - ax, by - ay
    low, high, outside = [num(0)], [num(1)], F.lit(False)
    for p, q in ((-dx, ax), (dx, width - ax), (-dy, ay), (dy, height - ay)):
        low.append(F.when(p < 0, q / p))
        high.append(F.when(p > 0, q / p))
        outside = outside | ((p == 0) & (q < 0))
    t0, t1 = F.greatest(*low), F.least(*high)
    kept = ~outside & (t0 <= t1)
    return {"x0": F.when(kept, ax + t0 * dx), "y0": F.when(kept, ay + t0 * dy), "x1": F.when(kept, ax + t1 * dx), "y1": F.when(kept, ay + t1 * dy)}


def drag_angle_deg(pixels: Column, extent_px: Column, fov: Column) -> Column:
    """Angle that a drag of so many pixels from the frame's centre spans."""
    return F.degrees(F.atan(pixels / (extent_px / num(2)) * F.tan(F.radians(fov) / num(2))))
