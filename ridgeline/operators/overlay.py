"""Overlays: which summits are named, where their labels stand, how the skyline is drawn, and what is said about it."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import camera as cam
from ridgeline.functions.geodesy import fold, num
from ridgeline.functions.text import text_width_em


def _half_up(x: float) -> int:
    return floor(x + 0.5)


@dataclass(frozen=True)
class Frame:
    """A frame's size and what follows from it; the shares are fixed values."""

    width_px: int = 1600
    height_px: int = 1200
    levels: int = 6

    @property
    def name_px(self) -> int:
        return max(12, _half_up(self.height_px * 0.022))

    @property
    def detail_px(self) -> int:
        return max(9, _half_up(self.name_px * 0.72))

    @property
    def padding_px(self) -> int:
        return max(2, _half_up(self.name_px * 0.35))

    @property
    def block_px(self) -> float:
        """Height of a label: two lines and the padding."""
        return 2 * self.padding_px + 1.15 * (self.name_px + self.detail_px)

    @property
    def pole_px(self) -> int:
        return max(18, _half_up(self.height_px * 0.06))

    @property
    def step_px(self) -> int:
        return _half_up(self.block_px + self.padding_px)

    @property
    def margin_px(self) -> int:
        return max(2, _half_up(self.width_px * 0.01))

    @property
    def reachable(self) -> int:
        """Levels of labels whose poles are short enough."""
        room = max(self.pole_px, _half_up(self.height_px * 0.3)) - self.pole_px
        return max(1, min(self.levels, floor(room / self.step_px) + 1))

    gap_px = 3


def labelled(visibility: Column) -> Column:
    """Summits that other ground hides get no label."""
    return ~visibility.eqNullSafe(F.lit("foreground-occluded"))


def obscured(visibility: Column) -> Column:
    return F.coalesce(visibility.isin("self-occluded", "marginal"), F.lit(False))


def drawn(peaks: DataFrame, obscured_too: bool) -> DataFrame:
    """Peaks of an overlay; the switch leaves out those that their own landform hides, and no others."""
    return peaks if obscured_too else peaks.where(~F.col("visibility").eqNullSafe(F.lit("self-occluded")))


def detail_text(elevation_m: Column, distance_km: Column, visibility: Column) -> Column:
    measures = F.concat(F.floor(elevation_m + num(0.5)).cast("long").cast("string"), F.lit(" m · "), F.format_string("%.1f", distance_km), F.lit(" km"))
    suffix = F.when(visibility == "marginal", " · may be hidden").when(obscured(visibility), " · summit obscured").otherwise("")
    return F.concat(measures, suffix)


def partition(peaks: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """Adds status, rank, budget, xPx, yPx, labelWidthPx: occluded, off-frame, candidate, or crowded-out by the budget of labels.

    peaks: observer_id, id, name, altitudeDeg, distanceKm, elevationM, visibility, and x, y, inFrame of the projection.
    """
    detail = detail_text(F.col("elevationM"), F.col("distanceKm"), F.col("visibility"))
    width = F.greatest(text_width_em(F.col("name")) * num(frame.name_px), text_width_em(detail) * num(frame.detail_px)) + num(2 * frame.padding_px)
    state = F.when(~labelled(F.col("visibility")), "occluded").when(~F.col("inFrame"), "off-frame").otherwise("candidate")
    out = peaks.withColumn("status", state).withColumn("detail", detail).withColumn("labelWidthPx", width)
    out = out.withColumn("xPx", F.col("x") * num(frame.width_px)).withColumn("yPx", F.col("y") * num(frame.height_px))
    of = Window.partitionBy("observer_id", "status")
    columns = F.greatest(num(1), F.floor(num(frame.width_px - 2 * frame.margin_px) / F.avg("labelWidthPx").over(of)))
    out = out.withColumn("budget", F.greatest(F.lit(1), F.floor(num(0.75) * columns * num(frame.reachable)).cast("long")))
    out = out.withColumn("rank", F.row_number().over(of.orderBy(F.desc("altitudeDeg"), F.desc("elevationM"), "id")).cast("long"))
    over = (F.col("status") == "candidate") & (F.col("rank") > F.col("budget"))
    return out.withColumn("status", F.when(over, "crowded-out").otherwise(F.col("status")))


def boxes(x: float, y: float, width: float, frame: Frame):
    """Places for a label, in order: above its summit level by level, then below; those that don't fit the frame's height are left out."""
    low, high = frame.margin_px, max(frame.margin_px, frame.height_px - frame.margin_px - frame.block_px)
    left = min(max(x - width / 2, frame.margin_px), max(frame.margin_px, frame.width_px - frame.margin_px - width))
    for direction, sign in (("up", -1), ("down", 1)):
        for level in range(frame.reachable):
            tip = y + sign * (frame.pole_px + level * frame.step_px)
            top = tip - frame.gap_px - frame.block_px if sign < 0 else tip + frame.gap_px
            kept = min(max(top, low), high)
            yield direction, level, left, kept, abs(kept - top) < 1e-9


def place(rows: pd.DataFrame, frame: Frame) -> pd.DataFrame:
    """One observer's candidates (at most a frame's budget of them) placed by rank; what finds no free place is crowded out."""
    rows, taken, out = rows.sort_values("rank"), [], []
    for row in rows.itertuples(index=False):
        width, height = row.labelWidthPx, frame.block_px
        every = list(boxes(row.xPx, row.yPx, width, frame))
        fitting = [b for b in every if b[4]]
        free = (b for b in fitting if not any(b[2] < u[0] + u[2] and u[0] < b[2] + width and b[3] < u[1] + height and u[1] < b[3] + height for u in taken))
        chosen = next(free, None)
        if chosen is None and fitting:
            out.append((row.observer_id, row.id, "crowded-out", None, None, None, None, None))
            continue
        overlapped, box = chosen is None, chosen or every[0]
        taken.append((box[2], box[3], width))
        out.append((row.observer_id, row.id, "labelled", box[0], box[1], box[2], box[3], overlapped))
    return pd.DataFrame(out, columns=["observer_id", "id", "status", "direction", "level", "boxX", "boxY", "overlapped"]).astype({"level": "Int32"})


def layout(peaks: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """observer_id, id, status, direction, level, boxX, boxY, overlapped of every peak: partition(), then candidates placed per observer."""
    parted = partition(peaks, frame)
    schema = "observer_id bigint, id string, status string, direction string, level int, boxX double, boxY double, overlapped boolean"
    candidates = parted.where("status = 'candidate'").select(F.col("observer_id").cast("long").alias("observer_id"), "id", "rank", "xPx", "yPx", "labelWidthPx")
    placed = candidates.groupBy("observer_id").applyInPandas(lambda rows: place(rows, frame), schema)
    return placed.unionByName(parted.where("status <> 'candidate'").select(F.col("observer_id").cast("long").alias("observer_id"), "id", "status"), allowMissingColumns=True)


# -- lines ----------------------------------------------------------------------------------------------------------


def clipped_segments(points: DataFrame, width: float, height: float) -> DataFrame:
    """observer_id, at, run, x0, y0, x1, y1: the parts of a line's segments that lie inside the frame, numbered by the run they are in.

    points: observer_id, at, xPx, yPx (null where there is none). Consecutive points are segments; a run goes on while one
    segment's clipped end is the next one's clipped start; segments of no length start none.
    """
    order = Window.partitionBy("observer_id").orderBy("at")
    pair = points.select("observer_id", "at", "xPx", "yPx", F.lead("xPx").over(order).alias("bx"), F.lead("yPx").over(order).alias("by"))
    clip = cam.clip_segment(F.col("xPx"), F.col("yPx"), F.col("bx"), F.col("by"), num(width), num(height))
    seg = pair.select("observer_id", "at", *[x.alias(k) for k, x in clip.items()])
    flat = (F.abs(F.col("x1") - F.col("x0")) <= 1e-9) & (F.abs(F.col("y1") - F.col("y0")) <= 1e-9)
    joins = (F.abs(F.lag("x1").over(order) - F.col("x0")) <= 1e-9) & (F.abs(F.lag("y1").over(order) - F.col("y0")) <= 1e-9)
    seg = seg.withColumn("_flat", flat).withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return seg.withColumn("run", F.sum("_new").over(order)).where("x0 is not null and not _flat").drop("_flat", "_new")


def clipped_lines(points: DataFrame, width: float, height: float) -> DataFrame:
    """observer_id, first, segments, length: the runs of a line that lie inside the frame (see clipped_segments)."""
    seg = clipped_segments(points, width, height)
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), num(2)) + F.pow(F.col("y1") - F.col("y0"), num(2)))
    runs = seg.groupBy("observer_id", "run").agg(F.min("at").alias("first"), F.count("*").alias("segments"), F.sum(length).alias("length"))
    return runs.drop("run")


# -- directions -----------------------------------------------------------------------------------------------------


def rotate_vertical(d: cam.Vec, turn: Column) -> cam.Vec:
    c, s = F.cos(F.radians(turn)), F.sin(F.radians(turn))
    return d[0] * c + d[1] * s, d[1] * c - d[0] * s, d[2]


def rotate_axis(d: cam.Vec, axis: cam.Vec, turn: Column) -> cam.Vec:
    """Rotation by the right hand about a unit axis."""
    c, s, along = F.cos(F.radians(turn)), F.sin(F.radians(turn)), cam.dot(axis, d)
    cross = (axis[1] * d[2] - axis[2] * d[1], axis[2] * d[0] - axis[0] * d[2], axis[0] * d[1] - axis[1] * d[0])
    return tuple(x * c + k * s + a * along * (num(1) - c) for x, k, a in zip(d, cross, axis, strict=True))


def pose_offset(d: cam.Vec, heading: Column, turn: Column, tilt: Column) -> cam.Vec:
    """A direction tilted about the camera's level axis, then turned."""
    h = F.radians(heading)
    return rotate_vertical(rotate_axis(d, (F.cos(h), -F.sin(h), num(0)), tilt), turn)


def covers_bearing(gap_from: Column, gap_to: Column, bearing: Column) -> Column:
    """Whether a bearing is not strictly inside a profile's one gap (null: there is none)."""
    into = fold(bearing - gap_from)
    return F.coalesce(~((into > 0) & (into < fold(gap_to - gap_from))), F.lit(True))


def searched_span(heading: Column, hfov: Column, budget: Column) -> tuple[Column, Column]:
    half = hfov / num(2) + budget
    return heading - half, heading + half


# -- uncertainty ----------------------------------------------------------------------------------------------------

#: Errors measured on one photograph.
COMPASS_ERROR_DEG, LEVEL_ERROR_DEG = 0.6, 3.5


def pose_uncertainty(heading_source: Column, pitch_source: Column, hfov: Column, vfov: Column, width_px: Column, height_px: Column) -> dict[str, Column]:
    """Measured error of each axis, its share of half a frame, pixels a degree at the centre, and whether a part is unknown.

    Only a recorded heading and an assumed level have measured errors; what a user set has none that is known.
    """
    across = F.when(heading_source == "exif", num(COMPASS_ERROR_DEG)).otherwise(num(0))
    up = F.when(pitch_source == "user", num(0)).otherwise(num(LEVEL_ERROR_DEG))

    def share(band: Column, fov: Column) -> Column:
        part = F.least(num(1), F.tan(F.radians(band)) / F.tan(F.radians(fov / num(2))))
        return F.when(~(fov > 0) | (band <= 0), num(0)).when(band >= fov / num(2), num(1)).otherwise(part)

    def scale(fov: Column, size: Column) -> Column:
        return F.when((fov > 0) & (size > 0), size / num(2) * F.radians(num(1)) / F.tan(F.radians(fov / num(2)))).otherwise(num(0))

    unknown = ~heading_source.eqNullSafe(F.lit("exif")) | pitch_source.eqNullSafe(F.lit("user"))
    return {"acrossDeg": across, "upDeg": up, "acrossShare": share(across, hfov), "upShare": share(up, vfov), "acrossPxPerDeg": scale(hfov, width_px), "upPxPerDeg": scale(vfov, height_px), "hasUnquantified": unknown}


# -- text -----------------------------------------------------------------------------------------------------------
#
# The sentences below are texts that users of such overlays read and compare; they must be these words.


def name_list(names: Column, most: int = 4, quote: str = "") -> Column:
    """The first names and how many more there are. names: array of texts."""
    quoted = F.transform(F.slice(names, 1, most), lambda n: F.concat(F.lit(quote), n, F.lit(quote)))
    more = F.size(names) - most
    return F.concat(F.concat_ws(", ", quoted), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def crowding_text(dropped: Column) -> Column:
    """What an overlay says about summits without a label; null if all have one."""
    plural = F.when(dropped == 1, "").otherwise("s")
    return F.when(dropped > 0, F.concat(F.lit("+"), dropped.cast("string"), F.lit(" more named summit"), plural, F.lit(" in this frame — marked, too crowded to label")))


def escape_xml(x: Column) -> Column:
    """Text for XML: without control characters it can't hold, and with its five marks escaped."""
    out = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        out = F.replace(out, F.lit(mark), F.lit(f"&{name};"))
    return out


def coordinate(x: Column) -> Column:
    """At most two decimals, halves up; infinite and undefined numbers are refused."""
    sound = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.concat(F.lit("no coordinate: "), x.cast("string"))).cast("double")).otherwise(x)
    return F.regexp_replace((F.floor(sound * num(100) + num(0.5)) / num(100) + num(0)).cast("string"), r"\.0$", "")


def svg_label(x: Column, y: Column, name: Column, detail: Column) -> Column:
    """A label's two lines as an SVG group."""
    at = F.concat(F.lit(' x="'), coordinate(x), F.lit('" y="'), coordinate(y), F.lit('"'))
    return F.concat(F.lit("<g><text"), at, F.lit(">"), escape_xml(name), F.lit("</text><text"), at, F.lit(' dy="1.15em">'), escape_xml(detail), F.lit("</text></g>"))


def credit_line(holders: Column, licence: Column, publishers: Column, origins: Column) -> Column:
    """Who is to be credited. Three arrays of names and a licence's id (null: none)."""
    held = F.concat_ws(", ", F.concat_ws(", ", F.transform(holders, lambda h: F.concat(F.lit("© "), h))), licence, F.when(F.size(publishers) > 0, F.concat(F.lit("via "), F.concat_ws(", ", publishers))))
    head = F.concat_ws(", ", F.when(F.size(publishers) > 0, publishers).otherwise(origins))
    plain = F.when(licence.isNull(), head).when(head == "", licence).otherwise(F.concat(head, F.lit(" — "), licence))
    return F.when(F.size(holders) > 0, held).otherwise(plain)


def obligation(required: Column, licence: Column) -> Column:
    named = F.concat(F.lit("Attribution required by "), F.coalesce(licence, F.lit("the licence")), F.lit("."))
    return F.when(required, named).when(licence.isNotNull(), "Credit is courtesy, not a condition.").otherwise("Cited facts, no licence attached — credit is courtesy.")


def annotated_name(file: Column) -> Column:
    stem = F.regexp_replace(file, r"\.[^./\\]+$", "")
    return F.concat(F.when(stem == "", "photo").otherwise(stem), F.lit("-annotated.png"))


def alignment_text(status: Column, heading: Column, pitch: Column, confidence: Column, words: Column) -> Column:
    """One line about an alignment. words: the reason of a failure, or the concerns of a tentative one."""
    measures = F.concat(F.lit("heading "), F.format_string("%.2f", heading), F.lit("°, pitch "), F.format_string("%.2f", pitch), F.lit("° (confidence "), F.format_string("%.0f", confidence * num(100)), F.lit(" %"))
    tentative = F.concat(F.lit("tentative: "), measures, F.lit(", concerns: "), words, F.lit(")"))
    return F.when(status == "failed", F.concat(F.lit("no alignment ("), words, F.lit(")"))).when(status == "low-confidence", tentative).otherwise(F.concat(measures, F.lit(")")))


def no_terrain_text(lat: Column, lon: Column, tile: Column, held: Column) -> Column:
    """Why nothing is drawn where no terrain is held. held: array of tile names."""
    serving = F.when(F.size(held) == 0, "Nothing is held at all.").otherwise(F.concat(F.lit("Held: "), name_list(held, 6), F.lit(".")))
    return F.concat(F.lit("No terrain at "), F.format_string("%.5f", lat), F.lit(", "), F.format_string("%.5f", lon), F.lit(": tile "), tile, F.lit(" is not held. "), serving)


def scene_notes(peaks: DataFrame) -> DataFrame:
    """observer_id, note: what an overlay must say about summits that it doesn't draw or decide. peaks: observer_id, name, kind.

    kind: off-frame, foreground-occluded, marginal or unmeasured; others need no note. Names in order of the alphabet.
    """
    said = {"off-frame": "outside this frame, not drawn", "foreground-occluded": "hidden behind nearer, different hills", "marginal": "may or may not clear the ground in front", "unmeasured": "not judged"}
    noted = peaks.where(F.col("kind").isin(*said)).groupBy("observer_id", "kind").agg(F.sort_array(F.collect_list("name")).alias("names"), F.count("*").alias("n"))
    words = F.create_map(*[F.lit(x) for pair in said.items() for x in pair])
    text = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " summit ").otherwise(" summits "), words[F.col("kind")], F.lit(": "), name_list(F.col("names")))
    return noted.select("observer_id", "kind", text.alias("note"))


def svg_documents(parts: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """observer_id, svg: one document of each observer's parts (observer_id, layer, at, svg), lower layers first.

    A document holds a frame's labels and lines, whose number the frame bounds.
    """
    body = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("layer", "at", "svg"))), lambda p: p["svg"]))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{frame.width_px}" height="{frame.height_px}">'
    return parts.groupBy("observer_id").agg(F.concat(F.lit(head + "\n"), body, F.lit("\n</svg>")).alias("svg"))
