"""Skylines as lines inside a frame, and the drawn backdrop that stands in for a photograph: sky, silhouettes, a watermark and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import num
from ridgeline.operators.overlay import Frame, clipped_segments, coordinate, escape_xml

# Colours, and the line that says that nothing here is a photograph (a required text).
SKY_TOP, SKY_LOW, ROCK, HATCH = "#12263a", "#5c7f9e", "#20262b", "#7f8c99"
CAPTION = "SYNTHETIC BACKDROP — computed SRTM terrain silhouette, not a photograph"


def polylines(points: DataFrame, width: float, height: float) -> DataFrame:
    """observer_id, first, points (array of x, y): the runs of a line inside the frame. points: as for clipped_lines()."""
    seg = clipped_segments(points, width, height)
    ends = F.sort_array(F.collect_list(F.struct("at", "x0", "y0", "x1", "y1")))
    runs = seg.groupBy("observer_id", "run").agg(F.min("at").alias("first"), ends.alias("s"))
    start = F.array(F.struct(F.col("s")[0]["x0"].alias("x"), F.col("s")[0]["y0"].alias("y")))
    rest = F.transform("s", lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y")))
    return runs.select("observer_id", "first", F.concat(start, rest).alias("points"))


def point_list(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(coordinate(p["x"]), F.lit(","), coordinate(p["y"]))), " ")


def silhouette(points: Column, height: float) -> Column:
    """A run closed down to the frame's foot below its own two ends, so that a hole in the line stays a hole."""
    last, first = F.element_at(points, -1), F.element_at(points, 1)
    foot = F.array(F.struct(last["x"].alias("x"), num(height).alias("y")), F.struct(first["x"].alias("x"), num(height).alias("y")))
    return F.when(F.size(points) > 1, F.concat(F.lit('<polygon points="'), point_list(F.concat(points, foot)), F.lit(f'" fill="{ROCK}"/>')))


def backdrops(lines: DataFrame, captions: DataFrame, frame: Frame = Frame()) -> DataFrame:
    """observer_id, svg: one document for each row of captions (observer_id, caption), with the silhouettes of its lines from left to right of the sweep."""
    w, h = frame.width_px, frame.height_px
    size = max(11, int(h * 0.018 + 0.5))
    base = h - size * 1.6
    drawn = lines.groupBy("observer_id").agg(F.sort_array(F.collect_list(F.struct("first", silhouette(F.col("points"), h).alias("svg")))).alias("runs"))
    text = lambda y, px, fill, width, body: F.concat(
        F.lit(f'<text x="{size}" y="{y:g}" font-size="{px:g}" fill="{fill}" stroke="#000000" stroke-opacity="0.7" stroke-width="{width:g}" paint-order="stroke">'), body, F.lit("</text>")
    )
    head = "\n".join((
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}">', "<defs>",
        f'<linearGradient id="sky" x1="0" y1="0" x2="0" y2="1"><stop offset="0" stop-color="{SKY_TOP}"/><stop offset="1" stop-color="{SKY_LOW}"/></linearGradient>',
        '<pattern id="hatch" width="24" height="24" patternUnits="userSpaceOnUse" patternTransform="rotate(45)">'
        f'<line x1="0" y1="0" x2="0" y2="24" stroke="{HATCH}" stroke-width="2" stroke-opacity="0.1"/></pattern>', "</defs>", f'<rect x="0" y="0" width="{w}" height="{h}" fill="url(#sky)"/>',
    ))
    rock = F.array_compact(F.coalesce(F.transform("runs", lambda x: x["svg"]), F.array().cast("array<string>")))
    lines_of = F.concat(
        F.array(F.lit(head)), rock, F.array(F.lit(f'<rect x="0" y="0" width="{w}" height="{h}" fill="url(#hatch)"/>')),
        F.array(text(base, size, "#ffffff", max(2, size * 0.18), F.lit(CAPTION)), text(base + size * 1.35, size * 0.85, "#e8eef4", max(2, size * 0.15), escape_xml(F.col("caption"))), F.lit("</svg>")),
    )
    return captions.join(drawn, "observer_id", "left").select("observer_id", F.array_join(lines_of, "\n").alias("svg"))
