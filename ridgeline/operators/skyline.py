"""Skylines from column signals and their alignment with a horizon: windows for the parallel parts, NumPy for the path.

A signal is a row (image, col, row, value). Prefix sums and box blurs are windows; the exact dynamic program over
columns runs in one task for each image (a signal is at most some hundred columns of some hundred rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.camera import unproject
from ridgeline.functions.geodesy import clamp, num
from ridgeline.shipping import ship

COLUMN = ("image", "col")


def smooth(signal: DataFrame, radius: int) -> DataFrame:
    """Centred box blur of each column, cut off at the edges."""
    near = Window.partitionBy(*COLUMN).orderBy("row").rowsBetween(-radius, radius)
    return signal.withColumn("value", F.avg("value").over(near))


def split_scores(signal: DataFrame) -> DataFrame:
    """Of each row as a split of its column: means above and below, their contrast and the variance between them."""
    order = Window.partitionBy(*COLUMN).orderBy("row")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*COLUMN)
    s = signal.withColumn("n0", F.coalesce(F.count("value").over(before), F.lit(0))).withColumn("s0", F.coalesce(F.sum("value").over(before), num(0))).withColumn("n", F.count("value").over(whole)).withColumn("s", F.sum("value").over(whole))
    s = s.where((F.col("n0") > 0) & (F.col("n0") < F.col("n")))
    above, below = F.col("s0") / F.col("n0"), (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))
    share = F.col("n0") / F.col("n")
    return s.select(*COLUMN, "row", above.alias("above"), below.alias("below"), (above - below).alias("contrast"), (share * (num(1) - share) * (above - below) * (above - below)).alias("between"))


def best_path(scores: np.ndarray, penalty: float, free: int) -> np.ndarray:
    """best_paths() of one image."""
    return best_paths(scores[None], penalty, free)[0]


def best_paths(scores: np.ndarray, penalty: float, free: int) -> np.ndarray:
    """Row of each column of each image that maximises the scores (images times columns times rows) less the cost of steps (exact).

    A step of up to ``free`` rows costs nothing, each further row ``penalty``; no step is too long, so a cliff can be followed.
    Work is rows times columns: the best within the free window first, then what a steady cost carries up and down from there.
    """
    n, n_cols, n_rows = scores.shape
    rows, best, beyond = np.arange(n_rows), scores[:, 0].astype(float), np.full((n, free), -np.inf)
    parent = np.zeros((n_cols, n, n_rows), np.int64)
    for c in range(1, n_cols):
        near = np.lib.stride_tricks.sliding_window_view(np.concatenate([beyond, best, beyond], axis=1), 2 * free + 1, axis=1)
        arg = near.argmax(axis=2) + rows - free  # the first of equals
        carried, via = np.take_along_axis(best, arg, 1), np.broadcast_to(rows, arg.shape)
        for turn in (1, -1):  # from above, then from below
            value = (carried + penalty * turn * rows)[:, ::turn]
            high = np.maximum.accumulate(value, axis=1)
            source = np.maximum.accumulate(np.where(value == high, rows, 0), axis=1)  # the nearest of equals
            carried, via = high[:, ::turn] - penalty * turn * rows, np.take_along_axis(via[:, ::turn], source, 1)[:, ::turn]
        parent[c] = np.take_along_axis(arg, via, 1)
        best = carried + scores[:, c]
    path = np.zeros((n, n_cols), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for c in range(n_cols - 1, 0, -1):
        path[:, c - 1] = parent[c][np.arange(n), path[:, c]]
    return path


def extract_skyline(signal: DataFrame, penalty: float = 0.002, free: int = 1) -> DataFrame:
    """image, col, row: the skyline of each image, from the between-split variances of its columns."""
    ship(signal.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grid = frame.pivot_table(index="col", columns="row", values="between", fill_value=0.0).sort_index()
        path = best_path(grid.to_numpy(), penalty, free)
        return pd.DataFrame({"image": frame["image"].iloc[0], "col": grid.index, "row": grid.columns.to_numpy()[path]})

    kinds = {f.name: f.dataType.simpleString() for f in signal.schema}
    return split_scores(signal).groupBy("image").applyInPandas(run, f"image {kinds['image']}, col {kinds['col']}, row {kinds['row']}")


# Where each factor of the evidence begins and where it is full, how rough a sky is, and what a readable column has.
CONTRAST, SNR, ROUGHNESS = (0.04, 0.2), (1.0, 4.0), (0.002, 0.006)
READABLE, AGREEMENT, FREE_SLOPE, SLOPE_PENALTY = 0.1, 0.12, 5.0, 1.0
#: Pictures that are read at once.
PICTURES = 16


def band_rows(height: int) -> int:
    """Rows of the two bands that a local edge is measured between."""
    return max(2, int(height * 0.015 + 0.5))


def rise(x: Column, ends: tuple[float, float]) -> Column:
    """0 up to the first end, 1 from the second on; 0 for what is no finite number."""
    low, high = ends
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), num(0)).otherwise(clamp((x - num(low)) / num(high - low), 0, 1))


FACTORS = ("contrast", "snr", "edge01", "evidence", "between")


def columns_of(image: pa.Table) -> list[np.ndarray]:
    """Rows of one image by column and row: one matrix of their places if all columns have as many rows, or one for each column."""
    col, row = image.column("col").to_numpy(), image.column("row").to_numpy()
    order = np.lexsort((row, col))
    cuts = np.flatnonzero(np.diff(col[order])) + 1
    parts = np.split(order, cuts)
    return [order.reshape(len(parts), -1)] if len({len(x) for x in parts}) == 1 else [x[None] for x in parts]


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """Of each row the value ``by`` rows further down (up, if negative); 0 outside."""
    out = np.zeros_like(x)
    if abs(by) < x.shape[1]:
        out[:, max(0, -by) : x.shape[1] - max(0, by)] = x[:, max(0, by) : x.shape[1] - max(0, -by)]
    return out


def rising(x: np.ndarray, ends: tuple[float, float]) -> np.ndarray:
    """0 up to the first end, 1 from the second on; 0 for what is no finite number."""
    low, high = ends
    return np.where(np.isfinite(x), np.clip((x - low) / (high - low), 0.0, 1.0), 0.0)


def grid_factors(value: np.ndarray, known: np.ndarray, radius: int, band: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which rows have terrain's first row's factors (all that something known is above of), and the factors; arrays of columns times rows."""
    guard, value = radius + 1, np.where(known, value, 0.0)

    def over(x: np.ndarray, has: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean of the known within rows first to last from each, and whether any is."""
        s, n = sum(shifted(x, k) for k in range(first, last + 1)), sum(shifted(has.astype(float), k) for k in range(first, last + 1))
        return s / n, n > 0

    def before(x: np.ndarray, last: int) -> np.ndarray:
        """Sum from the first row to ``last`` rows before each."""
        return shifted(np.cumsum(x, axis=1), -last)

    with np.errstate(all="ignore"):
        mean, known = over(value, known, -radius, radius)
        v = np.where(known, mean, 0.0)
        pair = known & (shifted(known.astype(float), -1) > 0)
        rough = before(np.where(pair, np.abs(v - shifted(v, -1)), 0.0), guard + 2)
        n0, s0, n = before(known.astype(float), 1), before(v, 1), known.sum(axis=1, keepdims=True)
        s, q = np.cumsum(v, axis=1)[:, -1:], np.cumsum(v * v, axis=1)[:, -1:]
        (above, has_above), (below, has_below) = over(v, known, -(guard + band), -(guard + 1)), over(v, known, guard, guard + band - 1)
        contrast = s0 / n0 - (s - s0) / (n - n0)
        top = n0 - guard - 1
        clear = 1.0 - rising(np.where(top <= 1, 0.0, rough / (top - 1)), ROUGHNESS)
        share = n0 / n
        between = share * (1.0 - share) * contrast * contrast
        within = np.sqrt(np.maximum(0.0, np.maximum(0.0, q / n - (s / n) * (s / n)) - between))
        snr = np.where(within > 0, contrast / within, np.inf)
        edge = np.where(has_above & has_below, np.clip((above - below) / np.maximum(contrast, 1e-9), 0.0, 1.0), 1.0)
        evidence = rising(contrast, CONTRAST) * rising(snr, SNR) * edge * clear
        step = (contrast > 0) & (clear > 0)
    values = (contrast, np.where(snr == np.inf, SNR[1], snr), edge, evidence, between)
    return n0 > 0, {k: np.where(step, x, 0.0) for k, x in zip(FACTORS, values, strict=True)}


def step_factors(signal: DataFrame, height: int, radius: int = 1, band: int | None = None) -> DataFrame:
    """image, col, row, contrast, snr, edge01, evidence, between: every row of a column as the first row of terrain under sky.

    They are 0 where what lies above is not brighter, or too rough for sky. Images are dealt out by one shuffle; an image's
    factors are sums over its columns in arrays.
    """
    ship(signal.sparkSession)
    band = band or band_rows(height)
    kinds = {f.name: f.dataType.simpleString() for f in signal.schema}

    def run(image: pa.Table) -> pa.Table:
        value, known, places, found = *known_values(image), [], {k: [] for k in FACTORS}
        for at in columns_of(image):
            has, factors = grid_factors(value[at], known[at], radius, band)
            places.append(at[has])
            for k in FACTORS:
                found[k].append(factors[k][has])
        out = image.select([*COLUMN, "row"]).take(pa.array(np.concatenate(places)))
        for k in FACTORS:
            out = out.append_column(k, pa.array(np.concatenate(found[k])))
        return out

    schema = f"image {kinds['image']}, col {kinds['col']}, row {kinds['row']}, " + ", ".join(f"{k} double" for k in FACTORS)
    return signal.select(*COLUMN, "row", "value").groupBy("image").applyInArrow(run, schema)


def known_values(image: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    value = image.column("value")
    return value.to_numpy().astype(float), value.is_valid().to_numpy()


def choose_rows(evidence: np.ndarray, between: np.ndarray, pitch: float, radius: int) -> np.ndarray:
    """Row of each column of each image: the path of most evidence, moved within the blur to where the two sides differ most."""
    def at(x: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.take_along_axis(x, row[..., None], 2)[..., 0]

    path = best_paths(evidence, SLOPE_PENALTY / pitch, max(1, int(FREE_SLOPE * pitch + 0.5)))
    best, row = at(between, path), path.copy()
    for offset in range(1, radius + 1):
        for other in (path - offset, path + offset):
            there = np.clip(other, 0, evidence.shape[2] - 1)
            better = (there == other) & (at(evidence, there) > 0) & (at(between, there) > best)
            row, best = np.where(better, there, row), np.where(better, at(between, there), best)
    return row


def agreement(row: np.ndarray, evidence: np.ndarray, height: int, window: int) -> np.ndarray:
    """How well each column's row (below 0: none) agrees with the median of the readable ones within a window; 1 where fewer than three are or the column has none."""
    clear = np.where((row >= 0) & (evidence >= READABLE), row, np.inf)
    edge = np.full((len(row), window), np.inf)
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, clear, edge], axis=1), 2 * window + 1, axis=1)
    near = np.sort(np.delete(near, window, axis=2), axis=2)
    n = np.isfinite(near).sum(axis=2)
    low, high = (np.take_along_axis(near, x[..., None], 2)[..., 0] for x in (np.maximum(n - 1, 0) // 2, np.minimum(n // 2, 2 * window - 1)))
    said = (n >= 3) & (row >= 0)
    apart = np.abs(row - np.where(said, (low + high) / 2.0, 0.0)) / float(height) / AGREEMENT
    return np.where(said, 1.0 / (1.0 + apart * apart), 1.0)


READ = ("xNorm", "rowNorm", "confidence01", "contrast", "snr", "edge01", "agreement01")


def read_grids(value: np.ndarray, known: np.ndarray, cols: np.ndarray, height: int, pitch: float, radius: int, band: int, window: int) -> dict[str, np.ndarray]:
    """READ of every column of images that have as many columns and rows as each other (arrays of images times columns times rows; cols: images times columns)."""
    n, count, rows = value.shape
    if height < 4:
        row, best = np.full((n, count), -1), {k: np.zeros((n, count)) for k in FACTORS}
    else:
        _, factors = grid_factors(value.reshape(-1, rows), known.reshape(-1, rows), radius, band)
        factors = {k: x.reshape(value.shape)[:, :, 1 : height - 1] for k, x in factors.items()}  # rows 1 to height - 2
        path = choose_rows(factors["evidence"], factors["between"], pitch, radius + 1)
        best = {k: np.take_along_axis(x, path[..., None], 2)[..., 0] for k, x in factors.items()}
        row = np.where(best["evidence"] > 0, path + 1, -1)
    agree = agreement(row, best["evidence"], height, window)
    sure = np.clip(best["evidence"] * agree, 0.0, 1.0)
    readable = (row >= 0) & (sure >= READABLE)
    found = {"xNorm": (cols + 0.5) / count, "rowNorm": np.where(readable, (row + 0.5) / float(height), np.nan), "confidence01": np.where(readable, sure, 0.0)}
    return {k: x.ravel() for k, x in (found | {k: best[k] for k in ("contrast", "snr", "edge01")} | {"agreement01": agree}).items()}


def read_skyline(signal: DataFrame, height: int, pitch: float = 1.0, radius: int = 1, band: int | None = None, window: int = 16) -> DataFrame:
    """One row for each column of each image: xNorm, rowNorm (null: not readable), confidence01 and what it is made of.

    signal: image, col, row (both from 0), value; ``height`` rows; ``pitch``: source pixels a column stands for. The path through a
    column's evidence is found in one task for each image (see best_paths); an image is bounded by its pixels.
    """
    ship(signal.sparkSession)
    band = band or band_rows(height)
    kinds = {f.name: f.dataType.simpleString() for f in signal.schema}

    def run(image: pa.Table) -> pa.Table:
        grids = columns_of(image)
        if len(grids) > 1:
            raise ValueError("an image's columns differ in their rows")
        value, known = known_values(image)
        out = image.select(list(COLUMN)).take(pa.array(grids[0][:, 0]))
        found = read_grids(value[grids[0]][None], known[grids[0]][None], out.column("col").to_numpy()[None], height, pitch, radius, band, window)
        for k in READ:
            out = out.append_column(k, pa.array(found[k], from_pandas=True))
        return out

    schema = f"image {kinds['image']}, col {kinds['col']}, " + ", ".join(f"{k} double" for k in READ)
    return signal.select(*COLUMN, "row", "value").groupBy("image").applyInArrow(run, schema)


def read_pictures(pictures: DataFrame, columns: int, height: int, pitch: float = 1.0, radius: int = 1, band: int | None = None, window: int = 16) -> DataFrame:
    """read_skyline() of pictures that are rows: value (an array, column after column, null where not known) and whatever else is to stay beside what is read.

    Nothing is shuffled; a task reads PICTURES at once.
    """
    ship(pictures.sparkSession)
    band, kept = band or band_rows(height), [f for f in pictures.schema if f.name != "value"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, PICTURES) for i in range(0, batch.num_rows, PICTURES)):
                n, pixels = part.num_rows, part.column("value").flatten()
                if len(pixels) != n * columns * height:
                    raise ValueError(f"a picture has no {columns} times {height} pixels")
                value, known = (x.reshape(n, columns, height) for x in (pixels.to_numpy(zero_copy_only=False).astype(float), pixels.is_valid().to_numpy(zero_copy_only=False)))
                found = read_grids(value, known, np.tile(np.arange(columns), (n, 1)), height, pitch, radius, band, window)
                each = pa.array(np.repeat(np.arange(n), columns))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(each) for c in names), pa.array(np.tile(np.arange(columns, dtype=np.int32), n)), *(pa.array(found[k], from_pandas=True) for k in READ)], names=[*names, "col", *READ]
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "col int", *(f"{k} double" for k in READ)])
    return pictures.select(*names, "value").mapInArrow(run, schema)


def skyline_summary(columns: DataFrame) -> DataFrame:
    """image, columns, coverage01, meanConfidence01, reliefNorm (weighted deviation of the readable rows)."""
    w, x = F.when(F.col("rowNorm").isNotNull(), F.col("confidence01")), F.col("rowNorm")
    mean = F.sum(w * x) / F.sum(w)
    return columns.groupBy("image").agg(
        F.count("*").alias("columns"), (F.count("rowNorm") / F.count("*")).alias("coverage01"), F.coalesce(F.avg(w), num(0)).alias("meanConfidence01"),
        F.coalesce(F.sqrt(F.greatest(num(0), F.sum(w * x * x) / F.sum(w) - mean * mean)), num(0)).alias("reliefNorm"),
    )


def weighted_moments(rows: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """Weighted mean and deviation, and the exact median."""
    m = F.sum(F.col(w) * F.col(x)) / F.sum(w)
    return rows.groupBy(*keys).agg(m.alias("mean"), F.sqrt(F.greatest(num(0), F.sum(F.col(w) * F.col(x) * F.col(x)) / F.sum(w) - m * m)).alias("deviation"), F.percentile(x, F.lit(0.5)).alias("median"))


def align(observed: DataFrame, profile: DataFrame, offsets: list[float]) -> DataFrame:
    """Weighted correlation of observed altitudes with a profile for each heading offset, and the parabolic peak of the best.

    observed: image, bearingDeg, altitudeDeg, weight; profile: image, bearingDeg (whole degrees), altitudeDeg. The
    candidates are a bounded list; a candidate joins the profile by the degree its bearing falls in.
    """
    tried = observed.select("*", F.explode(F.array(*map(num, offsets))).alias("offset"))
    at = F.pmod(F.col("bearingDeg") + F.col("offset"), num(360))
    tried = tried.withColumn("_at", at).withColumn("_deg", F.floor(at)).withColumn("_next", (F.floor(at) + 1) % 360)
    a, b = (profile.select("image", F.col("bearingDeg").cast("long").alias(k), F.col("altitudeDeg").alias(v)) for k, v in (("_deg", "_a"), ("_next", "_b")))
    joined = tried.join(a, ["image", "_deg"]).join(b, ["image", "_next"])
    p, o, w = F.col("_a") + (F.col("_at") - F.col("_deg")) * (F.col("_b") - F.col("_a")), F.col("altitudeDeg"), F.col("weight")
    sums = joined.withColumn("_p", p).groupBy("image", "offset").agg(F.sum(w).alias("w"), F.sum(w * o).alias("o"), F.sum(w * F.col("_p")).alias("p"), F.sum(w * o * o).alias("oo"), F.sum(w * F.col("_p") * F.col("_p")).alias("pp"), F.sum(w * o * F.col("_p")).alias("op"))
    vo, vp = F.col("oo") / F.col("w") - (F.col("o") / F.col("w")) ** 2, F.col("pp") / F.col("w") - (F.col("p") / F.col("w")) ** 2
    score = F.when(vo * vp > 1e-12, (F.col("op") / F.col("w") - F.col("o") * F.col("p") / F.col("w") ** 2) / F.sqrt(vo * vp)).otherwise(num(0))
    scored = sums.select("image", "offset", score.alias("score"))
    order = Window.partitionBy("image").orderBy("offset")
    l, r = F.lag("score").over(order), F.lead("score").over(order)
    curve = l - num(2) * F.col("score") + r
    peak = F.when(curve < 0, F.greatest(num(-0.5), F.least(num(0.5), num(0.5) * (l - r) / curve))).otherwise(num(0))
    best = scored.withColumn("peak", F.coalesce(peak, num(0))).groupBy("image").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.abs("offset")).alias("near"), "offset", "peak")).alias("b"))
    step = offsets[1] - offsets[0] if len(offsets) > 1 else 0.0
    return best.select("image", F.col("b.offset").alias("offsetDeg"), (F.col("b.offset") + F.col("b.peak") * num(step)).alias("refinedDeg"), F.col("b.score").alias("score"))


def observations(columns: DataFrame, least: float) -> DataFrame:
    """Readable columns of a skyline as directions: image, bearingDeg, altitudeDeg, weight, headingDeg.

    columns: image, xNorm, rowNorm (null: not readable), confidence, and the camera's headingDeg, pitchDeg, rollDeg, hFovDeg, vFovDeg.
    """
    kept = columns.where(F.col("rowNorm").isNotNull() & (F.col("confidence") >= least))
    bearing, altitude = unproject(*[F.col(c) for c in ("headingDeg", "pitchDeg", "rollDeg", "hFovDeg", "vFovDeg", "xNorm", "rowNorm")])
    return kept.select("image", bearing.alias("bearingDeg"), altitude.alias("altitudeDeg"), F.col("confidence").alias("weight"), "headingDeg")


def aligned(status: Column) -> Column:
    """Whether an alignment says anything, if only tentatively."""
    return ~status.eqNullSafe(F.lit("failed"))
