"""Poses of live devices from their sensor traces: a stream whose state is a short list of readings for each device.

Readings and questions come on one stream, in event time. A question sets a timer at its own time; when the watermark has passed
it, every reading that counts has come or is too late, and the answer is the same that operators.sensors.fused_poses() gives on
the whole table. A device's list holds what a question that is still open may ask for (its window before the oldest of them),
and nothing of a device that is silent keeps growing. State is in the state store: a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridgeline.operators.sensors import GIMBAL_LIMIT_DEG, GRAVITY_RANGE, MAX_AGE_MS, TIME_CONSTANT_MS
from ridgeline.shipping import ship

READING = "ms long, heading boolean, trueDeg double, magneticDeg double, accuracyDeg double, x double, y double, z double"
FIELDS = [c.split()[0] for c in READING.split(", ")]
ANSWER = "device string, atMs long, headingDeg double, headingRefusal string, pitchDeg double, pitchRefusal string, rollDeg double, rollRefusal string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_OPTION = "spark.sql.streaming.stateStore.providerClass"


def circular(degrees: np.ndarray, weight: np.ndarray) -> float:
    turn = np.radians(degrees)
    return float(np.degrees(np.arctan2((weight * np.sin(turn)).sum(), (weight * np.cos(turn)).sum())) % 360)


def heading_answer(rows: pd.DataFrame, at: int, known: bool, declination: float | None, max_age: int, tau: float) -> tuple[float | None, str | None]:
    if not known:
        return None, "no-samples"
    accurate = rows["accuracyDeg"].isna() | (rows["accuracyDeg"] >= 0)
    used = rows[accurate & (rows["trueDeg"].notna() | rows["magneticDeg"].notna()) & (rows["ms"] <= at) & (at - rows["ms"] <= max_age)]
    if used.empty:
        return None, "stale"
    true = used["trueDeg"].fillna(used["magneticDeg"] + (np.nan if declination is None else declination)).astype(float)
    if true.isna().any():
        return None, "needs-declination"
    return circular(true.to_numpy(), np.exp(-(at - used["ms"].to_numpy()) / tau)), None


def orientation_answer(rows: pd.DataFrame, at: int, known: bool, max_age: int, tau: float, limit: float) -> tuple[float | None, str | None, float | None, str | None]:
    used = rows[(rows["ms"] <= at) & (at - rows["ms"] <= max_age)]
    if not known or used.empty:
        why = "stale" if known else "no-samples"
        return None, why, None, why
    x, y, z = (used[c].to_numpy(float) for c in "xyz")
    size = np.sqrt(x * x + y * y + z * z)
    good = (size >= GRAVITY_RANGE[0]) & (size <= GRAVITY_RANGE[1])
    if not good.any():
        return None, "not-gravity", None, "not-gravity"
    weight = np.exp(-(at - used["ms"].to_numpy()[good]) / tau)
    pitch = np.degrees(np.arcsin(np.clip(z[good] / size[good], -1, 1)))
    mean, upright = float((weight * pitch).sum() / weight.sum()), np.abs(pitch) <= limit
    if abs(mean) > limit or not upright.any():
        return mean, None, None, "gimbal-degenerate"
    roll = circular(np.degrees(np.arctan2(x[good], -y[good]))[upright], weight[upright])
    return mean, None, roll - 360 if roll > 180 else roll, None


class PoseProcessor(StatefulProcessor):
    """One device's readings, and a timer for each of its open questions."""

    def __init__(self, declination: float | None, max_age: int, tau: float, limit: float):
        self.options = declination, max_age, tau, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getListState("readings", READING)
        self.known = handle.getValueState("known", "heading boolean, gravity boolean")

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.readings.get()) if self.readings.exists() else [], columns=FIELDS)

    def flags(self) -> tuple[bool, bool]:
        return tuple(self.known.get()) if self.known.exists() else (False, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        open_questions = set(self.handle.listTimers())
        heading, gravity = self.flags()
        fresh = []
        for frame in rows:
            for at in frame.loc[frame["kind"] == "ask", "ms"].unique().tolist():
                if at not in open_questions:
                    self.handle.registerTimer(int(at))
                    open_questions.add(at)
            told = frame[frame["kind"] != "ask"]
            heading, gravity = heading or bool((told["kind"] == "heading").any()), gravity or bool((told["kind"] == "gravity").any())
            fresh.append(told.assign(heading=told["kind"] == "heading")[FIELDS])
        held = pd.concat([self.rows(), *fresh], ignore_index=True) if fresh else self.rows()
        self.known.update((heading, gravity))
        self.keep(held, min([*open_questions, timerValues.getCurrentWatermarkInMs()]))
        return iter([])

    def keep(self, held: pd.DataFrame, oldest: int) -> None:
        """Only what a question at ``oldest`` or later may ask for stays."""
        held = held[held["ms"] >= oldest - self.options[1]]
        if held.empty:
            self.readings.clear()
        else:
            plain = held.astype(object).where(held.notna(), None)
            self.readings.put([tuple(x) for x in plain.itertuples(index=False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, held, (declination, max_age, tau, limit) = int(expiredTimerInfo.getExpiryTimeInMs()), self.rows(), self.options
        is_heading = held["heading"].astype(bool)
        known = self.flags()
        answer = (*heading_answer(held[is_heading], at, known[0], declination, max_age, tau), *orientation_answer(held[~is_heading], at, known[1], max_age, tau, limit))
        later = [t for t in self.handle.listTimers() if t != at]
        self.keep(held, min([*later, timerValues.getCurrentWatermarkInMs()]))
        yield pd.DataFrame([(key[0], at, *answer)], columns=[c.split()[0] for c in ANSWER.split(", ")])

    def close(self) -> None:
        pass


def live_poses(events: DataFrame, late: str = "2 seconds", declination: float | None = None, max_age_ms: int = MAX_AGE_MS, tau_ms: float = TIME_CONSTANT_MS, limit_deg: float = GIMBAL_LIMIT_DEG) -> DataFrame:
    """One answer for each device and time that was asked for, as soon as no reading before it can come any more.

    events (a stream): device, ms, kind ('heading', 'gravity' or 'ask'), trueDeg, magneticDeg, accuracyDeg, x, y, z. Rows later
    than ``late`` behind the newest don't count. Set STORE_OPTION to STORE in the session, as Spark asks for.
    """
    ship(events.sparkSession)
    names = ["device", "ms", "kind", *FIELDS[2:]]
    timed = events.select(F.col("device").cast("string").alias("device"), *names[1:]).withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    return timed.groupBy("device").transformWithStateInPandas(PoseProcessor(declination, max_age_ms, tau_ms, limit_deg), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")
