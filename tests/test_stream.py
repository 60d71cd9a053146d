"""Live poses: the stream's answers are the table's, across restarts, with late rows and silent devices."""

import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators.sensors import fused_poses
from ridgeline.streaming import pose

SCHEMA = "device string, ms long, kind string, trueDeg double, magneticDeg double, accuracyDeg double, x double, y double, z double"


def reading(rng, device, ms):
    if rng.random() < 0.5:
        true = rng.uniform(0, 360) if rng.random() < 0.6 else None
        return (device, ms, "heading", true, rng.uniform(0, 360) if rng.random() < 0.7 else None, rng.choice([None, -1.0, 20.0]), None, None, None)
    scale = rng.choice([1, 1, 1, 3])
    return (device, ms, "gravity", None, None, None, *(scale * rng.uniform(-1, 1) for _ in range(3)))


@pytest.fixture(scope="module")
def events():
    """Six batches in order of time, shuffled within; devices that only ask, only turn, or fall silent."""
    rng, batches = random.Random(9), []
    for k in range(6):
        start, rows = 1_000_000 + k * 20_000, []
        for device in "abc":
            if device == "c" and k > 1:
                continue
            rows += [reading(rng, device, start + rng.randrange(20_000)) for _ in range(60)]
            rows += [(device, start + rng.randrange(20_000), "ask", *[None] * 6) for _ in range(8)]
        rows += [("asks", start + rng.randrange(20_000), "ask", *[None] * 6), ("turns", start + 5, "heading", 10.0, None, None, None, None, None), ("turns", start + 9, "ask", *[None] * 6)]
        rng.shuffle(rows)
        batches.append(rows)
    batches.append([("end", 9_000_000, "ask", *[None] * 6)])  # moves the watermark past all questions
    batches.append([("late", 1_000_001, "heading", 1.0, None, None, None, None, None), ("late", 1_000_001, "ask", *[None] * 6), ("end", 9_000_001, "ask", *[None] * 6)])
    return batches


def answers(rows):
    return {(r.device, r.atMs): tuple(round(x, 6) if isinstance(x, float) else x for x in tuple(r)[2:]) for r in rows}


def test_stream_equals_table_over_a_restart(spark, events, tmp_path):
    spark.conf.set(pose.STORE_OPTION, pose.STORE)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(batches):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = pose.live_poses(spark.readStream.schema(SCHEMA).parquet(source), late="20 seconds", declination=2.5)
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination(120)  # each batch is a query of its own, which goes on from the state of the one before
            assert query.exception() is None

    run(events)
    got = answers(spark.read.parquet(out).collect())
    table = spark.createDataFrame([r for batch in events[:-1] for r in batch], SCHEMA)
    asked = table.where("kind = 'ask' and device <> 'end'").select("device", F.col("ms").alias("atMs")).distinct()
    wanted = answers(fused_poses(table.where("kind = 'heading'"), table.where("kind = 'gravity'"), asked, 2.5).collect())
    assert len(wanted) > 80 and {k: v for k, v in got.items() if k[0] not in ("end", "late")} == {k: (*v[:1], v[1], *v[2:]) for k, v in wanted.items()}
    assert not any(k[0] == "late" for k in got)
