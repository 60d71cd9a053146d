"""Quality classifier by Bradley-Terry pairwise ranking.

Each document has a score w . f(text). That a document marked good is preferred to one marked bad has the probability
1 / (1 + exp(-(w . (f_good - f_bad)))), and w minimises the logistic loss over preference pairs (Newton's method with
a small ridge). The scores' threshold is the exact quantile of the scores of all training rows that leaves as large a
share below as is marked bad; the result's score is the logistic of the distance from the threshold.

Features come from whole texts only (never from labels, language, source or id): lengths, repeated words and lines,
capitals, symbols, and the like. They are computed in one map over all documents. Only fitting the weights samples: it
takes about ``max_rows`` labelled rows of each mark, chosen by a hash of the id, and ``max_pairs`` seeded pairs.

Defined results: null and empty texts have features and a score like any other; labels other than 0 and 1 are not
learnt from; a document labelled twice counts twice; without both marks every score is 0.5; rows with the same id are
scored row by row; a null id is never held out; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import discard, hash_sample, map_steps, materialize, pick

#: Bounds of what is learnt from.
MAX_ROWS, MAX_PAIRS, RIDGE, SEED = 20_000, 200_000, 1e-3, 11
#: Buckets that the scores are counted in at a time.
BUCKETS = 4096
UPPER = bytes(range(65, 91))
SYMBOLS = b"!\"#$%&()*+/:;<=>@[\\]^_`{|}~"
DIGITS = b"0123456789"
FEATURES = ("log_words", "mean_word", "upper", "symbols", "digits", "distinct_words", "repeated_next", "top_word", "distinct_lines", "log_mean_line", "lone_symbols", "ends", "distinct_grams")


def features(text: bytes) -> list[float]:
    """FEATURES of one text."""
    n, words = len(text) or 1, text.split()
    k, lines = len(words) or 1, [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(len(words)), len(text) / k, (len(text) - len(text.translate(None, UPPER))) / n,
        (len(text) - len(text.translate(None, SYMBOLS))) / n, (len(text) - len(text.translate(None, DIGITS))) / n,
        len(counts) / k, sum(map(eq, words, words[1:])) / k, max(counts.values(), default=0) / k,
        len(set(lines)) / (len(lines) or 1), np.log1p(len(text) / (len(lines) or 1)), sum(c for w, c in counts.items() if len(w) == 1 and w in SYMBOLS) / k,
        text.count(b".") / k, len(set(grams)) / (len(grams) or 1),
    ]


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features array<double>) of every row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "features"])

    source = pick(df, id=id_col, text=text_col)
    return map_steps(source, "text", step, f"id {source.schema['id'].dataType.simpleString()}, features array<double>")


def fit(good: np.ndarray, bad: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = RIDGE, seed: int = SEED) -> np.ndarray:
    """Weights of the features."""
    width = len(FEATURES)
    if not len(good) or not len(bad):
        return np.zeros(width)
    both = np.concatenate([good, bad])
    spread = both.std(axis=0)
    spread[spread == 0] = 1
    pick_pairs = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    differences = (good[pick_pairs.integers(len(good), size=n)] - bad[pick_pairs.integers(len(bad), size=n)]) / spread
    w = np.zeros(width)
    for _ in range(50):
        margin = np.clip(differences @ w, -30, 30)
        p = 1 / (1 + np.exp(-margin))
        gradient = differences.T @ (p - 1) / n + ridge * w
        curve = (differences * (p * (1 - p))[:, None]).T @ differences / n + ridge * np.eye(width)
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w / spread


def neighbours(values: DataFrame, cut: int) -> tuple[float, float]:
    """The greatest of the ``cut`` least of all ``values`` (one column v, more than ``cut`` rows) and the next one.

    Counts in buckets between two of the values, narrowed to the bucket that holds both: exact, and the driver gets no
    more than BUCKETS rows at a time.
    """
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high:
        bucket = F.least(F.floor((F.col("v") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        counted = values.where(F.col("v").between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        found = sorted(counted.collect())
        at = 0
        while below + found[at]["n"] < cut:
            below += found[at]["n"]
            at += 1
        if below + found[at]["n"] == cut:
            return found[at]["high"], found[at + 1]["low"] if at + 1 < len(found) else found[at]["high"]
        low, high = found[at]["low"], found[at]["high"]
    return low, low


def held_out_fold(key: Column) -> Column:
    """Rows kept for judging: the checksum of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, held_out boolean, score double, predicted int): scores of all rows, learnt from labels outside the held-out fold."""
    rows = materialize(text_features(df, id_col, text_col), "features")
    marks = pick(labels, id=label_id, mark=label_col).where("mark in (0, 1) and id is not null").where(~held_out_fold(F.col("id")))
    known = materialize(rows.join(marks, "id"), "labelled")
    n = {r["mark"]: r["n"] for r in known.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    sample = {}
    for mark in (1, 0):
        marked = known.where(F.col("mark") == mark)
        found = hash_sample(marked, ["id"], n.get(mark, 0), max_rows).orderBy("id", "features").limit(2 * max_rows).select("features").collect()
        sample[mark] = np.array([r["features"] for r in found], float).reshape(-1, len(FEATURES))
    weighted = sum((F.col("features")[i] * F.lit(float(x)) for i, x in enumerate(fit(sample[1], sample[0]))), F.lit(0.0))
    threshold = 0.0
    if len(n) == 2:
        values = materialize(known.select(weighted.alias("v")), "training-scores")
        threshold = sum(neighbours(values, n[0])) / 2  # so many training scores lie below
        discard(values)
    raw = weighted - F.lit(threshold)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), raw))))
    scored = rows.select(F.col("id").alias(id_col), held_out_fold(F.col("id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
