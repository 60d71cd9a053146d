"""Language identification by Bayesian fusion of evidence.

A row's evidence: its text, the language its markup declares, the suffix of its address, and its host. For each
language l the log posterior is the sum of
  log P(l | host)       host priors from soft counts by host, smoothed by the host's domain, its suffix, and all rows,
  log P(declared | l)   how often rows of l declare it, from soft counts of all rows,
  log P(suffix | l)     likewise,
  log P(text | l)       byte trigrams of the whole text, hashed to BINS, tempered as neighbours aren't independent.
Soft counts are posteriors of a first pass that sees texts only; they are summed by grouped aggregations, so a host
that holds a third of all rows is one row per task before it is shuffled.

One more hypothesis is that the text is in none of the languages: its trigrams are then spread evenly over all bins.
It has soft counts, a prior and likelihoods like a language, but is never answered. Trigrams that a language has not
shown cost more than an even spread, so foreign texts and junk fit none; ``confidence`` is of all hypotheses.

The TAGS languages that most rows with a letter declare are learnt each (ties by name); whatever rarer tags there are share one
more profile, which like "none" is a hypothesis but no answer. So the driver and each Python worker hold (TAGS + 2) x 256 KB
at most, however many tags there are. A language's trigram table is counted over the whole
texts of all rows that declare it, or about ``max_rows`` of them, chosen by a hash of the text; trigrams it has not shown
share as much as it has shown different ones (Witten-Bell), so a thin profile expects more of the unknown. Everything
else is counted over all rows.

Defined results: a text without a letter (null and empty ones too) gives no evidence and is rejected, whatever
else the row declares; missing declarations, suffixes and hosts give no evidence; the row is rejected too if all
languages together don't reach ``least`` against none of them, or none of them reaches ``least`` of what they share
(``language`` is then the best of them all the same); ties go to the first language by name; rows with the same id are judged row by row; other
columns are ignored; an empty table, or one that declares no language to learn from, gives no language and rejects all.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import join_hot, map_steps, materialize, pick, small

MAX_ROWS, BINS, LEAST, PRIOR_ROWS, TEMPER = 20_000, 1 << 15, 0.5, 20.0, 0.25
#: Languages that have a profile of their own.
TAGS = 200
SEPARATORS = np.frombuffer(bytes(32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 * (65 <= b <= 90) for b in range(256)), np.uint8)

UNSEEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|template)\b.*?(?:</\1\s*>|\Z)")
MARKUP, MARKED_LANG = re.compile(r"<[^>]*>"), re.compile(r"(?is)<html\b[^>]*?[\s:]lang\s*=\s*[\"']?\s*([\w-]+)")
ADDRESS = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)")


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, lang, host) of every page: its text without markup, what <html lang> declares, its URL's host."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = batch.column("html").cast(pa.string()).to_pylist()
        texts = [x if x is None else html.unescape(MARKUP.sub(" ", UNSEEN.sub(" ", x))) for x in pages]
        langs = [(m := MARKED_LANG.search(UNSEEN.sub(" ", x or ""))) and m[1] for x in pages]
        hosts = [(m := ADDRESS.match(x or "")) and (m[1].rstrip(".") or None) for x in batch.column("url").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.string()) for x in (texts, langs, hosts))], names=["id", "text", "lang", "host"])

    source = pick(pages, id=id_col, url=url_col, html=html_col)
    out = map_steps(source, "html", step, f"id {source.schema['id'].dataType.simpleString()}, text string, lang string, host string")
    return out.withColumnRenamed("id", id_col)


def trigram_bins(text: bytes) -> np.ndarray:
    """Bins of the byte trigrams of a text; letters in lower case, all else below 128 is one space."""
    codes = SEPARATORS[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    if len(codes) < 3 or codes.max() == 32:
        return np.zeros(0, np.int64)
    grams = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    grams = grams[grams != 0x202020]
    return ((grams * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def normalized(declared: Column) -> Column:
    """The primary part of a language tag in lower case; null if there is none."""
    tag = F.regexp_extract(F.lower(F.trim(declared)), "^([a-z]{2,8})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", max_rows: int = MAX_ROWS, least: float = LEAST, profile: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """(id, language, confidence double, rejected boolean, declared) of every row.

    ``host_col`` holds hosts such as ``news.example.com``: its suffix is ``com``, its domain ``example.com``. ``profile``
    is that of another table, from learn_profile(), if this one is not to be learnt from.
    """
    null = F.lit(None).cast("string")
    columns = {"id": id_col, "text": text_col} | ({"declared": declared_col} if declared_col else {}) | ({"host": host_col} if host_col else {})
    rows = pick(df, **columns)
    rows = rows.select("id", "text", normalized(F.col("declared")).alias("declared") if declared_col else null.alias("declared"), F.lower("host").alias("host") if host_col else null.alias("host"))
    names, table = profile or learn_profile(rows, "text", "declared", max_rows)
    out = materialize(texts_read(rows, table), "evidence")
    if not names:
        return out.select(F.col("id").alias(id_col), null.alias("language"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"), "declared")
    parts = F.split("host", r"\.")
    out = out.withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1))).withColumn("domain", F.when(F.size(parts) > 2, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(F.col("host")))
    n = len(table)  # the last is none of them; before it, if there are more tags than TAGS, what is rarer
    soft = [F.when(F.col("letters"), F.col("p")[i]).otherwise(0.0) for i in range(n)]

    def sums(*keys: str) -> DataFrame:
        return out.groupBy(*keys).agg(*[F.sum(s).alias(f"n{i}") for i, s in enumerate(soft)], F.count("*").alias("k"))

    def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        """Left join with a table of one row a key (k: how many rows have it); a large one is merged, but for keys that are hot."""
        right = materialize(right, f"by-{key}")
        return left.join(F.broadcast(right.drop("k")), key, "left") if small(right) else join_hot(left, right, [key], "k", "left")

    def shares(frame: DataFrame, above: list[Column], weight: float = PRIOR_ROWS) -> list[Column]:
        total = sum((F.col(f"n{i}") for i in range(n)), F.lit(0.0))
        return [(F.col(f"n{i}") + weight * above[i]) / (total + weight) for i in range(n)]

    # priors: host, smoothed by domain, by suffix, by all
    whole = tuple(sums().first())[:n]
    all_rows = [((whole[i] or 0.0) + 1.0) / (sum(x or 0.0 for x in whole) + n) for i in range(n)]
    by_suffix = sums("suffix").where("suffix is not null")
    by_suffix = by_suffix.select("suffix", *[s.alias(f"s{i}") for i, s in enumerate(shares(by_suffix, [F.lit(x) for x in all_rows]))])
    by_domain = sums("suffix", "domain").where("domain is not null").join(by_suffix, "suffix", "left")
    by_domain = by_domain.select("domain", *[d.alias(f"d{i}") for i, d in enumerate(shares(by_domain, [F.coalesce(F.col(f"s{i}"), F.lit(x)) for i, x in enumerate(all_rows)]))])
    by_host = sums("domain", "host").where("host is not null").join(by_domain, "domain", "left")
    by_host = by_host.select("host", F.array(*[F.log(h) for h in shares(by_host, [F.coalesce(F.col(f"d{i}"), F.lit(x)) for i, x in enumerate(all_rows)])]).alias("host_log"), "k")

    def likelihood(key: str) -> DataFrame:
        """log P(key | language), smoothed by the key's share of all rows."""
        counted = materialize(sums(key).where(f"{key} is not null"), f"by-{key}")
        totals = counted.agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(n)]).first()
        every = sum(t or 0.0 for t in totals) or 1.0
        own = sum((F.col(f"n{i}") for i in range(n)), F.lit(0.0))
        return counted.select(key, F.array(*[F.log((F.col(f"n{i}") + (own + 1) / every) / F.lit((totals[i] or 0.0) + 1 + 1 / every)) for i in range(n)]).alias(f"{key}_log"), "k")

    placed = joined(joined(joined(out, by_host, "host"), likelihood("declared"), "declared"), likelihood("suffix"), "suffix")
    fused = [F.coalesce(F.col("host_log")[i], F.lit(float(np.log(all_rows[i])))) + F.coalesce(F.col("declared_log")[i], F.lit(0.0)) + F.coalesce(F.col("suffix_log")[i], F.lit(0.0)) + F.col("text_log")[i] for i in range(n)]
    unnamed = fused[-1]
    if n > len(names) + 1:  # together
        high, low = F.greatest(fused[-2], fused[-1]), F.least(fused[-2], fused[-1])
        unnamed = high + F.log1p(F.exp(low - high))
    placed = placed.select("id", "declared", "letters", F.array(*fused[: len(names)]).alias("l"), unnamed.alias("none")).withColumn("top", F.array_max("l"))
    placed = placed.withColumn("z", F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("l", F.col("top")).cast("int"))
    odds = F.exp(F.least(F.col("none") - F.col("top"), F.lit(700.0)))
    confidence = F.when(F.col("letters"), 1 / (F.col("z") + odds)).otherwise(0.0)
    rejected = ~F.col("letters") | (1 / F.col("z") < least) | (F.col("z") / (F.col("z") + odds) < least)
    return placed.select(F.col("id").alias(id_col), F.when(F.col("letters"), best).alias("language"), confidence.alias("confidence"), rejected.alias("rejected"), "declared")


def learn_profile(df: DataFrame, text_col: str, declared_col: str, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages that rows with a letter declare, by name, and the log probability of each bin in each and, last, in none.

    Counted over the whole texts of about ``max_rows`` rows of each; the driver gets a number for each language and bin.
    """
    rows = pick(df, text=text_col, declared=declared_col).where("text is not null and declared is not null")
    tags = rows.groupBy("declared").agg(F.count("*").alias("n"))
    top = {r["declared"]: r["n"] for r in tags.orderBy(F.desc("n"), "declared").limit(TAGS).collect()}
    rest = (tags.agg(F.sum("n")).first()[0] or 0) - sum(top.values())
    names, share = sorted(top), 1 << 30
    lines = len(names) + (rest > 0)  # the last line is that of all other tags
    most = [F.lit(x) for k, n in top.items() if n > max_rows for x in (k, share * max_rows // n)]
    if most or rest > max_rows:
        known = F.create_map(*[F.lit(x) for k in names for x in (k, share)])
        limit = F.coalesce(*([F.create_map(*most)[F.col("declared")]] if most else []), known[F.col("declared")], F.lit(share * min(max_rows, rest) // max(rest, 1) if rest else share))
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(share)) < limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((lines, BINS), np.int64)
        at = {x: i for i, x in enumerate(names)}
        for batch in batches:
            for text, declared in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("declared").to_pylist(), strict=True):
                if declared in at or rest > 0:
                    counts[at.get(declared, len(names))] += np.bincount(trigram_bins(text), minlength=BINS)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(counts.ravel()[cell], pa.int64())], names=["cell", "n"])

    table = np.zeros(lines * BINS)
    if names:
        found = rows.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        table[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    table = table.reshape(-1, BINS)
    shown = table.any(axis=1)  # texts without a letter teach nothing
    names, table = [x for x, s in zip(names, shown, strict=False) if s], table[shown]
    total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
    return names, np.log(np.vstack([(table + kinds / BINS) / (total + kinds), np.full(BINS, 1 / BINS)]))


def texts_read(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(id, declared, host, letters boolean, text_log array<double>, p array<double>): tempered log likelihoods of whole texts."""
    columns = np.ascontiguousarray(table.T)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        logs, letters = np.zeros((batch.num_rows, len(table))), np.zeros(batch.num_rows, bool)
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            bins = trigram_bins(text or b"")
            letters[i] = len(bins) > 0
            if len(bins):
                logs[i] = columns[bins].sum(axis=0) * TEMPER
        logs -= logs.max(axis=1, keepdims=True, initial=-np.inf)
        odds = np.exp(logs)
        odds /= odds.sum(axis=1, keepdims=True)
        rows_of = lambda x: pa.array(list(x), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "declared", "host")), pa.array(letters), rows_of(logs), rows_of(odds)], names=["id", "declared", "host", "letters", "text_log", "p"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_steps(rows, "text", step, f"id {kind}, declared string, host string, letters boolean, text_log array<double>, p array<double>")
