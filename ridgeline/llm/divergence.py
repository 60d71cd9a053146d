"""Source divergence audit: how far apart the vocabularies of a language's sources are, and which terms set a source apart.

A group is a language with a source. Every group has a share of each kept term (terms of at least ``min_docs`` documents
of the language), smoothed and in whole billionths. Two groups of a language are as far apart as their shares differ in
sum over all kept terms; a group's own terms are those of which its share exceeds the language's.

The terms of a language are dealt into blocks by a hash and its sources into blocks by rank. A task gets a block of terms
with two blocks of sources as dense int64 matrices (group by term), takes the differences of all pairs by broadcasting a
slice of terms at a time, and gives the sums of its block and, for each group, a heap of its own greatest terms. Sums and
heaps are merged by Spark. A task never holds more than 2 x SOURCES x (about TERMS) numbers, however large a group is:
counts are summed before they are shuffled, in Python for each megabyte of text and again by Spark for each partition.

All arithmetic is in whole numbers, exact while a language has fewer than 9e15 terms in its texts.

Defined results: null text, language and source are empty strings; texts without terms count for their group's existence;
a language without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; a group without
terms has the smoothed share of each; repeated rows are documents of their own; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import discard, join_hot, materialize, pick, step_batches

#: A term is a run of letters A to Z and of any characters beyond ASCII, without regard to the case of A to Z.
TERM, GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: Documents of a kept term, what is added to each count, what shares are counted in, terms listed for a group.
MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: About how many terms and at most how many sources a block has; terms that are broadcast at a time; bytes of text looked through at a time.
TERMS, SOURCES, SLICE, PIECE = 1024, 64, 64, 1 << 20


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, about PIECE bytes of it at a time."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield TERM.findall(text, at, end)
        at = end


def count_step(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Terms of a step's rows by group: how often, and in how many documents."""
    often, within = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
        seen: set[bytes] = set()
        for terms in term_lists(text.lower()):
            often[lang, source].update(terms)
            seen.update(terms)
        within[lang, source].update(seen)
    sizes = [len(x) for x in often.values()]
    names = [pa.array([g[i] for g in often], pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))) for i in range(2)]
    terms = pa.array([t for x in often.values() for t in x], pa.binary()).cast(pa.string())
    counts = [n for x in often.values() for n in x.values()], [within[g][t] for g, x in often.items() for t in x]
    return pa.RecordBatch.from_arrays([*names, terms, *(pa.array(x, pa.int64()) for x in counts)], names=["lang", "source", "term", "n", "docs"])


def shares(count: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * vocabulary)), by three digits of a thousand so that nothing overflows."""
    over, under, out = count + SMOOTH, total + SMOOTH * vocabulary, 0
    for _ in range(3):
        over = over * 1000
        out = out * 1000 + over // under
        over = over % under
    return out + 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of all rows of ``a`` from all rows of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], SLICE):
        out += np.abs(a[:, None, k : k + SLICE] - b[None, :, k : k + SLICE]).sum(axis=2)
    return out


def tile(table: pa.Table) -> pa.Table:
    """One block of terms with two blocks of sources (or one with itself): sums of each pair, and each group's greatest terms."""
    def column(name: str) -> np.ndarray:
        return table.column(name).to_numpy()

    names = table.column("source").to_pylist()
    groups = np.flatnonzero(table.column("term").is_null().to_numpy())
    groups = groups[np.argsort(column("i")[groups])]
    cells = np.flatnonzero(table.column("term").is_valid().to_numpy())
    block_a, block_b = (int(column(x)[0]) for x in ("a", "b"))
    lang, vocabulary, overall = table.column("lang")[0].as_py(), int(column("v")[0]), int(column("lang_n")[0])
    terms, nth = np.unique(table.column("term").take(pa.array(cells)).to_numpy(zero_copy_only=False).astype(object), return_inverse=True) if len(cells) else (np.array([], object), cells)
    counts = np.zeros((len(groups), len(terms)), np.int64)
    everywhere = np.zeros(len(terms), np.int64)
    row = np.searchsorted(column("i")[groups], column("i")[cells])
    counts[row, nth], everywhere[nth] = column("n")[cells], column("all")[cells]
    out = {"lang": [], "part": [], "source": [], "item": [], "value": []}

    def add(part: str, source: int, items: list[str], values: list[int]) -> None:
        for key, more in (("lang", [lang] * len(items)), ("part", [part] * len(items)), ("source", [names[groups[source]]] * len(items)), ("item", items), ("value", values)):
            out[key] += more

    if vocabulary:
        share = shares(counts, column("group_n")[groups][:, None], vocabulary)
    else:
        share = np.zeros((len(groups), 0), np.int64)
    block = column("i")[groups] // SOURCES
    first, second = np.flatnonzero(block == block_a), np.flatnonzero(block == block_b)
    sums = distances(share[first], share[second])
    for x, g in enumerate(first.tolist()):
        later = np.flatnonzero(second > g)
        add("pair", g, [names[groups[second[y]]] for y in later], sums[x, later].tolist())
    if block_a == block_b and len(terms):
        excess = share - shares(everywhere, np.int64(overall), vocabulary)
        for g in range(len(groups)):
            own = np.flatnonzero((counts[g] > 0) & (excess[g] > 0))
            heap = sorted(own.tolist(), key=lambda t: (-excess[g, t], terms[t].encode()))[:TOP]
            add("term", g, [terms[t] for t in heap], excess[g, heap].tolist())
    return pa.table(out, schema=pa.schema([(k, pa.int64() if k == "value" else pa.string()) for k in out]))


def audit_sources(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances from every other source of the language and the group's own terms (at most TOP)."""
    texts = pick(df, text=text_col, lang=lang_col, source=source_col)
    texts = texts.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in step_batches(batches, "text"):
            yield count_step(step)

    found = texts.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    counts = materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    rows = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "kept-terms", counts)

    langs = rows.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("k"))
    in_lang = Window.partitionBy("lang")
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = groups.withColumn("i", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("blocks", F.floor((F.count("*").over(in_lang) - 1) / SOURCES).cast("int") + 1)
    groups = groups.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int"))
    groups = materialize(groups, "groups")

    cells = join_hot(rows, groups, ["lang", "source"], "k")
    cells = cells.withColumn("source", F.lit(None).cast("string")).withColumn("t", F.pmod(F.xxhash64("term"), F.col("term_blocks").cast("long")).cast("int"))
    whole = groups.drop("k").withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "all": F.lit(0).cast("long")})
    whole = whole.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
    own = F.floor(F.col("i") / SOURCES).cast("int")
    both = cells.unionByName(whole).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.withColumn("a", F.least(own, "other")).withColumn("b", F.greatest(own, "other")).drop("other", "blocks", "term_blocks")
    tiles = both.groupBy("lang", "a", "b", "t").applyInArrow(tile, "lang string, part string, source string, item string, value long")
    sums = tiles.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    sums = materialize(sums, "divergence", rows, groups)

    there, back = F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    pairs = sums.where("part = 'pair'").select("lang", "part", "value", F.inline(F.array(there, back)))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(by_value)), sums.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")
