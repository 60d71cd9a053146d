"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Stages keep the columns of ``documents``, whatever they are; the last returns the digests of the encoded texts. A stage
finds its rows again by their file and place in it, so rows that are equal in all columns stay rows of their own and no
text is shuffled to bring a decision to it unless decisions outgrow what may be broadcast.

Null, empty and very long texts, ties, repeated rows, empty tables and further columns have the results that the
operators' docstrings define. In short: a document without a letter is rejected by the first stage; a text that line
dedup empties goes; of each group of alike documents the one with the least id stays (the first in its file order if
ids tie, null ids last); the mix repeats and drops documents by their sources' targets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import join_small, materialize
from ridgeline.llm.language import identify
from ridgeline.llm.line_dedup import runs_by_document, without_runs
from ridgeline.llm.mixing import mix
from ridgeline.llm.ngram_join import similar_components
from ridgeline.llm.queries import bpe_digests

WORD = r"[^\x20\x09-\x0D]"


class Rows:
    """The rows of a stage's input with a key each; columns are renamed by position, so names can't clash."""

    def __init__(self, docs: DataFrame):
        self.names = list(docs.columns)
        try:
            keyed = docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("_key"))
        except AnalysisException:  # not a scan of files: write the keys down
            keyed = docs.select("*", F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("r")).alias("_key"))
            keyed = materialize(keyed.toDF(*[f"_{i}" for i in range(len(self.names))], "_key"), "keyed")
        self.all = keyed.toDF(*[f"_{i}" for i in range(len(self.names))], "_key")

    def at(self, name: str) -> str:
        return f"_{self.names.index(name)}"

    def narrow(self, *names: str) -> DataFrame:
        """The key and the named columns."""
        return self.all.select("_key", *[F.col(self.at(n)).alias(n) for n in names])

    def back(self, rows: DataFrame, **changed) -> DataFrame:
        """The stage's result: all columns by their names, some changed."""
        out = [changed.get(n, F.col(f"_{i}")) if self.names.index(n) == i else F.col(f"_{i}") for i, n in enumerate(self.names)]
        return rows.select(*[c.alias(n) for c, n in zip(out, self.names, strict=True)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejected documents go; ``lang`` becomes the language found."""
    rows = Rows(docs)
    found = identify(rows.narrow("text", "lang", "source"), id_col="_key")
    kept = materialize(found.where("not rejected").select("_key", "language"), "kept")
    return rows.back(join_small(rows.all, kept, "_key"), lang=F.col("language"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated runs leave the texts, ``n_chars`` follows; a text that held words and holds none now goes."""
    rows = Rows(docs)
    keyed = rows.narrow("doc_id", "text").select(F.struct("doc_id", "_key").alias("id"), "text")
    runs = runs_by_document(keyed, id_col="id").select(F.col("id._key").alias("_key"), "runs")
    text = rows.at("text")
    joined = join_small(rows.all, runs, "_key", "left").withColumn("_left", without_runs(text, "runs"))
    joined = joined.where(f"runs is null or _left rlike r'{WORD}'")
    changed = {"text": F.col("_left")}
    if "n_chars" in rows.names:
        length = F.when(F.col("runs").isNull(), F.col(rows.at("n_chars"))).otherwise(F.length("_left"))
        changed["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return rows.back(joined, **changed)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: words in fives, similarity 0.8; one document of each group stays."""
    rows = Rows(docs)
    keyed = rows.narrow("doc_id", "text").select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key").alias("id"), "text")
    groups = similar_components(keyed, n=5, p=80, q=100, id_col="id")
    gone = materialize(groups.where("id <> component_id").select(F.col("id._key").alias("_key")), "gone")
    return rows.back(join_small(rows.all, gone, "_key", "left_anti"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it."""
    rows = Rows(docs)
    mixed = mix(rows.narrow("doc_id", "text", "source"), id_col="_key", order_col="doc_id")  # keys differ from run to run
    taken = materialize(mixed.where("copies > 0").select("_key", "copies"), "taken")
    return rows.back(join_small(rows.all, taken, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids and round trip of every document that is left."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: The stages are not expressible in SQL (tokenizing, trained language profiles); tests hold what each keeps and changes against its contract.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        read, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}", read if k else None)  # a stage's result goes when the next one is written
    return docs
