"""What a review found on larger tables, each in small."""

import random

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import huffman, ngram_join


def test_whole_sets_are_no_longer_than_their_texts(spark, monkeypatch):
    """Between stages a set takes the bytes of its text, not eight for each of its n-grams."""
    pick = random.Random(3)
    base = [" ".join(pick.choice("abcdefgh") + pick.choice("xyz") for _ in range(400)) for _ in range(6)]
    texts = [t + f" end{i}" for t in base for i in range(3)]
    kept, write = [], ngram_join.materialize

    def materialize(df, name, *done):
        out = write(df, name, *done)
        if name == "sets":
            kept.append(out.agg(F.sum(sum((F.octet_length(f.name) for f in out.schema if f.dataType.simpleString() == "binary" and f.name not in ("node", "point")), F.lit(0)))).first()[0])
        return out

    monkeypatch.setattr(ngram_join, "materialize", materialize)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(df, n=4, p=85).collect()}
    assert got == {i: i - i % 3 for i in range(len(texts))}
    assert 0 < kept[0] <= sum(map(len, texts))


def test_ids_are_counted_while_they_are_made(spark):
    ids = [np.array(x, "<u4") for x in ([5, 5, 2], [7, 2], [2])]
    df = spark.createDataFrame([(i, len(x), x.tobytes()) for i, x in enumerate(ids)], "id long, n_tokens long, ids binary").repartition(2)
    rows = huffman.materialize(huffman.with_counts(df, 10), "counted")
    assert sorted(r.id for r in rows.where("n_tokens >= 0").collect()) == [0, 1, 2]
    assert huffman.summed_counts(rows.where("n_tokens < 0"), 10).tolist() == huffman.id_counts(df, 10).tolist() == [0, 0, 3, 0, 0, 2, 0, 1, 0, 0]
