"""Every query of the training-data operators: the names and types of its columns, and its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ridgeline.llm import queries as q

FOLDER = Path("/root/testdata/sf0.001")
#: Columns that a query promises; more may follow.
PROMISED = {
    "op2_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint"} | {"component_id": "bigint"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op7_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_huffman_ids": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_ogg": {
        "doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string",
    },
}

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return [plain(x) for x in value] if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", PROMISED)
def test_columns(spark, name):
    types = dict(q.QUERIES[name](spark, str(FOLDER)).dtypes)
    assert {c: types.get(c) for c in PROMISED[name]} == PROMISED[name]


@pytest.mark.parametrize("name", q.ORACLES)
def test_sql(spark, name):
    with duckdb.connect() as con:
        for file in FOLDER.glob("*.parquet"):
            con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        wanted = con.sql(q.ORACLES[name])
        columns, rows = sorted(wanted.columns), wanted.fetchall()
        places = [wanted.columns.index(c) for c in columns]
    got = q.QUERIES[name](spark, str(FOLDER))
    assert sorted(got.columns) == columns
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[p]) for p in places]) for r in rows)
