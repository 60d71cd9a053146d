"""Byte-level BPE, Huffman id files and Ogg media against libraries and brute force."""

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from ridgeline.llm import huffman, ogg
from ridgeline.llm.bpe import decode_bpe, encode_bpe, read_ranks, vocabulary
from ridgeline.llm.words import WordIds

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "a", "a b  c   d ", "x\n\ny", " \n x\n", "don't we'll", "été 日本語 😀 İ", "tab\tand nbsp", "aaaa" * 700, "The end.\nNext one. <|endoftext|>", "same", "same", "z" * 3000 + " q", "\0zero \x1c sep"]


def thue_morse(n, a, b):
    """Two such words, one with the letters changed about, have equal hashes by any plain polynomial modulo 2 to the 64."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits[:n])


TEXTS += [thue_morse(n, *ab) for n in (64, 1024, 2048, 4096) for ab in ("ab", "ba")] + [f"q {thue_morse(1024, 'y', 'x')} {thue_morse(1024, 'x', 'y')}"]
SCHEMA = "doc_id long, text string, ids string, TEXT string, id long"


def rows(texts):
    return [(i, t, "other", "clash", -i) for i, t in enumerate(texts)] + [(None, "null id", "x", "y", 1)]


@pytest.mark.parametrize("space_begins", [True, False])
def test_bpe_equals_the_library_and_round_trips(spark, space_begins):
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    df = spark.createDataFrame(rows(TEXTS), SCHEMA)
    got = decode_bpe(encode_bpe(df, PATH, PATTERN, space_begins), PATH, PATTERN).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == known.encode_ordinary(text)
        assert r["n_tokens"] == len(r["ids"]) // 4 and bytes(r["decoded"]) == text.encode()


def test_long_pieces_equal_the_library():
    """Unbroken letters beyond the bound of the matrices, in order of the library's own merges; a hundred thousand of them end soon."""
    ranks, pattern = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng, coder = np.random.default_rng(8), vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern, True)
    made = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in (255, 256, 257, 258, 700, 5000)] + ["a" * 3000, "ab" * 2000, "é" * 999, "日" * 400, "the" * 500]
    for text in made:
        assert coder.encode([text.encode()])[0].tolist() == library.encode_ordinary(text)
    long = "".join(rng.choice(list("etaoinshrdlu"), 100_000))
    began = time.process_time()
    ids, n = coder.encode([long.encode()])
    assert time.process_time() - began < 8 and coder.decode(ids, n) == [long.encode()]


def test_bpe_of_an_empty_table(spark):
    assert encode_bpe(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


def test_bpe_forgets_without_changing_results():
    v = vocabulary(PATH, PATTERN, True)
    v.chunks = WordIds(v.make_chunks, most=3)
    texts = [b"one two three", b"four five", b"one two", b"six"]
    ids, counts = v.encode(texts)
    again = [v.encode([t])[0].tolist() for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == again
    v.forget()


def test_huffman_files_round_trip_in_order_of_id(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*TEXTS, "<|startoftext|> X", "Σ ΑΣ ÅÉ Å", "w " * 3000]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    files = huffman.store_tokens(df, path, 49_408, 2)
    got = huffman.read_ids(files, "bigint").join(huffman.file_starts(files), ["part", "seq"]).collect()
    assert len(got) == len(texts) + 1
    at = 0
    for r in sorted(got, key=lambda r: r["start"] + r["local"]):
        text = "null id" if r["id"] is None else texts[r["id"]] or ""
        assert r["start"] + r["local"] == at
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        at += len(ids)
    order = [r["id"] for r in sorted(got, key=lambda r: r["start"] + r["local"])]
    assert order == [None, *range(len(texts))]


def test_huffman_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    files = huffman.store_tokens(empty, public_tokenizers.path("word_bpe_49k.json"), 49_408, 2)
    assert huffman.read_ids(files, "bigint").count() == 0


def test_code_lengths_are_optimal_and_limited():
    import heapq

    counts = (np.random.default_rng(1).pareto(0.6, 600) * 4).astype(np.int64)
    heap = sorted(c for c in counts.tolist() if c)
    best = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        best += both
        heapq.heappush(heap, both)
    assert int((counts * huffman.code_lengths(counts, 40)).sum()) == best
    limited = huffman.code_lengths(counts, 10)
    assert limited.max() == 10 and (limited[counts == 0] == 0).all()
    assert (2.0 ** -limited[counts > 0].astype(float)).sum() <= 1
    assert huffman.code_lengths(np.array([0, 7]), 8).tolist() == [0, 1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


def test_blocks_decode_alone():
    rng = np.random.default_rng(2)
    ids = rng.geometric(0.05, 5000).clip(max=400).astype(np.uint32)
    packed = zlib.compress(huffman.code_lengths(np.bincount(ids, minlength=512), 12).tobytes())
    data, marks = huffman.encode_documents(ids, np.array([5000]), packed, 100)
    assert huffman.decode_blocks(data[0], marks[0][7:8], np.array([100]), packed).tolist() == ids[700:800].tolist()


def test_a_damaged_file_is_refused():
    import pyarrow as pa

    ids = np.array([1, 2, 3], np.uint32)
    packed = zlib.compress(huffman.code_lengths(np.bincount(ids, minlength=4), 8).tobytes())
    data, marks = huffman.encode_documents(ids, np.array([3]), packed, 8)
    whole = bytearray(huffman.pack_file(pa.array([5]), np.array([3]), data, marks, packed, 8))
    keys, counts, back = huffman.unpack_file(bytes(whole))
    assert (keys.to_pylist(), counts.tolist(), back.tolist()) == ([5], [3], [1, 2, 3])
    whole[-1] ^= 1
    with pytest.raises(ValueError):
        huffman.unpack_file(bytes(whole))


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_page_checksum():
    assert ogg.page_crc(b"OggS and more" * 9) == slow_crc(b"OggS and more" * 9)


def test_ogg_round_trip_digests(spark):
    df = spark.createDataFrame(rows([*TEXTS, "long " * 40_000]), SCHEMA)
    got = ogg.decode_ogg(ogg.encode_ogg(df)).collect()
    assert len(got) == len(TEXTS) + 2
    by_text = {}
    for r in got:
        text = ("null id" if r["doc_id"] is None else [*TEXTS, "long " * 40_000][r["doc_id"]]) or ""
        raw = text.encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(r["payload"]) == padded and r["n_bytes"] == len(raw)
        digest = hashlib.sha256(bytes(r["media"])).hexdigest()
        assert by_text.setdefault(raw, (digest, r["feature"])) == (digest, r["feature"])
    assert ogg.encode_ogg(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ogg_packets_over_pages_streams_and_times():
    payload = np.random.default_rng(3).bytes(200_000)
    streams, damaged, skipped = ogg.read_ogg(ogg.write_ogg(payload, 200_000, packet=70_000))
    assert (len(streams), damaged, skipped) == (2, 0, 0) and all(s.ended for s in streams)
    assert ogg.payload_of(streams)[:2] == (payload, 200_000)
    small, *_ = ogg.read_ogg(ogg.write_ogg(payload[: 576 * 5], 576 * 5))
    assert ogg.packet_times(small[0], 8000, 576, 2) == pytest.approx([576 / 8000, 3 * 576 / 8000, 5 * 576 / 8000])
    assert ogg.packet_times(small[1], 8000, 576, 2) == pytest.approx([2 * 576 / 8000, 4 * 576 / 8000])


def test_ogg_damage_is_counted_and_not_guessed():
    payload = np.random.default_rng(4).bytes(576 * 400)
    media = bytearray(ogg.write_ogg(payload, len(payload)))
    media[60_000] ^= 1
    streams, damaged, skipped = ogg.read_ogg(bytes(media))
    assert damaged >= 1 and skipped > 0 and sum(s.lost_pages for s in streams) == 1
    assert all(p in payload for s in streams for p in s.packets[1:])
    assert ogg.read_ogg(b"nothing of the kind") == ([], 0, 19)


def test_many_small_files_are_one_stream(spark):
    """Files of a few bytes: several of each part, whose places in the stream go on from one to the next."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [f"word {i} and {'more ' * (i % 7)}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # a file ends after a batch
    try:
        files = huffman.write_ids(huffman.materialize(huffman.tokenize(df, path, 2), "ids"), 49_408, file_bytes=100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = huffman.read_ids(files, "bigint").join(huffman.file_starts(files), ["part", "seq"]).collect()
    assert max(r["seq"] for r in got) > 5 and len(got) == len(texts)
    at = 0
    for r in sorted(got, key=lambda r: r["id"]):
        ids = library.encode(texts[r["id"]], add_special_tokens=False).ids + [2]
        assert r["start"] + r["local"] == at and np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
