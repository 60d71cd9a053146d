"""Token-id output in canonical, length-limited Huffman code.

Writing: ids are counted over all documents; package-merge gives optimal code lengths up to ``max_bits``; canonical
codes follow from the lengths alone. Each document's ids are coded in blocks of ``block`` ids that start at recorded
bit offsets. Documents are sorted by id and packed into files; a file holds the code lengths, the documents' table
and the blocks' bit offsets, so it can be read alone and at any block.

Reading: a table of 2**max_bits entries maps the next bits to an id and its length; all blocks of a file are decoded
side by side, one id of each block a step.

Files are rows of a table in the shared folder (part, seq, bytes): only Spark's own writers reach every store.

Defined results: a null text counts as empty (its ids are the end id alone); null ids sort first; rows with the same
id sort by their ids' bytes, so equal rows are interchangeable; other columns are ignored; no documents, no files.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.bpe import pieces_of
from ridgeline.llm.common import discard, map_steps, materialize, pick, step_batches
from ridgeline.llm.words import WordIds, runs, words_of

MAX_BITS, BLOCK, FILE_BYTES, PART_BYTES = 18, 1024, 8 << 20, 128 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HEADER = struct.Struct("<8sHIIQQQI")
MAGIC = b"HUFIDS\0\1"


# -- the code -------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    leaves = used[np.argsort(counts[used], kind="stable")]
    weights = counts[leaves].astype(np.float64)
    merged, leaf_flags = weights, [np.ones(len(weights), bool)]
    for _ in range(max_bits - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        leaf_flags.append(order < len(weights))
    take, ranked = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for flags in reversed(leaf_flags):
        n = int(flags[:take].sum())  # the lightest n leaves
        ranked[:n] += 1
        take = 2 * (take - n)
    lengths[leaves] = ranked
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    per_length = np.bincount(lengths[order], minlength=1)
    at = 0
    for bits in range(1, len(per_length)):
        code <<= bits - last
        last, n = bits, int(per_length[bits])
        codes[order[at : at + n]] = np.arange(code, code + n, dtype=np.uint64)
        code, at = code + n, at + n
    return codes


@lru_cache(maxsize=4)
def code_tables(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Lengths, codes and the decoding table (id << 8 | length) of packed lengths."""
    lengths = np.frombuffer(zlib.decompress(packed), np.uint8)
    codes, bits = canonical_codes(lengths), int(lengths.max(initial=1))
    table = np.zeros(1 << bits, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    filled = np.repeat((order.astype(np.int64) << 8) | lengths[order], spans)
    table[: len(filled)] = filled
    return lengths, codes, table, bits


def encode_documents(ids: np.ndarray, counts: np.ndarray, packed: bytes, block: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Coded bytes of each document, each from a byte edge, and the bit offsets of its blocks."""
    lengths, codes, _, _ = code_tables(packed)
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    doc_ends = np.cumsum(counts)
    bits = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], doc_ends])])
    sizes = -(-bits // 8)
    doc_bytes = np.concatenate([[0], np.cumsum(sizes)])
    start_bits = np.concatenate([[0], ends])[np.concatenate([[0], doc_ends[:-1]])] if len(counts) else np.zeros(0, np.int64)
    offset = ends - n + np.repeat(doc_bytes[:-1] * 8 - start_bits, counts)  # of each id in the output
    words = np.zeros(int(doc_bytes[-1]) // 4 + 3, np.uint64)
    if len(ids):
        word = offset >> 5
        value = codes[ids] << (64 - n - (offset & 31)).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], np.diff(word) > 0]))
        sums, at = np.add.reduceat(value, first), word[first]  # bits don't overlap, so a sum is an or
        words[at] += sums >> np.uint64(32)
        words[at + 1] += sums & np.uint64(0xFFFFFFFF)
    data = words.astype(">u4").tobytes()
    inside = np.arange(len(ids)) - np.repeat(doc_ends - counts, counts)
    marks = np.flatnonzero(inside % block == 0)
    relative = offset[marks] - np.repeat(doc_bytes[:-1] * 8, counts)[marks]
    cuts = np.cumsum(-(-counts // block))[:-1]
    return [data[a:b] for a, b in zip(doc_bytes[:-1].tolist(), doc_bytes[1:].tolist(), strict=True)], np.split(relative, cuts) if len(counts) else []


def decode_blocks(data: bytes, starts: np.ndarray, counts: np.ndarray, packed: bytes) -> np.ndarray:
    """Ids of all blocks one after another. starts: bit offsets; counts: ids in each block."""
    _, _, table, bits = code_tables(packed)
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].copy(), counts[order]
    base = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), np.uint32)
    active = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), side="right")  # blocks with over i ids
    mask = np.int64((1 << bits) - 1)
    for i, m in enumerate(active.tolist()):
        here = at[:m]
        byte = here >> 3
        window = np.zeros(m, np.int64)
        for k in range(4):
            window = (window << 8) | raw[byte + k]
        found = table[(window >> (32 - bits - (here & 7))) & mask]
        out[base[:m] + i] = found >> 8
        at[:m] += found & 255
    return out


# -- files ----------------------------------------------------------------------------------------------------------


def pack_file(ids: pa.Array, counts: np.ndarray, data: list[bytes], marks: list[np.ndarray], packed: bytes, block: int) -> bytes:
    """One file: header, code lengths, ids of the documents, their counts and sizes, bit offsets, coded bytes."""
    keys = pa.RecordBatch.from_arrays([ids], names=["id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, keys.schema) as writer:
        writer.write_batch(keys)
    keyed = sink.getvalue().to_pybytes()
    sizes = np.fromiter(map(len, data), "<u8", len(data)).tobytes()
    checkpoints = np.concatenate(marks).astype("<u8").tobytes() if marks else b""
    body = b"".join([packed, keyed, counts.astype("<u8").tobytes(), sizes, checkpoints, *data])
    return HEADER.pack(MAGIC, block, len(packed), len(keyed), len(counts), len(checkpoints) // 8, int(counts.sum()), zlib.crc32(body)) + body


def unpack_file(file: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, counts, and all ids of a file."""
    magic, block, n_code, n_keys, n_docs, n_marks, n_ids, crc = HEADER.unpack_from(file)
    body = memoryview(file)[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a file of coded ids, or a damaged one")
    at = 0

    def part(n: int) -> memoryview:
        nonlocal at
        at += n
        return body[at - n : at]

    packed, keyed = bytes(part(n_code)), bytes(part(n_keys))
    counts, sizes = (np.frombuffer(part(8 * n_docs), "<u8").astype(np.int64) for _ in range(2))
    marks = np.frombuffer(part(8 * n_marks), "<u8").astype(np.int64)
    with pa.ipc.open_stream(keyed) as reader:
        keys = reader.read_all().column("id").combine_chunks()
    blocks = -(-counts // block)
    of = np.repeat(np.arange(n_docs), blocks)
    nth = np.arange(n_marks) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = (np.cumsum(sizes) - sizes)[of] * 8 + marks
    ids = decode_blocks(bytes(body[at:]), starts, np.minimum(block, counts[of] - nth * block), packed)
    if len(ids) != n_ids:
        raise ValueError("the number of ids differs from the header's")
    return keys, counts, ids


# -- tokenizing -----------------------------------------------------------------------------------------------------


class Words:
    """The library's tokenizer on words between spaces and line ends, each encoded once.

    White space parts words for this kind of tokenizer (it is dropped and no rule looks across it) and letters are put in
    lower case, so ids of a text are those of its words in lower case. Where a text could hold one of the library's own
    marks, words keep their case for it to tell.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.store = Tokenizer.from_file(path), WordIds(self.make)

    def make(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        groups = [[w.decode() for w in words[i : i + 500]] for i in range(0, len(words), 500)]
        ids, counts = [], []
        for group, coded in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            starts = np.cumsum([0, *(len(w) + 1 for w in group)])
            at = np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.offsets))
            ids.append(np.array(coded.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another with the end id after each, and how many each has."""
        raw = b"\n".join(texts) + b"\n"
        if b"<|" not in raw:
            raw = raw.translate(LOWER)
        data = np.frombuffer(raw, np.uint8)
        starts, ends = words_of((data == 32) | (data == 10))
        ids, n = self.store.encode(raw, starts, ends)
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        counts = runs(n, np.diff(np.searchsorted(starts, np.concatenate([[0], stops]))))
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary of little-endian unsigned 32-bit integers), the end id last."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = words(tokenizer_path).encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], end_id)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(pieces_of(ids.astype("<u4"), counts), pa.binary())], names=["id", "n_tokens", "ids"])

    source = pick(df, id=id_col, text=text_col)
    return map_steps(source, "text", step, _tokens(source))


def _tokens(source: DataFrame) -> str:
    return f"id {source.schema['id'].dataType.simpleString()}, n_tokens bigint, ids binary"


def with_counts(tokens: DataFrame, n_ids: int) -> DataFrame:
    """``tokens`` (id, n_tokens, ids), and a row more of each task: n_tokens -1, ids how often each id occurs in the task's rows (64-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, schema = np.zeros(n_ids, np.int64), None
        for batch in batches:
            schema = batch.schema
            total += np.bincount(np.frombuffer(b"".join(x or b"" for x in batch.column("ids").to_pylist()), "<u4"), minlength=n_ids)
            yield batch
        if schema is not None:
            last = [pa.nulls(1, schema.field(0).type), pa.array([-1], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(last, names=["id", "n_tokens", "ids"])

    return tokens.mapInArrow(run, _tokens(tokens))


def summed_counts(tasks: DataFrame, n_ids: int) -> np.ndarray:
    """The sum of the tasks' counts (ids). The driver gets one number for each id of the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                total += np.frombuffer(x, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["token", "n"])

    return _by_token(tasks.select("ids").mapInArrow(add, "token int, n bigint"), n_ids)


# -- the operator ---------------------------------------------------------------------------------------------------


def id_counts(ids: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs in all documents. The driver gets one number for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in step_batches(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(x or b"" for x in batch.column("ids").to_pylist()), "<u4"), minlength=n_ids)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["token", "n"])

    return _by_token(ids.select("ids").mapInArrow(count, "token int, n bigint"), n_ids)


def _by_token(counted: DataFrame, n_ids: int) -> np.ndarray:
    found = counted.groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_ids, np.int64)
    out[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def write_ids(ids: DataFrame, n_ids: int, max_bits: int = MAX_BITS, block: int = BLOCK, file_bytes: int = FILE_BYTES, counts: np.ndarray | None = None) -> DataFrame:
    """Files of (id, n_tokens, ids) in ascending order of id: rows (part, seq, n_docs, n_tokens, bytes).

    Ids are coded before the shuffle, so it moves coded bytes only. Without ``counts`` (of each id) ``ids`` is read once more to count.
    """
    counts = id_counts(ids, n_ids) if counts is None else counts
    lengths = code_lengths(counts, max_bits)
    packed, coded_bytes = zlib.compress(lengths.tobytes(), 9), int(counts @ lengths) // 8
    kind = ids.schema["id"].dataType.simpleString()

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
        data, marks = encode_documents(np.frombuffer(b"".join(x or b"" for x in batch.column("ids").to_pylist()), "<u4"), counts, packed, block)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_tokens"), pa.array([m.astype("<u8").tobytes() for m in marks], pa.binary()), pa.array(data, pa.binary())], names=["id", "n_tokens", "marks", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            counts = rows.column("n_tokens").to_numpy().astype(np.int64)
            marks = [np.frombuffer(m, "<u8") for m in rows.column("marks").to_pylist()]
            whole = pack_file(rows.column("id").combine_chunks(), counts, rows.column("data").to_pylist(), marks, packed, block)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (len(counts), pa.int64()), (int(counts.sum()), pa.int64()), (whole, pa.binary()))], names=["part", "seq", "n_docs", "n_tokens", "bytes"])

        for batch in step_batches(batches, "data"):
            held.append(batch)
            size += batch.nbytes
            if size >= file_bytes:
                yield file()
                seq, held, size = seq + 1, [], 0
        if held:
            yield file()

    coded = map_steps(ids, "ids", code, f"id {kind}, n_tokens bigint, marks binary, data binary")
    # a part for each shuffle partition, or more so that each sorts PART_BYTES at most, about
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), coded_bytes // PART_BYTES)
    ordered = coded.repartitionByRange(parts, "id", F.xxhash64("data")).sortWithinPartitions("id", F.xxhash64("data"), "data")
    return materialize(ordered.mapInArrow(pack, "part int, seq int, n_docs bigint, n_tokens bigint, bytes binary"), "id-files")


def read_ids(files: DataFrame, kind: str) -> DataFrame:
    """(id, part, seq, local long, n_tokens long, ids binary): every document of the files; local: ids before it in its file."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, ids = unpack_file(batch.column("bytes")[i].as_py())
                n = len(counts)
                columns = [keys, pa.array(np.full(n, batch.column("part")[i].as_py()), pa.int32()), pa.array(np.full(n, batch.column("seq")[i].as_py()), pa.int32()), pa.array(np.cumsum(counts) - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(pieces_of(ids.astype("<u4"), counts), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "seq", "local", "n_tokens", "ids"])

    return files.select("part", "seq", "bytes").mapInArrow(step, f"id {kind}, part int, seq int, local bigint, n_tokens bigint, ids binary")


def file_starts(files: DataFrame) -> DataFrame:
    """(part, seq, start): ids in all files before. The parts' sums (one row a part) are added up first, then each part's files."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("own"))
    return materialize(own.join(F.broadcast(base), "part").select("part", "seq", (F.col("base") + F.col("own")).alias("start")), "id-starts")


def store_tokens(df: DataFrame, tokenizer_path: str, n_ids: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize all texts and write their ids; the files of write_ids()."""
    ids = materialize(with_counts(tokenize(df, tokenizer_path, end_id, id_col, text_col), n_ids), "token-ids")
    files = write_ids(ids.where("n_tokens >= 0"), n_ids, counts=summed_counts(ids.where("n_tokens < 0"), n_ids))
    discard(ids)
    return files
