"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

A text is cut by the tokenizer's pattern; each distinct piece is encoded once per worker. Pieces of similar length
form the rows of one padded matrix. Each round every row merges its leftmost pair of least rank: the pair's rank
comes from a hashed table of all mergeable pairs, the row is compacted by one cell, and rows without a mergeable
pair leave the matrix. The result equals that of the usual one-piece-at-a-time algorithm.

Defined results: a null text counts as the empty text (no ids, empty bytes); repeated rows and null or repeated ids
are encoded row by row; other columns are ignored whatever their names; an empty table gives an empty table; a
piece of any length is encoded whole; of pieces over LONG_PIECE bytes the next pair to merge comes from a heap, in the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ridgeline.llm.common import map_steps, pick
from ridgeline.llm.words import WordIds, gather, runs, words_of

#: Distinct pieces a worker remembers; beyond it, it forgets them all (results don't depend on it).
REMEMBERED = 100_000
#: Texts with one of these are matched as they stand: white space other than lone spaces and line ends, and the mark.
UNEVEN = [b"\0", b"  ", b" \n", b"\n ", b"\n\n", *(chr(c).encode() for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")]
NO_RANK = np.int32(2**31 - 1)
#: Bytes of a piece from which on its merges come from a heap: a row's rounds cost the square of its length.
LONG_PIECE = 256
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 3 + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots, todo = self.slots(keys), np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]  # the last writer of a slot keeps it
            kept = self.keys[at] == keys[todo]
            self.values[at[kept]] = merged[todo[kept]]
            todo = todo[~kept]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of the pairs, NO_RANK where a pair does not merge or a side is padding (-1)."""
        keys = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(keys.shape, NO_RANK, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self.slots(keys[todo])
        while len(todo):
            there = self.keys[slots]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            more = ~hit & (there != -1)
            todo, slots = todo[more], (slots[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """One vocabulary: tables for encoding and decoding, and the pieces encoded so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, space_begins: bool = False):
        """space_begins: the pattern never matches across the edge before a lone space or around a lone line end."""
        self.pattern, self.space_begins, self.ranks = regex.compile(pattern), space_begins, ranks
        self.byte_ids = np.full(256, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte_ids[token[0]] = rank
        triples = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(triples or np.zeros((0, 3)), np.int64).reshape(-1, 3).T)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.forget()

    def forget(self) -> None:
        self.pieces, self.chunks = Store(), WordIds(self.make_chunks)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        buckets = np.ceil(np.log2(np.maximum(lengths[order], 2))).astype(np.int64)
        flat, counts = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(buckets)) + 1):
            if len(rows) and lengths[rows[0]] > LONG_PIECE:  # in order of length
                for i in rows.tolist():
                    flat.append(self._merge_long(pieces[i]))
                    counts.append(np.array([len(flat[-1])], np.int64))
                continue
            at_once = max(1, (1 << 20) // max(1, int(lengths[rows].max(initial=1))))
            for k in range(0, len(rows), at_once):
                ids, n = self._merge_matrix([pieces[i] for i in rows[k : k + at_once]])
                flat.append(ids)
                counts.append(n)
        ids, n = np.concatenate(flat), np.concatenate(counts)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return gather(ids, (np.cumsum(n) - n)[back], n[back]), n[back]

    def _merge_matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(count.max(initial=0))
        ids = np.full((len(pieces), width + 1), -1, np.int32)  # one cell of padding at the right end
        ids[np.arange(width + 1) < count[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        result = np.full((len(pieces), max(width, 1)), -1, np.int32)
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rows, lengths = np.arange(len(pieces)), count.copy()
        while len(rows) and width:
            at = ranks.argmin(axis=1)  # the leftmost of the least
            line = np.arange(len(rows))
            best = ranks[line, at]
            keep = best != NO_RANK
            if not keep.all():
                result[rows[~keep], :width] = ids[~keep, :width]
                count[rows] = lengths
                rows, ids, ranks, lengths, at, best = rows[keep], ids[keep], ranks[keep], lengths[keep], at[keep], best[keep]
                if not len(rows):
                    break
                width = int(lengths.max())
                ids, ranks, line = ids[:, : width + 1], ranks[:, :width], np.arange(len(rows))
            source = np.arange(width + 1) + (np.arange(width + 1) > at[:, None])
            source[:, -1] = width
            ids[line, at] = best
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            lengths = lengths - 1
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], width - 1), axis=1)
            ranks[:, -1] = NO_RANK
            ranks[line, at] = self.pairs.find(ids[line, at], ids[line, at + 1])
            left = np.flatnonzero(at)
            ranks[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], ids[left, at[left]])
        return result[np.arange(result.shape[1]) < count[:, None]].astype(np.uint32), count

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same merges in the same order, the next one from a heap instead of a search through the whole row."""
        after, before, alive = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1)), bytearray(b"\1") * len(piece)
        rank_of, n = self.ranks.get, len(piece)
        current = [rank_of(piece[i : i + 2], NO_RANK) for i in range(n - 1)] + [NO_RANK]
        heap = [(r, i) for i, r in enumerate(current) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or current[i] != rank:
                continue
            j = after[i]
            after[i], alive[j] = after[j], 0
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    end = after[after[k]] if after[k] < n else -1
                    new = rank_of(piece[k:end], NO_RANK) if end >= 0 else NO_RANK
                    current[k] = new
                    if new != NO_RANK:
                        heapq.heappush(heap, (new, k))
        starts = [i for i in range(n) if alive[i]]
        return np.array([self.ranks[piece[i : after[i]]] for i in starts], np.uint32)

    def find_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has; pieces not seen before are merged."""
        return self.pieces.find(pieces, lambda new: self.merge([x.encode() for x in new]))

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As find_pieces(), for texts that the pattern cuts to pieces."""
        cut = [self.pattern.findall(t) for t in texts]
        ids, n = self.find_pieces(list(chain.from_iterable(cut)))
        return ids, runs(n, np.fromiter(map(len, cut), np.int64, len(cut)))

    def make_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.cut([c.decode() for c in chunks])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        even = np.array([self.space_begins and t[-1:] != b" " and not any(x in t for x in UNEVEN) for t in texts], bool)
        parts = [self.encode_even([t for t, ok in zip(texts, even, strict=True) if ok]), self.cut([t.decode() for t, ok in zip(texts, even, strict=True) if not ok])]
        counts, starts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for rows, base, n in ((even, 0, parts[0][1]), (~even, len(parts[0][0]), parts[1][1])):
            counts[rows], starts[rows] = n, base + np.cumsum(n) - n
        return gather(np.concatenate([parts[0][0], parts[1][0]]), starts, counts), counts

    def encode_even(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), for texts whose white space is lone spaces and line ends: by word with its leading space."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        line = data == 10
        starts, ends = words_of(line | (data == 32))
        spaced = (starts > 0) & (data[starts - 1] == 32)
        ids, n = self.chunks.encode(raw, starts - spaced, ends)
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        line[stops - 1] = False  # these only part the texts
        breaks = np.flatnonzero(line)
        at = np.concatenate([starts, breaks])
        order = np.argsort(at, kind="stable")
        item_n = np.concatenate([n, np.ones(len(breaks), np.int64)])[order]
        item_start = np.concatenate([np.cumsum(n) - n, np.full(len(breaks), len(ids))])[order]
        per_text = np.diff(np.searchsorted(at[order], np.concatenate([[0], stops])))
        return gather(np.concatenate([ids, self.byte_ids[10:11].astype(np.uint32)]), item_start, item_n), runs(item_n, per_text)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each text."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        flat = gather(self.flat, self.starts[ids], lengths).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Store:
    """Strings met so far and their runs of ids."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.known = most, {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def find(self, keys: list[str], make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys one after another, and how many each has; ``make`` gives those of new keys."""
        at = list(map(self.known.get, keys))
        if None in at:
            new = list({k for k, i in zip(keys, at, strict=True) if i is None})
            if self.known and len(self.known) + len(new) > self.most:
                self.__init__(self.most)
                return self.find(keys, make)
            self.add(new, *make(new))
            for i in [i for i, x in enumerate(at) if x is None]:
                at[i] = self.known[keys[i]]
        at = np.array(at, np.int64)
        return gather(self.ids, self.starts[at], self.lengths[at]), self.lengths[at]

    def add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        have = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while have + len(keys) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[have : have + len(keys)] = self.used + np.cumsum(counts) - counts
        self.lengths[have : have + len(keys)] = counts
        self.used += len(ids)
        self.known.update(zip(keys, range(have, have + len(keys)), strict=True))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str, space_begins: bool = False) -> Bpe:
    """The vocabulary, loaded once per worker."""
    return Bpe(read_ranks(path), pattern, space_begins)


def pieces_of(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The packed bytes of each run of ``values``."""
    data, ends = values.tobytes(), np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode_bpe(df: DataFrame, ranks_path: str, pattern: str, space_begins: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): ids packed as little-endian unsigned 32-bit integers.

    A map over the rows: no shuffle, memory bounded by REMEMBERED pieces and one step of texts. ``space_begins``
    says that the pattern starts a new match at each lone space and on both sides of each lone line end (as patterns
    that attach one leading space to words do); whole words are then remembered instead of matching them again.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        ids, counts = vocabulary(ranks_path, pattern, space_begins).encode(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(pieces_of(ids.astype("<u4"), counts), pa.binary())], names=["id", "n_tokens", "ids"])

    source = pick(df, id=id_col, text=text_col)
    return map_steps(source, "text", step, f"id {source.schema['id'].dataType.simpleString()}, n_tokens bigint, ids binary").withColumnRenamed("id", id_col)


def decode_bpe(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to the rows of encode_bpe()."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [x or b"" for x in batch.column("ids").to_pylist()]
        ids = np.frombuffer(b"".join(packed), "<u4")
        counts = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
        decoded = vocabulary(ranks_path, pattern).decode(ids, counts)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_steps(df, "ids", step, f"{kinds}, decoded binary")
