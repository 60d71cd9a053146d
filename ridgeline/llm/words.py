"""A worker's memory of words and their ids, in arrays: no Python object for a word that was met before.

Words are runs of bytes between spaces and line ends. A hash of a word's 8-byte lanes, each mixed in its turn, says where
in an open-addressing table to look; what is found there counts only if all its lanes are the word's own, so two words are
never taken for one another. Words not met before are encoded once by the caller's function. The memory holds ``most``
words of up to LONGEST bytes and is emptied when it is full; longer words are encoded once a step. Neither changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

U64 = np.uint64
SPREAD = U64(0x9E3779B97F4A7C15)
#: Words a worker remembers (about 90 bytes each with the table's free room), and the bytes of the longest.
REMEMBERED, LONGEST = 1_000_000, 64
#: Longer words than this are hashed one by one.
LANED = 4096
#: The first n bytes of a lane.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes every output bit with even odds."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=U64) * SPREAD + U64(seed)) | U64(1)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length] one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)]


def runs(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``n`` over runs of ``counts`` elements."""
    return np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])])


def words_of(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes outside ``gap``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number (zeros follow the end)."""
    return np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))


def lane(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Lane k of each word, all of which are longer than 8 * k bytes (or empty)."""
    return view[starts + 8 * k] & MASKS[np.minimum(lengths - 8 * k, 8)]


def word_hash(data: bytes, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its length, then one lane after another, mixed each time."""
    out = mixed(lengths.astype(U64) * SPREAD)
    todo = np.arange(len(starts))
    if (lengths > LANED).any():
        for i in np.flatnonzero(lengths > LANED).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + lengths[i]], digest_size=8).digest(), "little")
        todo = np.flatnonzero(lengths <= LANED)
    k = 0
    while len(todo):
        out[todo] = mixed(out[todo] ^ lane(view, starts[todo], lengths[todo], k))
        k += 1
        todo = todo[lengths[todo] > 8 * k]
    return out


class WordIds:
    """Runs of ids by word."""

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = REMEMBERED):
        """make: ids of new words one after another, and how many each has."""
        self.make, self.most = make, most
        self.forget()

    def forget(self) -> None:
        self.bits, self.n = 12, 0
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.hashes, self.sizes = np.zeros(1 << 11, U64), np.zeros(1 << 11, np.int64)
        self.at, self.lanes, self.n_lanes = np.zeros(1 << 11, np.int64), np.zeros(1 << 12, U64), 0
        self.starts, self.lengths = np.zeros(1 << 11, np.int64), np.zeros(1 << 11, np.int32)
        self.ids, self.used = np.zeros(1 << 13, np.uint32), 0

    def same(self, there: np.ndarray, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the words numbered ``there`` are the given ones, byte by byte."""
        out = self.sizes[there] == lengths
        todo, k = np.flatnonzero(out), 0
        while len(todo):
            differ = self.lanes[self.at[there[todo]] + k] != lane(view, starts[todo], lengths[todo], k)
            out[todo[differ]] = False
            k += 1
            todo = todo[~differ & (lengths[todo] > 8 * k)]
        return out

    def find(self, hashes: np.ndarray, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Index of each word, -1 for new ones."""
        out = np.full(len(hashes), -1, np.int64)
        todo, slots = np.arange(len(hashes)), (hashes >> U64(64 - self.bits)).astype(np.int64)
        while len(todo):
            there = self.table[slots]
            some = there >= 0
            todo, slots, there = todo[some], slots[some], there[some]
            hit = self.hashes[there] == hashes[todo]
            hit[hit] = self.same(there[hit], view, starts[todo[hit]], lengths[todo[hit]])
            out[todo[hit]] = there[hit]
            todo, slots = todo[~hit], (slots[~hit] + 1) & ((1 << self.bits) - 1)
        return out

    def _place(self, at: np.ndarray) -> None:
        """Put the words numbered ``at`` into the table."""
        todo, slots = at, (self.hashes[at] >> U64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.table[slots] < 0
            self.table[slots[free]] = todo[free]  # the last writer of a slot keeps it
            lost = self.table[slots] != todo
            todo, slots = todo[lost], (slots[lost] + 1) & ((1 << self.bits) - 1)

    def _add(self, hashes: np.ndarray, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Remember new words, no two of them alike."""
        n, per_word = self.n + len(hashes), -(-lengths // 8)
        while n > len(self.hashes):
            grown = (self.hashes, self.sizes, self.at, self.starts, self.lengths)
            self.hashes, self.sizes, self.at, self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in grown)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_lanes + int(per_word.sum()) > len(self.lanes):
            self.lanes = np.concatenate([self.lanes, np.zeros_like(self.lanes)])
        new = np.arange(self.n, n)
        self.hashes[new], self.sizes[new] = hashes, lengths
        self.at[new] = self.n_lanes + np.cumsum(per_word) - per_word
        todo, k = np.arange(len(hashes)), 0
        while len(todo):
            self.lanes[self.at[new[todo]] + k] = lane(view, starts[todo], lengths[todo], k)
            k += 1
            todo = todo[lengths[todo] > 8 * k]
        self.starts[new], self.lengths[new] = self.used + np.cumsum(counts) - counts, counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used, self.n_lanes = n, self.used + len(ids), self.n_lanes + int(per_word.sum())
        if 2 * n > 1 << self.bits:
            self.bits = (2 * n).bit_length()
            self.table = np.full(1 << self.bits, -1, np.int32)
            new = np.arange(n)
        self._place(new)

    def _known(self, data: bytes, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Index of each word; new ones are made and remembered."""
        hashes = word_hash(data, view, starts, lengths)
        at, fresh = self.find(hashes, view, starts, lengths), False
        while len(new := np.flatnonzero(at < 0)):
            one = new[np.unique(hashes[new], return_index=True)[1]]  # words that share a hash take turns
            if not fresh and self.n and self.n + len(one) > self.most:
                self.forget()
                at, fresh = np.full(len(hashes), -1, np.int64), True
                continue
            ids, counts = self.make([data[a : a + b] for a, b in zip(starts[one].tolist(), lengths[one].tolist(), strict=True)])
            self._add(hashes[one], view, starts[one], lengths[one], ids, counts)
            at[new] = self.find(hashes[new], view, starts[new], lengths[new])
        return at

    def encode(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words data[start : end] one after another, and how many each has."""
        view, sizes = eights(data), ends - starts
        long = np.flatnonzero(sizes > LONGEST)
        if not len(long):
            at = self._known(data, view, starts, sizes)
            return gather(self.ids, self.starts[at], self.lengths[at]), self.lengths[at].astype(np.int64)
        short = np.flatnonzero(sizes <= LONGEST)
        at = self._known(data, view, starts[short], sizes[short])
        first, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        first[short], n[short] = self.starts[at], self.lengths[at]
        words = [data[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        nth = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, counts = self.make(list(nth))
        of = np.fromiter((nth[w] for w in words), np.int64, len(words))
        first[long], n[long] = self.used + (np.cumsum(counts) - counts)[of], counts[of]
        return gather(np.concatenate([self.ids[: self.used], ids]), first, n), n
