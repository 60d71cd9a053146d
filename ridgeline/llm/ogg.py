"""Ogg media columns: mux packets into pages, and demultiplex, check and time them again.

Writing: a payload is cut into packets of ``packet`` 8-bit samples that are dealt in turn to the logical streams.
Each stream has a serial number, a first page (BOS) with a header packet, pages of up to 255 lacing values, granule
positions that count the payload's samples, and a last page (EOS). Every page carries its CRC.

Reading: pages are found by their capture pattern, their checksum is verified, packets are put together from lacing
values (across pages too), logical streams are told apart by serial number and times follow from granule positions.
A damaged page is counted and skipped up to the next capture pattern; packets that lost a part are dropped and the
loss is counted. Nothing is guessed.

Defined results: a null text or null bytes are the empty payload before padding; an empty text still makes one packet
of padding; repeated rows and null or repeated ids are handled row by row; other columns are ignored; an empty table
gives an empty table; media that is no Ogg at all has no streams and counts its bytes as skipped.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.common import map_steps, pick

CAPTURE, HEAD = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, BOS, EOS = 1, 2, 4
#: Samples (bytes) of a packet, samples a second, logical streams, and the first header packet's layout.
PACKET, RATE, STREAMS = 576, 8000, 2
STREAM_HEAD = struct.Struct("<8sBBIIQ")
MAGIC = b"RAW8\0\0\0\1"
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 of a page as Ogg defines it: polynomial 0x04C11DB7, bits not mirrored, initial value and xor 0.

    zlib's CRC is the mirrored one, so it runs over mirrored bytes and its result is mirrored.
    """
    mirrored = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRROR), "big")


def pages(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """Pages of one logical stream; the first packet has a page of its own. granules: at the end of each packet."""
    lacing: list[int] = []
    ends: list[tuple[int, int]] = []  # lacing values up to a packet's end, its granule position
    for packet, granule in zip(packets, granules, strict=True):
        lacing += [255] * (len(packet) // 255) + [len(packet) % 255]
        ends.append((len(lacing), granule))
    body, out, at, byte, k = b"".join(packets), [], 0, 0, 0
    while at < len(lacing):
        stop = ends[0][0] if at == 0 else min(at + 255, len(lacing))
        continued = at > 0 and lacing[at - 1] == 255
        granule = -1  # no packet ends on this page
        while k < len(ends) and ends[k][0] <= stop:
            granule, k = ends[k][1], k + 1
        size = sum(lacing[at:stop])
        kind = CONTINUED * continued | BOS * (at == 0) | EOS * (stop == len(lacing))
        lead = HEAD.pack(CAPTURE, 0, kind, granule, serial, len(out), 0, stop - at) + bytes(lacing[at:stop])
        page = lead + body[byte : byte + size]
        out.append(page[:22] + page_crc(page).to_bytes(4, "little") + page[26:])
        at, byte = stop, byte + size
    return out


def write_ogg(payload: bytes, n_bytes: int, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """The physical stream: all first pages, then the streams' other pages in order of time."""
    cut = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    base = zlib.crc32(payload)
    numbered = []
    for s in range(streams):
        own = cut[s::streams]
        ends = [min((s + i * streams + 1) * packet, len(payload)) for i in range(len(own))]
        head = STREAM_HEAD.pack(MAGIC, s, streams, packet, rate, n_bytes)
        numbered.append(pages([head, *own], [0, *ends], (base + s) & 0xFFFFFFFF))
    rest = [(int.from_bytes(page[6:14], "little", signed=True), s, i, page) for s, own in enumerate(numbered) for i, page in enumerate(own) if i]
    # a page on which no packet ends goes with the next one of its stream
    later: dict[int, int] = {}
    for j in range(len(rest) - 1, -1, -1):
        granule, s, i, page = rest[j]
        later[s] = granule = granule if granule >= 0 else later.get(s, len(payload))
        rest[j] = (granule, s, i, page)
    return b"".join([own[0] for own in numbered] + [page for *_, page in sorted(rest, key=lambda x: x[:3])])


@dataclass
class Stream:
    """One logical stream as read."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page a packet ends on
    pages: int = 0
    lost_pages: int = 0
    lost_packets: int = 0
    ended: bool = False
    next_page: int = 0
    part: list[bytes] | None = None


def read_ogg(media: bytes) -> tuple[list[Stream], int, int]:
    """Logical streams in order of appearance, pages with a wrong checksum, bytes skipped between pages."""
    streams: dict[int, Stream] = {}
    at = damaged = skipped = 0
    while at < len(media):
        found = media.find(CAPTURE, at)
        if found < 0:
            return list(streams.values()), damaged, skipped + len(media) - at
        skipped, at = skipped + found - at, found
        if at + HEAD.size > len(media):
            return list(streams.values()), damaged, skipped + len(media) - at
        _, version, kind, granule, serial, number, crc, segments = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + segments]
        end = at + HEAD.size + segments + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < segments or end > len(media) or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            damaged, skipped, at = damaged + 1, skipped + 1, at + 1  # look for the next capture pattern
            continue
        stream = streams.setdefault(serial, Stream(serial))
        if number > stream.next_page:
            stream.lost_pages += number - stream.next_page
            stream.lost_packets += stream.part is not None
            stream.part = None
        stream.next_page, stream.pages, stream.ended = number + 1, stream.pages + 1, stream.ended or bool(kind & EOS)
        part = stream.part if kind & CONTINUED else None
        broken = bool(kind & CONTINUED) and part is None  # its beginning was lost
        if stream.part is not None and not kind & CONTINUED:
            stream.lost_packets += 1
        byte, part = HEAD.size + segments, part or []
        for value in lacing:
            part.append(page[byte : byte + value])
            byte += value
            if value < 255:
                if broken:
                    stream.lost_packets += 1
                else:
                    stream.packets.append(b"".join(part))
                    stream.granules.append(granule)
                part, broken = [], False
        stream.part = part if lacing and lacing[-1] == 255 and not broken else None
        at = end
    return list(streams.values()), damaged, skipped


def payload_of(streams: list[Stream]) -> tuple[bytes, int, int, int]:
    """Payload, unpadded length, rate and packet size from the streams written by write_ogg()."""
    heads = {STREAM_HEAD.unpack(s.packets[0])[1]: s for s in streams if s.packets and s.packets[0][:8] == MAGIC and len(s.packets[0]) == STREAM_HEAD.size}
    if not heads:
        return b"", 0, 0, 0
    _, _, count, packet, rate, n_bytes = STREAM_HEAD.unpack(heads[min(heads)].packets[0])
    own = [heads[i].packets[1:] if i in heads else [] for i in range(count)]
    return b"".join(own[k % count][k // count] for k in range(sum(map(len, own))) if k // count < len(own[k % count])), n_bytes, rate, packet


def packet_times(stream: Stream, rate: int, packet: int, step: int) -> list[float]:
    """Second at which each packet after the header ends: the page's granule belongs to the last packet ending on it."""
    times, k = [], 1
    while k < len(stream.packets):
        last = k
        while last + 1 < len(stream.packets) and stream.granules[last + 1] == stream.granules[k]:
            last += 1
        times += [(stream.granules[k] - (last - i) * step * packet) / rate for i in range(k, last + 1)]
        k = last + 1
    return times


def describe(streams: list[Stream], damaged: int, skipped: int) -> str:
    """Features of a medium read back, as one line."""
    payload, _, rate, packet = payload_of(streams)
    samples = np.frombuffer(payload, np.uint8)
    times = [t for s in streams for t in packet_times(s, rate or 1, packet, max(1, len(streams)))]
    counts = np.bincount(samples >> 5, minlength=8)
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams)};packets={sum(len(s.packets) for s in streams)};samples={len(samples)}"
        f";first_s={min(times, default=0):.3f};last_s={max(times, default=0):.3f};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max(initial=0))}"
        f";bands={','.join(map(str, counts.tolist()))};lost={sum(s.lost_packets for s in streams)};damaged={damaged};skipped={skipped}"
    )


def encode_ogg(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", packet: int = PACKET, streams: int = STREAMS, rate: int = RATE) -> DataFrame:
    """(id, n_bytes long, media binary): each text as UTF-8, padded with bytes 255 to a positive multiple of a packet."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        media = [write_ogg(x + b"\xff" * (max(1, -(-len(x) // packet)) * packet - len(x)), len(x), packet, streams, rate) for x in raw]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    source = pick(df, id=id_col, text=text_col)
    return map_steps(source, "text", step, f"id {source.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def decode_ogg(df: DataFrame) -> DataFrame:
    """Adds ``payload`` (binary, as read back) and ``feature`` (string) to rows with ``media``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [read_ogg(x or b"") for x in batch.column("media").to_pylist()]
        payloads = [payload_of(streams)[0] for streams, *_ in read]
        features = [describe(*x) for x in read]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=[*batch.schema.names, "payload", "feature"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_steps(df, "media", step, f"{kinds}, payload binary, feature string")
