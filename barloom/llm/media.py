"""Ogg media columns: multiplexing, page checks, demultiplexing and timestamps.

A text's UTF-8 bytes become 8-bit PCM samples at 8 kHz in one logical stream; a
second logical stream of the same physical stream carries the sample count and
the unpadded length. Reading verifies each page's checksum, reassembles packets
from lacing values (also across pages), separates the streams by serial number,
and turns granule positions into packet timestamps.

Defined cases: a null or empty text gives one block of 192 spaces; equal texts
give equal bytes, whatever their ids; repeated rows stay repeated; a page whose
checksum fails is skipped and counted, and the packet it cuts is dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_arrow

BLOCK = 192
RATE = 8000
PACKET = 20 * BLOCK
DATA_SERIAL, META_SERIAL = 0x0B10, 0x0B11
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_CONTINUED, _FIRST, _LAST = 1, 2, 4


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7, no reflection, zero start.

    It is the mirror image of zlib's reflected CRC over mirrored bytes, started
    from a zero register.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, seq: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing))
    raw = head + lacing + body
    return raw[:22] + struct.pack("<I", page_crc(raw)) + raw[26:]


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream from (packet, granule at its end) pairs.

    The first packet stands alone on the first page, as the format asks of
    header packets.
    """
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), [], -1, False

    def flush(last: bool, open_packet: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = continued * _CONTINUED | (not pages) * _FIRST | last * _LAST
        pages.append(_page(serial, len(pages), flags, granule, bytes(lacing), b"".join(body)))
        lacing, body, granule, continued = bytearray(), [], -1, open_packet

    for n, (packet, end) in enumerate(packets):
        at, left = 0, len(packet) // 255 + 1
        while left:
            if len(lacing) == 255:
                flush(False, at > 0)
            take = min(left, 255 - len(lacing))
            closes = take == left
            stop = len(packet) if closes else at + take * 255
            lacing += b"\xff" * (take - closes) + (bytes([len(packet) % 255]) if closes else b"")
            body.append(packet[at:stop])
            at, left = stop, left - take
        granule = end
        if n == 0 and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return pages


def pad(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of the block."""
    return data + b" " * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def encode(data: bytes) -> bytes:
    """The physical stream for a text's bytes."""
    payload = pad(data)
    samples = [(struct.pack("<4sBI", b"PCM8", 1, RATE), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    meta = [(b"META\x01", 0), (struct.pack("<QQ", len(data), len(payload)), len(payload))]
    first, second = paginate(DATA_SERIAL, samples), paginate(META_SERIAL, meta)
    return b"".join([first[0], second[0], *second[1:], *first[1:]])  # first pages come first


@dataclass
class Stream:
    """One logical stream: its packets and the end granule of those known."""

    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    pages: int = 0
    missing: int = 0
    closed: bool = False


def demux(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of pages that failed."""
    streams: dict[int, Stream] = {}
    partial: dict[int, list[bytes] | None] = {}
    seen: dict[int, int] = {}
    bad, at = 0, data.find(b"OggS")
    while 0 <= at and at + 27 <= len(data):
        _, version, flags, granule, serial, seq, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        stop = at + 27 + n + sum(lacing)
        page = data[at:stop]
        if version or stop > len(data) or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad, at = bad + 1, data.find(b"OggS", at + 4)
            continue
        s = streams.setdefault(serial, Stream())
        s.pages += 1
        s.closed = bool(flags & _LAST)
        if seq != seen.get(serial, -1) + 1:
            s.missing += seq - seen.get(serial, -1) - 1
            partial[serial] = None
        seen[serial] = seq
        parts = partial.get(serial) if flags & _CONTINUED else []
        pos, done = at + 27 + n, 0
        for lace in lacing:
            if parts is not None:
                parts.append(data[pos : pos + lace])
            pos += lace
            if lace < 255:
                if parts is not None:
                    s.packets.append(b"".join(parts))
                    s.ends.append(-1)
                    done += 1
                parts = []
        partial[serial] = parts if n and lacing[-1] == 255 else []
        if done:
            s.ends[-1] = granule
        at = data.find(b"OggS", stop)
    return streams, bad


def sample_times(stream: Stream) -> list[int]:
    """Start of each sample packet in microseconds, from granule positions.

    A page names the granule of its last finished packet; those before it on
    the page are reckoned back from there by their lengths.
    """
    starts, ends = [0] * len(stream.packets), list(stream.ends)
    for i in range(len(ends) - 1, 0, -1):
        if ends[i] < 0 and i + 1 < len(ends):
            ends[i] = ends[i + 1] - len(stream.packets[i + 1])
        starts[i] = (ends[i] - len(stream.packets[i])) * 1_000_000 // RATE
    return starts


def decode(media: bytes) -> tuple[bytes, int, str]:
    """Payload, unpadded length and feature text of a stored stream."""
    streams, bad = demux(media)
    data, meta = streams.get(DATA_SERIAL, Stream()), streams.get(META_SERIAL, Stream())
    payload = b"".join(data.packets[1:])
    n_bytes = struct.unpack("<QQ", meta.packets[1])[0] if len(meta.packets) > 1 else len(payload)
    samples = np.frombuffer(payload, np.uint8)
    last = sample_times(data)[-1] if data.packets else 0
    level = int(samples.sum(dtype=np.int64)) // max(1, len(samples))
    peak = int(samples.max()) if len(samples) else 0
    feature = (
        f"pages={sum(s.pages for s in streams.values())};bad={bad};streams={len(streams)};packets={len(data.packets) - 1};"
        f"last_start_us={last};duration_us={len(payload) * 1_000_000 // RATE};mean={level};peak={peak}"
    )
    return payload, n_bytes, feature


def _to_ogg(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            texts = part.column(1).cast(pa.binary())
            media = [encode(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for value in batch.column(1):
            media = value.as_py() or b""
            payload, n, feature = decode(media)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def to_ogg(docs: DataFrame) -> DataFrame:
    """doc_id and the Ogg bytes of each text."""
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _to_ogg, "doc_id long, media binary")


def probe_ogg(media: DataFrame) -> DataFrame:
    """Digests and features read back from a column of Ogg streams."""
    return in_arrow(
        media.select("doc_id", "media"),
        _probe,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
