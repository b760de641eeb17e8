"""Media columns: Ogg containers in binary cells.

The muxer stores 8-bit unsigned mono PCM in one logical stream and a text note in a
second one, pages interleaved. The demuxer verifies each page's checksum and sequence
number, reassembles packets from lacing values (also over pages), tells logical streams
apart by serial number, and derives timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veldt.llm._store import small_batches

RATE = 8000
UNIT = 64
PACKET = 4080
PAGE_PACKETS = 12
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def ogg_crc(data: bytes) -> int:
    """Ogg's page checksum (polynomial 0x04c11db7, most significant bit first, no inversion), by way of zlib's reflected one."""
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reflected:032b}"[::-1], 2)


@dataclass
class Stream:
    """What a logical stream gathers while it is read."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: (granule position, packets complete so far) of each page that ends a packet
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    partial: bytes | None = None
    ended: bool = False

    def times(self, rate: int) -> list[float]:
        """End time in seconds of each marked packet."""
        return [g / rate for g, _ in self.marks if g >= 0]


class Muxer:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> bytes:
        head = struct.pack("<4sBBqII", b"OggS", 0, flags, granule, self.serial, self.sequence)
        self.sequence += 1
        rest = bytes([len(lacing)]) + lacing + body
        return head + struct.pack("<I", ogg_crc(head + b"\0\0\0\0" + rest)) + rest

    def pages(self, packets: list[bytes], granules: list[int], first: bool, last: bool) -> list[bytes]:
        """Packets laid out in as few pages as hold them; a packet may go on over pages."""
        lacing, body, out = bytearray(), bytearray(), []
        granule = -1

        def flush(more: bool, end: bool):
            nonlocal lacing, body, granule, continued
            flags = CONTINUED * continued | FIRST * (first and not out) | LAST * end
            out.append(self.page(bytes(lacing), bytes(body), granule, flags))
            lacing, body, granule, continued = bytearray(), bytearray(), -1, more

        continued = False
        for packet, g in zip(packets, granules):
            values = [255] * (len(packet) // 255) + [len(packet) % 255]
            at = 0
            for k, v in enumerate(values):
                if len(lacing) == 255:
                    flush(k > 0, False)
                lacing.append(v)
                body += packet[at : at + v]
                at += v
            granule = g
        flush(False, last)
        return out


def pcm_header(rate: int = RATE) -> bytes:
    """Identification packet: magic, version 0.0, format 1 (unsigned 8 bit), rate, 8 bits, 1 channel, packet size, one more header."""
    return b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, PACKET, 1)


def mux(payload: bytes, note: str, rate: int = RATE) -> bytes:
    """An Ogg file of the payload as samples and the note; equal inputs give equal bytes."""
    serial = zlib.crc32(payload)
    audio, text = Muxer(serial), Muxer(serial ^ 0x5A5A5A5A)
    out = audio.pages([pcm_header(rate)], [0], True, False) + text.pages([b"VNOTE\0"], [0], True, False)
    out += audio.pages([b"\x03comment\0\0\0\0"], [0], False, False)
    packets = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    ends = np.cumsum([len(p) for p in packets]).tolist()
    for k in range(0, len(packets), PAGE_PACKETS):
        last = k + PAGE_PACKETS >= len(packets)
        out += audio.pages(packets[k : k + PAGE_PACKETS], ends[k : k + PAGE_PACKETS], False, last)
        if k == 0:
            out += text.pages([note.encode()], [len(payload)], False, True)
    return b"".join(out)


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number. Raises ValueError where a page is damaged, lost or cut off."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < n or len(page) < end - at:
            raise ValueError("a page breaks off")
        if ogg_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"checksum of page {sequence} of stream {serial}")
        if flags & FIRST:
            if serial in streams:
                raise ValueError("a stream begins twice")
            streams[serial] = Stream(serial)
        stream = streams.get(serial)
        if stream is None or stream.ended or stream.pages != sequence:
            raise ValueError(f"a page of stream {serial} is lost")
        if bool(flags & CONTINUED) != (stream.partial is not None):
            raise ValueError("a packet's parts don't meet")
        stream.pages += 1
        held, stream.partial = stream.partial or b"", None
        begun, place = bool(flags & CONTINUED), at + 27 + n
        ended_any = False
        run = 0
        for v in lacing:
            run += v
            begun = True
            if v < 255:
                stream.packets.append(held + data[place : place + run])
                place, run, held, begun, ended_any = place + run, 0, b"", False, True
        if begun:
            stream.partial = held + data[place : place + run]
        if ended_any:
            stream.marks.append((granule, len(stream.packets)))
        stream.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if s.partial is not None or not s.ended:
            raise ValueError(f"stream {s.serial} breaks off")
    return streams


def decode(data: bytes) -> tuple[bytes, str, dict]:
    """(samples, note, facts) of an Ogg file that `mux` wrote."""
    streams = demux(data)
    audio = next(s for s in streams.values() if s.packets[0][:8] == b"PCM     ")
    note = next(s for s in streams.values() if s.packets[0] == b"VNOTE\0")
    _, _, kind, rate, bits, channels, _, extra = struct.unpack(">HHIIBBHI", audio.packets[0][8:])
    if (kind, bits, channels) != (1, 8, 1):
        raise ValueError("only unsigned 8-bit mono is read")
    samples = b"".join(audio.packets[1 + extra :])
    if audio.marks[-1][0] != len(samples):  # granule positions are compared as whole numbers; seconds are only derived
        raise ValueError("the last granule position isn't the sample count")
    return samples, note.packets[1].decode(), {"rate": rate, "pages": sum(s.pages for s in streams.values()), "packets": len(audio.packets), "streams": len(streams), "seconds": audio.times(rate)[-1]}


def features(samples: bytes, facts: dict) -> str:
    """Streams, pages, packets, duration, mean, root mean square about 128 and crossings of 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    mean, rms = x.mean() if len(x) else 0.0, np.sqrt((x * x).mean()) if len(x) else 0.0
    return f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};seconds={facts['seconds']:.6f};mean={mean:.6f};rms={rms:.6f};crossings={crossings}"


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes and zeros up to a positive multiple of unit."""
    return text + b"\0" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def encode_media(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents with media: the text (null: empty) as an Ogg file. A column called media is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("media")
    names = docs.columns
    at = names.index(text_column)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 50):
                part = batch.slice(k, 50)
                files = []
                for text in part.column(at).cast(pa.binary()).to_pylist():
                    text = text or b""
                    files.append(mux(padded(text), f"bytes={len(text)}"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(files, pa.binary())], names=[*names, "media"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("media", T.BinaryType())]))


_READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame, media_column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and what decoding the media column gives; a null cell gives nulls, a damaged file fails."""
    small_batches(media.sparkSession)
    rows = media.select(*keep, media_column)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 50):
                part = batch.slice(k, 50)
                out: list[list] = [[] for _ in range(7)]
                for data in part.column(len(keep)).to_pylist():
                    values: tuple = (None,) * 7
                    if data is not None:
                        samples, note, facts = decode(data)
                        n = int(note.partition("=")[2])
                        values = (n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(samples, facts))
                    for o, v in zip(out, values):
                        o.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(o, t) for o, t in zip(out, kinds))], names=[*keep, *(x.split()[0] for x in _READ.split(", "))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{fields}, {_READ}")
