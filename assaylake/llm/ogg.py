"""Media columns in Ogg: samples are stored as pages of two logical streams in one binary column, and read back from it.

Stream 1 holds the samples in packets of PACKET bytes after a header packet, stream 2 a checksum for each page of samples. Reading verifies
the checksum of every page, reassembles packets from lacing values (over page borders too), parts the streams by serial number, and
derives the time of each packet from granule positions. A damaged page is skipped up to the next capture pattern, and packets that lack a part are
left out; both are counted. Streams that only look like these two are damage, not an error.

Defined results: null text is empty (one block of 64 zeros); equal texts give equal media; null media gives null results; an empty table gives no rows;
other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from . import common

BLOCK, PACKET, RATE = 64, 4000, 8000
#: Bytes of the header packet of samples: "pcm8", rate, samples that aren't padding.
PCM_HEADER = 16
#: Packets of samples on a page; a page has 255 lacing values at most.
PAGE_PACKETS = 12
#: Page header: capture pattern, version, flags, granule position, serial number, sequence number, checksum, lacing values.
HEADER = "<4sBBqIIIB"
HEADER_BYTES = struct.calcsize(HEADER)
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC (polynomial 04C11DB7, highest bit first, from 0): zlib's is the same with bits mirrored and both ends inverted."""
    return int(f"{zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


class Packet(NamedTuple):
    data: bytes
    granule: int


class Stream:
    """Writes pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> bytes:
        parts = ["OggS".encode(), 0, flags, granule, self.serial, self.sequence, 0, len(lacing)]
        self.sequence += 1
        parts[6] = checksum(struct.pack(HEADER, *parts) + lacing + body)
        return struct.pack(HEADER, *parts) + lacing + body

    def pages(self, packets: list[Packet], flags: int = 0) -> bytes:
        """The packets on one page, or on several where they have over 255 lacing values; a granule of -1 marks a page on which no packet ends."""
        lacing = b"".join(b"\xff" * (len(p.data) // 255) + bytes([len(p.data) % 255]) for p in packets)
        body, ends = b"".join(p.data for p in packets), [p.granule for p in packets]
        out, at, done = [], 0, 0
        for k in range(0, len(lacing), 255):
            part = lacing[k : k + 255]
            size, done = sum(part), done + sum(v < 255 for v in part)
            more = k + 255 < len(lacing)
            own = flags & FIRST * (k == 0) | flags & LAST * (not more) | CONTINUED * (k > 0 and lacing[k - 1] == 255)
            out.append(self.page(part, body[at : at + size], ends[done - 1] if any(v < 255 for v in part) else -1, own))
            at += size
        return b"".join(out)


def write(samples: bytes, n_bytes: int) -> bytes:
    """8-bit samples as Ogg; the header packet notes the rate and how many samples aren't padding."""
    serial = zlib.crc32(samples)
    sound, marks = Stream(serial), Stream(serial ^ 0xFFFFFFFF)
    out = [sound.pages([Packet(b"pcm8" + struct.pack("<IQ", RATE, n_bytes), 0)], FIRST), marks.pages([Packet(b"mark", 0)], FIRST)]
    step = PACKET * PAGE_PACKETS
    for at in range(0, len(samples), step):
        part = samples[at : at + step]
        last = LAST * (at + step >= len(samples))
        out.append(sound.pages([Packet(part[i : i + PACKET], at + min(i + PACKET, len(part))) for i in range(0, len(part), PACKET)], last))
        out.append(marks.pages([Packet(struct.pack("<I", zlib.crc32(part)), at + len(part))], last))
    return b"".join(out)


class Page(NamedTuple):
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes


def pages(media: bytes) -> Iterator[Page | None]:
    """The pages whose checksum holds; None for each stretch that isn't one."""
    at = 0
    while at < len(media):
        if media[at : at + 4] == b"OggS" and at + HEADER_BYTES <= len(media):
            _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from(HEADER, media, at)
            lacing = media[at + HEADER_BYTES : at + HEADER_BYTES + n]
            end = at + HEADER_BYTES + n + sum(lacing)
            page = media[at:end]
            if version == 0 and end <= len(media) and checksum(page[:22] + b"\0\0\0\0" + page[26:]) == crc:
                yield Page(flags, granule, serial, sequence, lacing, page[HEADER_BYTES + n :])
                at = end
                continue
        yield None
        at = media.find(b"OggS", at + 1)
        if at < 0:
            return


class Read(NamedTuple):
    streams: dict[int, list[tuple[bytes, int]]]
    pages: int
    damaged: int
    lost: int


def read(media: bytes) -> Read:
    """Packets of each logical stream with the granule at which they end (-1 if unknown); a page's granule is that of the last packet that ends on it,
    those before it end earlier by the lengths of what follows."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_: dict[int, bytes | None] = {}
    due: dict[int, int] = {}
    good = bad = lost = 0
    for page in pages(media):
        if page is None:
            bad += 1
            continue
        good += 1
        out = streams.setdefault(page.serial, [])
        gap = page.sequence != due.get(page.serial, page.sequence)
        due[page.serial] = page.sequence + 1
        held = open_.get(page.serial)
        if held is not None and (gap or not page.flags & CONTINUED):
            lost, held = lost + 1, None
        skip = bool(page.flags & CONTINUED) and held is None  # the packet's start is missing
        data, at, ended = held or b"", 0, []
        for v in page.lacing:
            data += page.body[at : at + v]
            at += v
            if v < 255:
                if skip:
                    lost, skip = lost + 1, False
                else:
                    ended.append(data)
                data = b""
        open_[page.serial] = data if page.lacing and page.lacing[-1] == 255 and not skip else None
        granule = page.granule
        times = []
        for packet in reversed(ended):
            times.append(granule)
            granule = granule - len(packet) if granule >= 0 else -1
        out += zip(ended, reversed(times))
    return Read(streams, good, bad, lost + sum(x is not None for x in open_.values()))


def payload(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % BLOCK if data else BLOCK), len(data)


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with media (binary): the padded bytes of the text as 8-bit samples in Ogg."""
    return common.map_batches(docs, lambda: lambda texts: {"media": [write(*payload(t)) for t in texts]}, [text_col], "media binary")


def read_media(docs: DataFrame, media_col: str = "media") -> DataFrame:
    """docs with what the stored bytes give: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, damaged pages, lost packets.

    feature: "pages/packets/milliseconds/mean/deviation/sign changes" of the samples, and "ok" if the marks of stream 2 agree with them.
    """
    kind = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, damaged int, lost int"
    names = [x.split()[0] for x in kind.split(", ")]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(names)
        got = read(media)
        kinds = [(s[0][0][:4], s) for s in got.streams.values() if s]
        sound = next((s for kind, s in kinds if kind == b"pcm8" and len(s[0][0]) >= PCM_HEADER), [(b"pcm8" + bytes(PCM_HEADER - 4), 0)])
        marks = next((s for kind, s in kinds if kind == b"mark"), [(b"", 0)])
        # Streams of others may use these names: headers too short and marks of another length count as damage.
        damaged = got.damaged + sum(kind == b"pcm8" and len(s[0][0]) < PCM_HEADER for kind, s in kinds) + sum(len(m) != 4 for m, _ in marks[1:])
        rate, n_bytes = struct.unpack_from("<IQ", sound[0][0], 4)
        samples = b"".join(p for p, _ in sound[1:])
        x = np.frombuffer(samples, "u1")
        at, agree = 0, True
        for mark, granule in marks[1:]:
            agree &= len(mark) == 4 and zlib.crc32(samples[at:granule]) == int.from_bytes(mark, "little")
            at = granule
        signs = int(np.count_nonzero(np.diff((x >= 96).view("i1"))))
        mean, deviation = (float(x.mean()), float(x.std())) if len(x) else (0.0, 0.0)
        feature = f"{got.pages}/{len(sound) - 1}/{1000 * max(sound[-1][1], 0) // (rate or RATE)}/{mean:.3f}/{deviation:.3f}/{signs}/{'ok' if agree else 'differs'}"
        return (n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, damaged, got.lost)

    def step(column):
        rows = [one(m) for m in column]
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return common.map_batches(docs, lambda: step, [media_col], kind)


def op6_ogg(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_media(store(docs).drop("text")).drop("media", "damaged", "lost")
