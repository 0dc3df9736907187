import hashlib
import struct
import zlib

from hypothesis import given, settings, strategies as st

from assaylake.llm import ogg


def slow_checksum(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


@given(st.binary(max_size=300))
def test_checksum(data):
    assert ogg.checksum(data) == slow_checksum(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700) | st.integers(0, 70_000).map(bytes), max_size=6), st.lists(st.binary(max_size=300), max_size=4))
def test_streams_part_and_packets_join(one, two):
    a, b = ogg.Stream(1), ogg.Stream(2)
    media = b"".join(a.pages([ogg.Packet(p, 5)]) + (b.pages([ogg.Packet(q, 7)]) if q is not None else b"") for p, q in zip(one, [*two, *[None] * 9]))
    got = ogg.read(media)
    assert [p for p, _ in got.streams.get(1, [])] == one and [p for p, _ in got.streams.get(2, [])] == two[: len(one)]
    assert not got.damaged and not got.lost


def test_times_and_page_borders():
    s = ogg.Stream(9)
    got = ogg.read(s.pages([ogg.Packet(b"x" * 300, 300), ogg.Packet(b"y" * 200, 500), ogg.Packet(b"z" * 255 * 300, 500 + 255 * 300)]))
    assert [(len(p), t) for p, t in got.streams[9]] == [(300, 300), (200, 500), (255 * 300, 500 + 255 * 300)] and got.pages == 2


def test_damage_is_found():
    samples, n = ogg.payload("some text " * 20_000)
    media = bytearray(ogg.write(samples, n))
    media[len(media) // 2] ^= 1
    got = ogg.read(bytes(media))
    assert got.damaged == 1 and got.pages == ogg.read(ogg.write(samples, n)).pages - 1
    assert ogg.read(b"nothing").damaged == 1 and ogg.read(b"").pages == 0
    assert ogg.read(bytes(media[:-5])).damaged >= 1


def test_frame(odd, none, spark):
    stored = ogg.store(odd)
    for r in ogg.read_media(stored).collect():
        data = (r["text"] or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:]) and r["media_bytes"] == len(r["media"]) and r["feature"].endswith("/ok")
    assert ogg.read_media(ogg.store(none)).collect() == []
    assert ogg.read_media(spark.createDataFrame([(1, None)], "k int, media binary")).first()["feature"] is None


def test_foreign_streams(spark):
    stream = lambda serial, packets: ogg.Stream(serial).pages([ogg.Packet(p, len(p)) for p in packets])
    short, marks = stream(1, [b"pcm8abc", b"\1" * 50]), stream(2, [b"mark", b"long mark", b""])
    good = ogg.write(*ogg.payload("text"))
    rows = spark.createDataFrame([(1, short), (2, marks), (3, short + marks), (4, good)], "k int, media binary")
    got = {r["k"]: (r["payload_bytes"], r["damaged"], r["feature"].rpartition("/")[2]) for r in ogg.read_media(rows).collect()}
    assert got == {1: (0, 1, "ok"), 2: (0, 2, "differs"), 3: (0, 3, "differs"), 4: (64, 0, "ok")}
