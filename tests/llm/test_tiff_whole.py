import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import tiff


def with_compression(data, page, compression):
    """The little-endian file with the compression of one of its pages overwritten."""
    out, at = bytearray(data), struct.unpack_from("<I", data, 4)[0]
    for _ in range(page):
        at = struct.unpack_from("<I", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]
    for entry in range(at + 2, at + 2 + 12 * struct.unpack_from("<H", data, at)[0], 12):
        if struct.unpack_from("<H", data, entry)[0] == tiff.COMPRESSION:
            struct.pack_into("<H", out, entry + 8, compression)
    return bytes(out)


def test_pages_after_an_unreadable_one_are_read(spark):
    pages = [np.full((2, 3, 1), n, np.uint8) for n in range(4)]
    data = with_compression(with_compression(tiff.write_pages(pages), 1, 7), 3, 4)
    frame = spark.createDataFrame([(1, data), (2, data[:-1])], "id long, media binary")
    found = sorted(((r["id"], r["page"], r["pixels"] and bytes(r["pixels"]), bool(r["error"])) for r in tiff.tiff_pages(frame).collect()), key=lambda r: r[:2])
    good = [bytes([n] * 6) for n in range(4)]
    assert [r[1:] for r in found if r[0] == 1] == [(0, good[0], False), (1, None, True), (2, good[2], False), (3, None, True)]
    assert [r[1:] for r in found if r[0] == 2][:3] == [(0, good[0], False), (1, None, True), (2, good[2], False)]
    assert found[-1][3]


def with_field(data, tag, kind=None, count=None, value=None, new_tag=None):
    """The little-endian file with an entry of its first directory changed."""
    out, at = bytearray(data), struct.unpack_from("<I", data, 4)[0]
    for entry in range(at + 2, at + 2 + 12 * struct.unpack_from("<H", data, at)[0], 12):
        if struct.unpack_from("<H", data, entry)[0] == tag:
            for form, place, x in (("<H", 0, new_tag), ("<H", 2, kind), ("<I", 4, count), ("<I", 8, value)):
                if x is not None:
                    struct.pack_into(form, out, entry + place, x)
    return bytes(out)


TILED = tiff.write_pages([np.arange(600, dtype=np.uint8).reshape(20, 30, 1)], tile=16)
STRIPS = tiff.write_pages([np.arange(600, dtype=np.uint8).reshape(20, 30, 1)], predictor=2, rows_per_strip=7)
BIG = b"II+\0\x08\0\0\0" + struct.pack("<Q", 16) + struct.pack("<Q", 1) + struct.pack("<HHQQ", tiff.WIDTH, 16, 1 << 61, 16) + bytes(8)


@pytest.mark.parametrize(
    "bad",
    [
        with_field(TILED, tiff.TILE_HEIGHT, new_tag=60000),
        with_field(TILED, tiff.TILE_WIDTH, value=0),
        with_field(TILED, tiff.TILE_BYTES, new_tag=60000),
        with_field(STRIPS, tiff.PREDICTOR, value=3),
        with_field(STRIPS, tiff.PREDICTOR, value=9),
        with_field(STRIPS, tiff.SAMPLES, count=0),
        with_field(STRIPS, tiff.WIDTH, kind=11),
        with_field(STRIPS, tiff.WIDTH, kind=9, value=0xFFFFFFFF),
        with_field(STRIPS, tiff.WIDTH, value=1 << 31),
        with_field(STRIPS, tiff.STRIP_OFFSETS, count=1 << 30),
        with_field(STRIPS, tiff.STRIP_OFFSETS, kind=2, count=3),
        with_field(STRIPS, tiff.ROWS_PER_STRIP, value=0),
        with_field(STRIPS, tiff.BITS, value=5),
        BIG,
    ],
)
def test_every_fault_is_an_error_row(spark, bad):
    with pytest.raises(tiff.TiffError):
        tiff.read_pages(bad)
    frame = spark.createDataFrame([(1, bad), (2, STRIPS)], "id long, media binary")
    found = {r["id"]: r for r in tiff.tiff_pages(frame).collect()}
    assert found[1]["error"] and found[1]["pixels"] is None and not found[2]["error"]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from([TILED, STRIPS, *(tiff.write_pages([np.full((9, 9, 3), 5, np.uint16)] * 2, c, p, 4, t, o) for c in (tiff.LZW, tiff.PACKBITS) for p in (1, 2) for t in (0, 16) for o in "<>")]), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), min_size=1, max_size=6), st.integers(0, 40))
def test_mutated_files_are_read_or_refused(data, changes, cut):
    out = bytearray(data)
    for at, value in changes:
        out[-1 - at % len(out)] = value
    try:
        tiff.read_pages(bytes(out[: len(out) - cut]), 1 << 20)
    except tiff.TiffError:
        pass


def test_codecs_stop_at_the_size_asked():
    assert len(tiff.unpack_lzw(tiff.pack_lzw(bytes(100_000)), 10)) < 1000
    assert len(tiff.unpack_bits(tiff.pack_bits(bytes(100_000)), 10)) < 1000
