import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import html, tiff


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.uint32])
def test_round_trip(compression, predictor, tile, order, kind):
    r = np.random.default_rng(1)
    pages = [r.integers(0, 250, (70, 33, 3)).astype(kind), np.full((5, 40, 1), 7, kind)]
    found = tiff.read_pages(tiff.write_pages(pages, compression, predictor, 13, tile, order))
    assert len(found) == 2 and all((a == b).all() and a.dtype == b.dtype for a, b in zip(pages, found, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_codecs(data, times):
    data = data * times
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


@pytest.mark.parametrize(
    ("packed", "plain"),
    [(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA]), "AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10), (b"\x80\x00\x41", "41")],
)
def test_known_pack_bits(packed, plain):
    assert tiff.unpack_bits(packed) == bytes.fromhex(plain)


def small(tags, strip, order="<"):
    """A file of one strip with the tags given as (tag, type, value)."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8 + len(strip)) + strip
    tags = sorted([*tags, (tiff.STRIP_OFFSETS, 4, 8), (tiff.STRIP_BYTES, 4, len(strip))])
    out += struct.pack(f"{order}H", len(tags))
    for tag, kind, value in tags:
        out += struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
    return bytes(out + b"\0\0\0\0")


def test_bilevel_and_float():
    data = small([(tiff.WIDTH, 3, 10), (tiff.HEIGHT, 3, 2), (tiff.BITS, 3, 1)], b"\xaa\x80\x55\x40")
    assert tiff.read_pages(data)[0][:, :, 0].tolist() == [[1, 0] * 4 + [1, 0], [0, 1] * 4 + [0, 1]]
    values = np.array([[1.5, -2.25, 3e10]], ">f4")
    shuffled = values.view(np.uint8).reshape(1, 3, 4).transpose(0, 2, 1).reshape(1, 12)
    coded = np.concatenate([shuffled[:, :1], np.diff(shuffled, axis=1)], axis=1).tobytes()
    data = small([(tiff.WIDTH, 3, 3), (tiff.HEIGHT, 3, 1), (tiff.BITS, 3, 32), (tiff.SAMPLE_FORMAT, 3, 3), (tiff.PREDICTOR, 3, 3)], coded)
    assert tiff.read_pages(data)[0].ravel().tolist() == values.astype(np.float32).ravel().tolist()


@pytest.mark.parametrize("bad", [b"", b"II*\0", b"II*\0\x08\0\0\0", b"GIF89a__", b"II*\0\x08\0\0\0\xff\xff", b"MM\0*\0\0\0\x08\0\0\0\0\0\x08"])
def test_bad_files_say_so(bad):
    with pytest.raises(tiff.TiffError):
        tiff.read_pages(bad)


def test_one_row_for_each_page(spark):
    pages = [np.arange(12, dtype=np.uint8).reshape(3, 4, 1), np.full((2, 2, 3), 9, np.uint16)]
    good = tiff.write_pages(pages)
    rows = [(1, good, "a"), (1, good, "a"), (2, None, "b"), (3, b"nothing", None), (None, good[:-20], "c")]
    frame = spark.createDataFrame(rows, "id long, media binary, note string")
    found = [r.asDict() for r in tiff.tiff_pages(frame).collect()]
    one = [r for r in found if r["id"] == 1]
    assert sorted(r["page"] for r in one) == [0, 0, 1, 1] and all(r["note"] == "a" for r in one)
    first = next(r for r in one if r["page"] == 0)
    assert (first["width"], first["height"], first["samples"], first["kind"], bytes(first["pixels"])) == (4, 3, 1, "uint8", bytes(range(12)))
    assert [r["error"] for r in found if r["id"] == 3] == ["no TIFF"] and not [r for r in found if r["id"] == 2]
    assert [r for r in found if r["id"] is None][-1]["error"]
    with pytest.raises(ValueError):
        tiff.tiff_pages(frame.withColumnRenamed("note", "Page"))
    assert tiff.tiff_pages(frame.limit(0)).count() == 0


def test_stored_texts_come_back(spark):
    texts = ["", None, "a", "é" * 400, "x" * 576, "y" * 577, "long " * 600000]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(None, "a", "m")], "doc_id long, text string, media string")
    found = {r["doc_id"]: r for r in tiff.media_digests(tiff.store_texts(docs)).collect()}
    assert len(found) == 8
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert found[0]["media_sha256"] == found[1]["media_sha256"] and found[2]["feature"] == found[None]["feature"] != found[0]["feature"]


PAGE = """<!doctype html><html><head><title>t</title></head><body><h1>Hi <b>there</b></h1>loose<p>one<p>two &amp; three
<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><table><tr><th>Name<th>Qty</tr><tr><td>apple pie<td>3<tr><td colspan=2>wide cell here</table>
<pre>
 a
   b

c</pre><div hidden>no</div><span style="display: none">no</span><dl><dt>T<dd>D1<dd>D2</dl>x<br>y<script>var x="</p>"</script><!-- no --></body></html>"""
SHOWN = """Hi there

loose

one

two & three

- a
- b
  3. x
  4. y
- c

Name       Qty
apple pie  3
wide cell here

 a
   b

c

T
  D1
  D2

x
y"""


def test_layout():
    assert html.render(PAGE) == SHOWN


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("a < b &lt;c&gt; &nbsp;d", "a < b <c> \xa0d"),
        ("<p>a<b>b</p>c</b>d", "ab\n\ncd"),
        ("<table>loose<tr><td rowspan=2>r<td>1<tr><td>2</table>", "loose\n\nr  1\n   2"),
        ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br><br>b", "a\n\nb"),
        ("<select><option>x<option>y</select>", "x\ny"),
        ("<template>no</template><noscript>no</noscript><svg><title>no</title><text>yes</text></svg>yes", "yes yes"),
        ("<textarea>\n a &amp; b</textarea>", "\n a & b".strip("\n")),
        ("<a href='x>y'>link</a>", "link"),
        ("<table><tr><td>日本<td>x<tr><td>abcdef<td>y</table>", "日本    x\nabcdef  y"),
        ("unclosed <b", "unclosed <b"),
        ("<script>never closed <p>x", ""),
        ("<p style='visibility:hidden'>no</p><dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ],
)
def test_pages(page, text):
    assert html.render(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <b> </b> <table> <tr> <td> </table> <ul> <li> </ul> <div> </div> text <br> <script> </script> <pre> </pre> &amp; < > <td colspan=3> <!-- --> <dl> <dd>".split(" ")), max_size=60))
def test_any_soup_renders(parts):
    assert "<script" not in html.render(" ".join(parts))


def test_deep_nesting_is_flattened():
    assert html.render("<div>" * 5000 + "x" + "<table><tr><td>" * 500 + "y").split() == ["x", "y"]


def test_page_table(spark):
    pages = spark.createDataFrame([(1, PAGE, "u"), (2, None, "u"), (None, "<p>x", "u"), (1, PAGE, "u")], "page_id long, html string, text string")
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract_text(pages).collect()]
    assert found.count((1, SHOWN, len(SHOWN))) == 2 and (2, "", 0) in found and (None, "x", 1) in found
    assert html.extract_text(pages.limit(0)).count() == 0
