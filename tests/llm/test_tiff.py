import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tiff
from tidemark.llm.frames import read
from tidemark.llm.tiff import media_features, payload_of, read_pages, store, tiff_pages, write_pages


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b" * 9, b"\x80" * 200, bytes(range(256))]), max_size=40))
def test_coders(parts):
    data = b"".join(parts)
    assert tiff.unpackbits(tiff.packbits(data), len(data)) == data
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_over_full_tables():
    data = np.random.default_rng(1).integers(0, 256, 40000, dtype=np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data
    data = np.random.default_rng(1).integers(0, 3, 60000, dtype=np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_known_bytes():
    # Fixed value: the code stream of this row in the format's published description.
    row = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    want = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw(row) == want and tiff.unlzw(want, 9) == row


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_round_trip(compression, predictor, tile, order, kind):
    rng = np.random.default_rng(7)
    pages = [rng.integers(0, 7, (h, w, s)).astype(kind) * 31 for h, w, s in ((5, 9, 1), (40, 70, 3), (1, 1, 4))]
    back = list(read_pages(write_pages(pages, compression, predictor, 16, tile, order)))
    assert [p.number for p in back] == [0, 1, 2]
    for page, image in zip(back, pages, strict=True):
        assert (page.height, page.width, page.samples) == image.shape
        assert page.pixels == image.astype(image.dtype.newbyteorder("<")).tobytes()


def test_floating_predictor():
    values = np.array([[1.5, -2.25, 3e9, 0.0]], np.float32)
    planes = values.astype(">f4").view(np.uint8).reshape(4, 4).T.reshape(-1)
    data = np.diff(planes, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    got = tiff._unpredict(data, (1, 4, 1), np.dtype("<u4"), tiff.FLOATING)
    assert got.astype("<u4").tobytes() == values.astype("<f4").tobytes()


def test_bad_files(spark):
    good = write_pages([np.ones((3, 4, 1), np.uint8)] * 2)
    ring = bytearray(write_pages([np.ones((3, 4, 1), np.uint8)]))
    ring[-4:] = ring[4:8]
    rows = [(1, good, "a"), (2, None, "b"), (3, b"", "c"), (4, b"II*\0", "d"), (5, good[:-20], "e"), (6, bytes(ring), "f"), (7, b"x" * 99, "g")]
    out = tiff_pages(spark.createDataFrame(rows, "id int, media binary, width string")).collect()
    ok = [(r.id, r.page, r.width, r.height) for r in out if r.error is None]
    assert ok == [(1, 0, 4, 3), (1, 1, 4, 3), (5, 0, 4, 3), (6, 0, 4, 3)]
    assert [r.id for r in out if r.error is not None] == [2, 3, 4, 5, 6, 7]


def test_all_forms_are_used():
    forms = set()
    for k in range(200):
        text = (f"text {k} " * (k % 90)).encode()
        data = store(payload_of(text))
        page = next(read_pages(data))
        forms.add((page.compression, page.predictor, b"MM" == data[:2]))
        assert b"".join(p.pixels for p in read_pages(data)) == payload_of(text)
    assert len(forms) >= 3


def test_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    got = {r.doc_id: r for r in media_features(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = r.text.encode()
        payload = raw + b"\xff" * ((576 - len(raw) % 576) % 576)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = store(payload)
        assert (g.media_bytes, g.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(tiff, "PAGE_ROWS", 2)
    rows = [(1, None, 0), (None, "", 0), (2, "x" * 5000, 0), (2, "x" * 5000, 0), (3, "y" * 576, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, page int")
    got = media_features(df).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in got) == [(0, 0, 576), (1, 0, 576), (2, 5000, 5184), (2, 5000, 5184), (3, 576, 576)]
    assert len({tuple(r)[1:] for r in got}) == 3
    assert media_features(df.limit(0)).count() == 0


def test_pages_behind_a_bad_one(spark):
    """A page that can't be read has an error row, and those behind it are read."""
    pages = [np.full((4, 5, 3), k, np.uint8) for k in range(4)]
    good = write_pages(pages, tiff.DEFLATE, 1)
    entry = lambda data, tag: [k for k in range(8, len(data) - 12) if data[k : k + 2] == struct.pack("<H", tag) and data[k + 2 : k + 4] in (b"\3\0", b"\4\0")]
    jpeg, strip, outside = bytearray(good), bytearray(good), bytearray(good)
    struct.pack_into("<H", jpeg, entry(good, tiff.COMPRESSION)[1] + 8, 7)
    (begin,) = struct.unpack_from("<I", good, entry(good, tiff.STRIP_OFFSETS)[2] + 8)
    strip[begin : begin + 4] = b"\xff" * 4
    struct.pack_into("<I", outside, entry(good, tiff.BITS)[0] + 8, 1 << 30)
    df = spark.createDataFrame(list(enumerate(bytes(x) for x in (good, jpeg, strip, outside))), "id int, media binary")
    rows = tiff_pages(df).orderBy("id", "page").collect()
    assert [(r.id, r.page) for r in rows] == [(k, n) for k in range(4) for n in range(4)]
    assert [(r.id, r.page) for r in rows if r.error is not None] == [(1, 1), (2, 2), (3, 0)]
    assert all(bytes(r.pixels) == pages[r.page].tobytes() for r in rows if r.error is None)


def test_damaged_headers_give_error_rows(spark):
    """Signed, textual and huge sizes, and segments that are short or nowhere: an error each, and no memory taken for it."""
    good = write_pages([np.arange(192, dtype=np.uint8).reshape(8, 8, 3)])

    def with_tag(tag, kind, value):
        out = bytearray(good)
        at = struct.unpack_from("<I", out, 4)[0]
        for k in range(struct.unpack_from("<H", out, at)[0]):
            place = at + 2 + 12 * k
            if struct.unpack_from("<H", out, place)[0] == tag:
                struct.pack_into("<HHI4s", out, place, tag, kind, 1, value)
        return bytes(out)

    files = [with_tag(tag, kind, value) for tag in (256, 257, 277) for kind, value in ((9, struct.pack("<i", -5)), (2, b"a\0\0\0"), (4, b"\xff\xff\xff\x7f"), (4, bytes(4)))]
    files += [with_tag(273, 9, struct.pack("<i", -8)), with_tag(279, 4, b"\1\0\0\0"), with_tag(259, 3, b"\x39\5\0\0"), with_tag(258, 2, b"x\0\0\0"), good[:-3], b"", b"II*\0"]
    df = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate([*files, good])], "k int, media binary")
    rows = tiff_pages(df).collect()
    assert sorted(r.k for r in rows) == list(range(len(files) + 1))
    assert all((r.error is None) == (r.k == len(files)) for r in rows)
