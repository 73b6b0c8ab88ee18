import hashlib
import zlib

import numpy as np
import pytest

from tagatlas.llm import jpeg
from tests.llm.cases import documents, empty

from .jpeg_writer import colour_jpeg


def test_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 18, 300):
        payload = rng.integers(0, 256, n * jpeg.ROW, dtype=np.uint8).tobytes()
        assert b"".join(g.tobytes() for g in jpeg.luminance(jpeg.parse(jpeg.encode(payload)))) == payload
    for payload in (b"\x00" * 192, b"\xff" * 192, b"\x00\xff" * 192, b" " * 384):
        assert b"".join(g.tobytes() for g in jpeg.luminance(jpeg.parse(jpeg.encode(payload)))) == payload


def test_high_pictures(monkeypatch):
    monkeypatch.setattr(jpeg, "HIGHEST", 5)
    monkeypatch.setattr(jpeg, "LANES", 4)
    payload = bytes(range(192)) * 13
    scans = jpeg.parse(jpeg.encode(payload))
    assert [s.height for s in scans] == [40, 40, 24]
    assert b"".join(g.tobytes() for g in jpeg.luminance(scans)) == payload


def test_colour_and_ac():
    """A 4:2:0 file with AC coefficients, from a plain writer; luminance comes back as its DC coefficients."""
    rng = np.random.default_rng(4)
    for interval in (0, 2):
        luma = rng.integers(0, 256, (6, 8))
        got = jpeg.luminance(jpeg.parse(colour_jpeg(luma, interval)))[0]
        assert (got == luma).all()


def test_bad_files():
    good = jpeg.encode(b"a" * 192)
    for bad in (b"x", b"\xff\xd8", good[:-2], good[:40], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(jpeg.BadJpeg):
            jpeg.luminance(jpeg.parse(bad))


def test_features(spark):
    docs = documents(spark)
    got = jpeg.features(jpeg.stored(docs)).select("doc_id", "text", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media", "media_sha256", "feature", "error").collect()
    assert len(got) == docs.count()
    for r in got:
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192) or b" " * 192
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.error) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest(), None)
    assert jpeg.features(jpeg.stored(empty(spark))).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"no")), (2, None), (3, bytearray(jpeg.encode(b"q" * 192)))], "id long, media binary")
    assert [r.error is None for r in jpeg.features(bad).orderBy("id").collect()] == [False, False, True]
