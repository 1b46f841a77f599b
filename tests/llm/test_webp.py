import hashlib
import itertools
import zlib

import numpy as np
import pytest

from hayrake.llm import webp


def _image(seed, h=13, w=17, colours=None):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)
    if colours:
        p = p.reshape(-1)[:colours][rng.integers(0, colours, (h, w))]
    p[4:7] = p[1:4]
    p[:, 9] = p[:, 8]
    return p


@pytest.mark.parametrize("transforms", [(), ("predictor",), ("cross",), ("green",), ("predictor", "cross", "green"), ("green", "cross", "predictor")])
def test_every_feature_round_trips(transforms):
    for cache, copies, blocks in itertools.product((0, 1, 7, 11), (False, True), (0, 2)):
        p = _image(cache)
        data = webp.encode(p, transforms, cache, copies, blocks)
        assert (webp.decode(data) == p).all()
        assert (webp.decode_many([data])[0] == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 100])
def test_palettes_and_bundling(colours):
    p = _image(1, colours=colours)
    for more in ((), ("predictor",)):
        assert (webp.decode(webp.encode(p, ("palette", *more), 3, True)) == p).all()


def test_a_file_written_by_hand():
    # 1 x 1, no transforms: five simple codes with one symbol each: green 2, red 1, blue 3, alpha 255, distance 0
    w = webp.Writer()
    w.put(0, 3)
    for s in (2, 1, 3, 255, 0):
        w.put(0b101, 3)
        w.put(s, 8)
    data = webp._file(w.value.to_bytes((w.n + 7) // 8, "little"), 1, 1)
    assert webp.decode(data).tolist() == [[0xFF010203]]


def test_damage_is_an_error_or_pixels():
    data = webp.encode(_image(3), ("predictor",), 4, True)
    for cut in (30, 60, len(data) - 20):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(data[:cut])


def test_media_round_trip():
    rng = np.random.default_rng(5)
    texts = [b"", b"a", b"x" * 576, b"y" * 577, bytes(range(256)) * 30, "é日🙂".encode() * 2000, rng.integers(0, 256, 40000).astype(np.uint8).tobytes()]
    texts += [rng.integers(97, 110, n).astype(np.uint8).tobytes() for n in rng.integers(0, 5000, 60)]
    medias = [webp.to_media(t) for t in texts]
    for t, m, got in zip(texts, medias, webp.from_media(medias), strict=True):
        payload = webp.payload_of(t)
        assert len(payload) % 576 == 0 and payload and got.tobytes()[: len(payload)] == payload
        if len(t) < 3000:
            p = webp.decode(m)
            assert ((p >> 8) & 255).astype(np.uint8).tobytes()[: len(payload)] == payload and (p >> 24 == 255).all()


def test_several_images(monkeypatch):
    monkeypatch.setattr(webp, "IMAGE_BYTES", 576 * 3)
    monkeypatch.setattr(webp, "SIDE", 2)
    text = bytes(range(200)) * 40
    (got,) = webp.from_media([webp.to_media(text)])
    assert got.size >= len(text)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in webp.op10_webp(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = r.text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes) == (len(raw), len(payload))
        assert g.payload_sha256 == hashlib.sha256(payload).hexdigest() and g.tail_crc32 == zlib.crc32(payload[-32:])
        assert g.media_sha256 == hashlib.sha256(webp.to_media(raw)).hexdigest()


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (None, "z" * 70000, 2)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, media int")
    got = webp.features(webp.media_column(d, ["doc_id", "media"])).collect()
    assert sorted((r.row.doc_id or 0, r.n_bytes, r.payload_bytes) for r in got) == [(0, 70000, 70272), (1, 0, 576), (2, 0, 576), (2, 0, 576)]
    assert len({r.payload_sha256 for r in got}) == 2
    assert webp.features(webp.media_column(d.limit(0), ["doc_id"])).count() == 0


def _used(data):
    """Names of what a file uses, read from its bits."""
    bits, width, height, _ = webp._frame(data)
    transforms, own = webp._transforms(bits, width, height)
    cache, _, meta, groups = webp._header(bits, own, height, True)
    names = {["predictor", "cross", "green", "palette"][t[0]] for t in transforms}
    return names | ({"copies"} if groups[0][0].highest >= 256 else set()) | ({"cache"} if cache else set())


def test_media_use_palettes_and_copies():
    line = b"a line of text that is longer than sixty-four bytes, so it becomes a copy\n"
    texts = {b"": {"palette", "copies"}, b"abba" * 400: {"palette", "copies"}, bytes(range(200)): {"copies"}, line + b"something else: 0123456789 %&\n" + line * 3: {"copies"}, np.random.default_rng(9).integers(0, 250, 576).astype(np.uint8).tobytes(): set()}
    files = [webp.to_media(t) for t in texts]
    assert [_used(f) for f in files] == list(texts.values())
    for t, f, got in zip(texts, files, webp.from_media(files * 3), strict=False):
        payload = webp.payload_of(t)
        assert ((webp.decode(f) >> 8) & 255).astype(np.uint8).tobytes()[: len(payload)] == payload == got.tobytes()[: len(payload)]


def test_the_querys_own_files_use_the_method(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    used = [_used(webp.to_media(r.text.encode())) for r in rows]
    assert sum("copies" in u for u in used) > len(rows) // 2
    assert sum("palette" in u for u in used) == sum(len(set(webp.payload_of(r.text.encode()))) <= 16 for r in rows)


def test_pixel_arrays(spark):
    d = spark.createDataFrame([(1, "z" * 1000), (2, "a b" * 50), (3, None)], "doc_id bigint, text string")
    got = {r.row.doc_id: r for r in webp.pixel_arrays(webp.media_column(d, ["doc_id"])).collect()}
    for doc_id, text in ((1, "z" * 1000), (2, "a b" * 50), (3, "")):
        payload = webp.payload_of(text.encode())
        assert bytes((v >> 8) & 255 for v in got[doc_id].pixels)[: len(payload)] == payload and all(v >> 24 == 255 for v in got[doc_id].pixels)
        assert got[doc_id].height * got[doc_id].width == len(got[doc_id].pixels)
