import base64
import gzip
import hashlib
import random

from hayrake.llm import warc


def _rec(k, body=b"x" * 50, first=True):
    return warc.record(k, f"http://a/{k}", body, hashlib.sha256(body).hexdigest(), None if first else 0, first)


def _ids(data):
    return [warc._page(f["warc-record-id"]) for kind, *_, f, _ in warc.salvage(data) if kind == "record"]


def _gaps(data):
    return [(a, b) for kind, a, b, *_ in warc.salvage(data) if kind == "gap"]


def test_salvage_of_members_and_plain_records():
    units = [gzip.compress(_rec(k), mtime=0) + warc.END for k in range(6)] + [_rec(k) + b"\r\n\r\n" for k in range(6, 9)]
    whole = b"".join(units)
    assert _ids(whole) == list(range(9)) and not _gaps(whole)
    starts = [sum(map(len, units[:k])) for k in range(10)]
    torn = bytearray(whole)
    torn[starts[2] + 40] ^= 255  # inside a member
    torn[starts[8] - 10] ^= 1  # inside a plain block
    assert _ids(bytes(torn)) == [0, 1, 3, 4, 5, 6, 8]
    gaps = _gaps(bytes(torn))
    assert len(gaps) == 2 and gaps[0][0] == starts[2] and gaps[1] == (starts[7], starts[8])
    assert _ids(b"junk WARC/1.x \x1f\x8b\x08 more" + whole[: starts[3] + 30]) == [0, 1, 2]
    assert _gaps(b"junk" + units[0]) == [(0, 4)] and _ids(b"") == []
    rng = random.Random(1)
    for _ in range(60):
        bad = bytearray(whole)
        k = rng.randrange(9)
        for _ in range(3):
            bad[rng.randrange(starts[k], starts[k + 1])] ^= rng.randrange(1, 256)
        found, last = _ids(bytes(bad)), -1
        assert set(found) >= set(range(9)) - {k} and len(found) <= 9
        for kind, a, b, *_ in warc.salvage(bytes(bad)):
            assert a >= last and b > a and kind in ("record", "gap")
            last = a


def test_pages_round_trip(spark, tmp_path):
    big = "é" * 80
    pages = [(5, "http://x", big), (3, None, big), (9, "u v\r\n", big), (3, "r", big), (1, "s", "short"), (2, "s", "short"),
             (7, "n", None), (8, "e", ""), (None, "z", big), (11, "l", "<p>\r\n\r\nWARC/1.1\r\n" * 20000)]
    d = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id bigint, url string, html string, file string, first int")
    path = warc.write_archives(d, str(tmp_path / "w"))
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert all(r.kind == "record" for r in got)
    want = []
    for k, _, html in pages:
        body = (html or "").encode()
        same = [i for i, _, h in pages if i is not None and (h or "").encode() == body]
        again = len(body) >= 100 and k is not None and k > min(same)
        want.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    kept = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert kept[11] == pages[-1][2].encode() and kept[7] == b""
    assert {r.page_id: r.url for r in got}[9] == "u%20v%0D%0A"
    empty = warc.write_archives(d.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, empty).count() == 0
    for file in (tmp_path / "w").glob("*.txt"):
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n") or not file.stat().st_size


def test_damaged_archive_is_logged(spark, tmp_path):
    d = spark.createDataFrame([(k, "u", f"page {k} " * 30) for k in range(50)], "page_id bigint, url string, html string").coalesce(1)
    path = warc.write_archives(d, str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.txt")
    data = bytearray(file.read_bytes())
    torn = data.find(warc.END, len(data) // 2) - 30
    data[torn] ^= 255
    file.write_bytes(data)
    (tmp_path / "w" / f".{file.name}.crc").unlink()
    got = warc.read_archives(spark, path).collect()
    assert sum(r.kind == "record" for r in got) == 49
    (gap,) = [r for r in got if r.kind == "gap"]
    assert gap.first < torn < gap.past and gap.reason and gap.file.endswith(file.name)


def test_salvage_inside_members():
    recs = [_rec(k, bytes(random.Random(k).choices(range(256), k=400))) + b"\r\n\r\n" for k in range(5)]
    after = gzip.compress(_rec(9), mtime=0) + warc.END
    for level in (0, 6):
        bad = gzip.compress(b"".join([*recs[:2], recs[2][:-50] + b"?" + recs[2][-49:], *recs[3:]]), level, mtime=0)
        assert _ids(bad + after) == [0, 1, 3, 4, 9] and _gaps(bad + after) == [(0, len(bad))]
        member = gzip.compress(b"".join(recs), level, mtime=0)
        crc = member[:-8] + bytes([member[-8] ^ 1]) + member[-7:]
        assert _ids(crc + after) == [0, 1, 2, 3, 4, 9] and len(_gaps(crc + after)) == 1
        cut = member[: len(member) * 3 // 4]
        for data, last in ((cut, []), (cut + after, [9])):
            found = _ids(data)
            assert found == [0, 1, 2, *last] and _gaps(data)[-1][1] == len(cut)


def test_files_of_any_name_are_read(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for k, name in enumerate(["a.warc.gz", "b.warc", "c.txt", "below/d.warc.gz"]):
        (tmp_path / name).write_bytes(_rec(k) + b"\r\n\r\n" if name == "b.warc" else gzip.compress(_rec(k), mtime=0) + warc.END)
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]


def _plain(k, body, version="WARC/1.0", digest="", more=""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <{warc.ID}{k}>\r\n{more}{digest}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _sha1(k, body, bad=False):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    value = base64.b32encode(hashlib.sha1(block + b"!" * bad).digest()).decode()
    return _plain(k, body, digest=f"WARC-Block-Digest: sha1:{value}\r\n")


def test_other_versions_and_folded_fields():
    folded = _plain(2, b"b", more="WARC-Target-URI: http://a/\r\n  long/\r\n\tpath\r\n")
    data = _plain(0, b"a", "WARC/0.18") + _plain(1, b"a", "WARC/1.1") + folded + _plain(3, b"c", "WARC/2.0")
    for archive in (data, gzip.compress(data), b"".join(gzip.compress(x) for x in (data[:0] + _plain(0, b"a", "WARC/0.18"), _plain(1, b"a"), folded, _plain(3, b"c")))):
        assert _ids(archive) == [0, 1, 2, 3] and not _gaps(archive)
    (found,) = [f for *_, f, _ in warc.salvage(folded)]
    assert found["warc-target-uri"] == "http://a/ long/ path"


def test_digests_of_other_kinds():
    good, bad = _sha1(1, b"x" * 40), _sha1(2, b"y" * 40, bad=True)
    assert _ids(good + bad + _sha1(3, b"z")) == [1, 3]
    assert [r for *_, r, f, _ in warc.salvage(bad)] == ["digest"]
    data = b"payload"
    for name in ("sha1", "sha256", "md5", "sha512"):
        d = hashlib.new(name, data).digest()
        for value in (d.hex(), d.hex().upper(), base64.b32encode(d).decode(), base64.b32encode(d).decode().rstrip("=")):
            assert warc.fits(f"{name}:{value}", data) is True and warc.fits(f"{name}:{value}", b"other") is False
    assert warc.fits("", data) is None and warc.fits("crc32:ab", data) is None
    # inside a torn member a record holds by its own digest
    member = gzip.compress(b"".join(_sha1(k, bytes(random.Random(k).choices(range(256), k=300))) for k in range(50)))
    cut = member[: len(member) * 4 // 5]
    found = _ids(cut)
    assert found == list(range(len(found))) and len(found) >= 35
    flipped = bytearray(member)
    flipped[-8] ^= 1
    assert _ids(bytes(flipped)) == list(range(50))


def test_members_without_a_trailer():
    plain = b"".join(_plain(k, f"page {k} ".encode() * 20) for k in range(200))
    member, after = gzip.compress(plain), gzip.compress(_rec(9), mtime=0) + warc.END
    for lost in (1, 6, 8):
        for rest, more in ((b"", []), (after, [9])):
            data = member[:-lost] + rest
            assert _ids(data) == [*range(200), *more]
            marks = [r for kind, _, _, r, _, _ in warc.salvage(data) if kind == "record"]
            assert marks == [warc.UNVERIFIED] * 200 + [""] * len(more)
    # a wrong CRC says that the data are wrong: nothing without a digest is kept
    bad = bytearray(member)
    bad[-7] ^= 1
    assert _ids(bytes(bad)) == [] and len(_gaps(bytes(bad) + after)) == 1
    named = member[:3] + b"\x08" + member[4:10] + b"name\0" + member[10:-5]
    assert _ids(named) == list(range(200))


def test_pages_above_one_bundle(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    pages = [(k, "u", "".join(rng.choices("abcdefghij <>/", k=300_000))) for k in range(12)] + [(12, "u", "x" * 2_500_000)]
    d = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    path = warc.write_archives(d, str(tmp_path / "w"))
    got = warc.read_archives(spark, path).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == [(k, len(h), hashlib.sha256(h.encode()).hexdigest()) for k, _, h in pages]
