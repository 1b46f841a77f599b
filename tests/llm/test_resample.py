import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from hayrake.llm import resample as rs

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, width=2):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = _WORD.findall(low)
    runs = [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % 10000 for r in runs)


def _brute(docs, items, share=25):
    own = [(d, *_features(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in own:
        s.update(c)
    for text in items:
        t.update(_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for d, n_words, c in own:
        n = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, n_words, n, weight, score])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = {}
    for k, r in enumerate(able[: len(able) * share // 100]):
        ranks.setdefault(tuple(r), []).append(k + 1)
    return sorted(([r[0], *r[2:], ranks[tuple(r)].pop(0) if ranks.get(tuple(r)) else None] for r in out), key=str)


def _sample():
    rng = random.Random(13)
    words = ["The", "of", "und", "élan", "ÀB", "x9", "日本", "naïve", "Q" * 70, "a", "b", "-", "\n", "\x00", "Z_"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 80)))) for i in range(300)]
    docs += [(300, None), (301, ""), (7, docs[7][1]), (7, "of of of"), (None, "the élan of " * 20), (302, "!?")]
    return docs, [" ".join(rng.choices(words[:5], k=30)) for _ in range(5)] + [None, ""]


def _found(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, row string, score int")
    t = spark.createDataFrame([(t,) for t in items], "text string")
    return rs.resample(d, t, ["doc_id", "score"], **more)


def _rows(found):
    return sorted(([r.row.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in found.collect()), key=str)


def test_against_brute_force(spark):
    docs, items = _sample()
    found = _found(spark, docs, items)
    assert found.columns == ["row", "n_words", "n_features", "weight", "score", "rank"]
    assert _rows(found) == _brute(docs, items)


def test_pieces_change_nothing(spark, monkeypatch):
    docs, _ = _sample()
    long = " ".join(t or "" for _, t in docs) + " " + "w" * 5000 + " end"
    want = {w: rs._count([long.encode(), None, b"one"], w, 10_000) for w in (1, 2, 3)}
    for w in want:
        n, c = _features(long, w)
        assert want[w][0].tolist() == [n, 0, 1]
        assert dict(zip(want[w][2][want[w][1] == 0].tolist(), want[w][3].tolist(), strict=False)) == c
    monkeypatch.setattr(rs, "PIECE", 50)
    monkeypatch.setattr(rs, "SLICE", 300)
    for w in want:
        assert all((a == b).all() for a, b in zip(rs._count([long.encode(), None, b"one"], w, 10_000), want[w], strict=True))


def test_crc_is_zlibs():
    words = ["", "a", "é 日本", "x" * 63, "x" * 64, "x" * 65, "y" * 3000, "ab"] * 3
    assert rs.crc32(pa.array(words)).to_pylist() == [zlib.crc32(w.encode()) for w in words]
    assert rs.crc32(pa.array(["no", *words]).slice(1)).to_pylist() == [zlib.crc32(w.encode()) for w in words]


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_against_brute_force_and_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = rs.op13_resample(spark, folder)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((list(r) for r in found.collect()), key=str)
    assert got == _brute(docs, items)
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        assert sorted(map(list, con.sql(rs.OP13_SQL).fetchall()), key=str) == got


def test_draw_leans_to_the_target(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["sun", "moon", "star"] if i % 4 == 0 else ["tax", "fee", "rent"], k=60))) for i in range(400)]
    chosen = [r.row.doc_id for r in _found(spark, docs, ["sun moon star moon sun " * 2000]).where("rank is not null").collect()]
    assert len(chosen) == 100 and sum(d % 4 == 0 for d in chosen) > 90


def test_empty_tables(spark):
    docs, _ = _sample()
    assert _found(spark, [], ["x"]).count() == 0
    assert _rows(_found(spark, docs, [])) == _brute(docs, [])
