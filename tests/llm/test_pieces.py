import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from hayrake.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def m():
    return pieces.PieceModel(PATH)


LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def scored():
    """A unigram model of the same pieces with Zipf's scores."""
    m = pieces.PieceModel(PATH)
    m.merging = False

    def rescore(node):
        for c, v in node.items():
            if c:
                rescore(v)
            else:
                node[c] = (-math.log(v[1] + 2), v[1])

    rescore(m.tails)
    m.pieces = [(p, -math.log(k + 2), t) for k, (p, _, t) in enumerate(m.pieces)]
    m.unknown_score = -30.0
    return m


def _brute(m, word):
    table = {p: (s, k) for k, (p, s, t) in enumerate(m.pieces) if t in (1, 4)}
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        found = [(best[a][0] + table[word[a:end]][0], -a, best[a][1] + [table[word[a:end]][1]]) for a in range(end) if word[a:end] in table]
        if word[end - 1] not in table:
            found.append((best[end - 1][0] + m.unknown_score, 1 - end, best[end - 1][1] + [m.byte_ids[b] for b in word[end - 1].encode()]))
        best[end] = max(found, key=lambda f: f[:2])[::2]
    return best[len(word)][1]


def test_scores_against_brute_force(scored):
    m, rng = scored, random.Random(2)
    words = sorted({"▁" + "".join(rng.choice("thereandoni▁é日🙂.,-") for _ in range(rng.randrange(0, 12))) for _ in range(400)})
    assert m.segment(words) == [_brute(m, w) for w in words]


def test_merging_against_the_library(m):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["the", "an", "ion", " ", "  ", "é", "日", "🙂", "a", "aa", "\n", "1", "ing", "▁"]) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["Hello, world", "x\ny", "a" * 300, " " * 50, "for (i=0;i<10;i++) {\r\n\t}", ";\r\n"]
    for text, ids in zip(texts, m.encode(texts), strict=True):
        assert ids.tolist() == LIB.encode(text), text
        assert m.decode(ids.tolist()) == LIB.decode(ids.tolist())


def test_round_trips_and_memo(m):
    texts = ["", " ", "  a  b \n c ", "word " * 5000, "z" * 50_000, None, "a▁b", "tab\tx\r\n\x00", "the the the"]
    for t, ids in zip(texts, m.encode(texts), strict=True):
        assert m.decode(ids.tolist()) == (t or "").replace("▁", " ")
    small = pieces.PieceModel(PATH, limit=2)
    for t in ("a b c d", "e f g", "a b c d"):
        assert small.encode([t])[0].tolist() == m.encode([t])[0].tolist()


def test_frames(spark, m):
    rows = [(1, "the cat", 1), (1, "the cat", 1), (2, None, 2), (3, "", 3), (None, "x  y", 4)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = {(r.row.doc_id, r.row.ids): (r.ids, r.decoded) for r in pieces.encode(d, PATH, ["doc_id", "ids"]).collect()}
    assert got[1, 1] == (m.encode(["the cat"])[0].tolist(), "the cat") and got[2, 2] == ([], None)
    assert got[3, 3] == ([], "") and got[None, 4][1] == "x  y"
    assert pieces.encode(d.limit(0), PATH, ["doc_id"]).count() == 0 and pieces.digests(d, PATH).count() == 5
    assert pieces.encoded_documents(d, PATH).columns == ["doc_id", "n_pieces", "ids"]


def test_query(spark, m):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in pieces.op3_sentencepiece(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got.values())
    for r in rows:
        ids = LIB.encode(r.text)
        assert got[r.doc_id].n_pieces == len(ids) and got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<i4").tobytes())
        assert got[r.doc_id].decoded_crc32 == zlib.crc32(r.text.encode())
