import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hayrake.llm import token_store as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_encode_as_the_whole_text():
    tok, lib = ts.MemoTokenizer(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "a", " a", "a ", "a  b", "x   foo  bar", " lead", "\u00e9 b", "a \n b\n\nc", "x y z", "Hello, world's 123 été", "\tq r\t", "a\x1c b", "日本 語 🙂", "ſpecial don't we'll 3² a<|endoftext|>b <|endoftext|>", "ǅ ʼn ×÷ a\xad b\xa0c d"]
    for text, got in zip(texts, tok.encode(texts), strict=True):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("limit", [5, 8, 20])
def test_lengths_are_limited_and_complete(limit):
    weights = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987])
    bits = ts.limited_lengths(weights, limit)
    assert bits.max() <= limit and (0.5**bits).sum() == 1.0
    if limit == 20:
        import heapq

        heap, cost = sorted(weights.tolist()), 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert (bits * weights).sum() == cost


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        values = (rng.pareto(0.6, n) * 3).astype(np.int64) % 3000
        ids, count = np.unique(values, return_counts=True)
        bits = ts.limited_lengths(count)
        code_of, bits_of = np.zeros(3000, np.int64), np.zeros(3000, np.int64)
        code_of[ids], bits_of[ids] = ts.canonical_codes(ids, bits), bits
        marks, payload = ts.pack(values, code_of, bits_of)
        assert len(payload) == (int(bits_of[values].sum()) + 7) // 8
        assert (ts.unpack(marks, payload, n, *ts.lookup_table(ids, bits)) == values).all()


def _brute(rows):
    lib, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_against_brute_force(spark, tmp_path):
    rows = [(3, "b c"), (1, None), (1, "a  x"), (2, ""), (2, ""), (None, "null id"), (9, "word " * 3000), (7, "é ü")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, file_no string, n int")
    path = ts.write_store(docs, str(tmp_path / "s"), PATH)
    got = ts.with_global_start(spark, path, ts.read_store(spark, path))
    key = lambda r: r[1]
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=key) == sorted(_brute(rows), key=key)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    path = ts.write_store(docs, str(tmp_path / "s"), PATH)
    assert ts.with_global_start(spark, path, ts.read_store(spark, path)).count() == 0


def test_query_covers_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in ts.op1_token_store(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == set(_brute(rows))


def test_words_are_pieces_of_the_whole_text():
    tok, lib, rng = ts.MemoTokenizer(PATH, limit=300), Tokenizer.from_file(PATH), np.random.default_rng(3)
    parts = ["a", "B", "the", "é", "ß", "1", "²", ".", ",", "'s", "'S", "'ll", "-", "\n", " ", "  ", "\n\n", "\t", "&&&", "\xa0", "ü", "日", "'", "_", "\r", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(6000)]
    for lo in range(0, len(texts), 300):
        for t, got in zip(texts[lo : lo + 300], tok.encode(texts[lo : lo + 300]), strict=True):
            assert got.tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert len(tok.memo.words) < 2000


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "prefixed.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    tok, lib = ts.MemoTokenizer(str(path)), Tokenizer.from_file(str(path))
    assert not tok.by_word
    for t, got in zip(["x y", "", "a  b"], tok.encode(["x y", "", "a  b"]), strict=True):
        assert got.tolist() == lib.encode(t, add_special_tokens=False).ids
