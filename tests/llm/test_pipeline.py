import re
from collections import Counter

import corpus_pipeline as cp
import sentencepiece
from public_tokenizers import path

from tests.llm.test_decontaminate import _brute as hits
from tests.llm.test_line_dedup import _brute as lines
from tests.llm.test_near_join import _brute as near

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 110")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").first().text
    first = docs.first()
    own = " ".join(f"own{k} the and" for k in range(40))
    more = [(1000, "?? 12 !!", "en", "s", 8), (1001, None, "fr", "s", 0), (1002, item, "en", "s", 9), (1003, f"{own}\n{item} {own}", "en", "s", 9), (1004, first.text, first.lang, "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).coalesce(3)
    rows, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    before = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r for r in after.collect()}
        assert len(got) == after.count()
        if k < 4:
            assert after.columns == columns
        if name == "language":
            assert set(rows) - set(got) == {1000, 1001}
        if name == "lines":
            want = lines([(d, r.text) for d, r in rows.items()], 50)
            want = {d: t for (d, old), t in want.items() if t == old or re.search(r"[^\x20\x09-\x0D]", t)}
            assert {d: r.text for d, r in got.items()} == want
        if name == "near_duplicates":
            found, _ = near([(d, r.text) for d, r in rows.items()], 5, 80)
            assert set(got) == {d for d, _, least in found if least == d or least is None}
        if name == "benchmark":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            found = hits([(d, r.text) for d, r in rows.items()], items, 10)
            assert set(got) == {d for d, n, hit, _ in found if hit <= 0.8 * n}
            assert all(got[d].text == rows[d].text for d, n, hit, _ in found if not hit)
            assert all(h == 0 for _, _, h, _ in hits([(d, r.text) for d, r in got.items()], items, 10))
            assert 1003 not in got or item not in got[1003].text
        if name == "pieces":
            lib = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
            assert {d: r.ids for d, r in got.items()} == {d: lib.encode(r.text) for d, r in rows.items()}
        rows, before = got, after


def test_run_covers_documents(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_pieces", "ids"]
    n = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert n and max(n.values()) == 1


def test_stages_take_empty_tables_and_rows_without_text(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    nothing = spark.createDataFrame([], schema)
    blank = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], schema)
    left = {"language": 0, "lines": 3, "near_duplicates": 3, "benchmark": 3, "pieces": 3}
    for name, stage in cp.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name
        assert stage(spark, blank, SF).count() == left[name], name
