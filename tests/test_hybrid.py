"""Operators behind the hybrid queries, against brute force or by hand; every query with SQL against DuckDB on the smallest tables."""

import hashlib
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hayrake.functions import text as tx
from hayrake.operators import evaluation as ev
from hayrake.operators import history, lexical, pool, relational, vectors
from hayrake.plans import blocks, catalog, hybrid
from hayrake.plans import fixtures as fx
from hayrake.sources import tables

SF = "/root/testdata/sf0.1"


def test_context_keys_keep_fields_apart_and_escape_as_json(spark):
    rows = [(None, "a"), ("a", None), ('q"\\', "tab\t nl\n \x01\x1f é"), ("", "\b\f\r/")]
    d = spark.createDataFrame(rows, "x string, y string")
    got = [r[0] for r in d.select(tx.context_key("x", "y")).collect()]
    want = [hashlib.sha256(json.dumps([a or "", b or ""], ensure_ascii=False).encode()).hexdigest()[:24] for a, b in rows]
    assert got == want and len(set(got)) == 4


def test_truth_equals_contains_on_whole_tables(spark):
    got = {tuple(r) for r in fx.truth(spark, SF).collect()}
    sql = f"SELECT item_id, doc_id FROM '{SF}/benchmark.parquet' b JOIN '{SF}/documents.parquet' d ON contains(d.text, b.text)"
    assert got == set(duckdb.sql(sql).fetchall()) and got


def test_holders_of_odd_passages(spark):
    p = [(1, "one two three four five six"), (2, "x"), (3, ""), (4, "a  b\nc d e"), (5, "two three"), (6, None)]
    d = [(1, "zone two three four five sixty"), (2, "xa  b\nc d ef"), (3, None), (4, "one two\nthree four five six"), (5, "a b c d e")]
    a, b = spark.createDataFrame(p, "q long, t string"), spark.createDataFrame(d, "i long, b string")
    got = {tuple(r) for r in fx.holders(a, "q", "t", b, "i", "b").collect()}
    assert got == {(q, i) for q, t in p for i, x in d if t and x and t in x}


def test_top_of_any_and_wide_scores(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9)], "q long, i long, score double")
    b = spark.createDataFrame([(1, 3, 0.1)], "q long, i long, score double")
    blank = spark.createDataFrame([(1, 0), (1, 1)], "q long, i long")
    wide = pool.wide_scores({"a": a, "b": b}, "q", "i", blank)
    assert {(r.i, r.a, r.b) for r in wide.collect()} == {(0, 0.0, 0.0), (1, 0.5, 0.0), (2, 0.9, 0.0), (3, 0.0, 0.1)}
    assert {r.i for r in pool.top_of_any(wide, "q", "i", ["a", "b"], 1).collect()} == {2, 3}
    assert {r.i for r in pool.top_of_any(wide, "q", "i", ["b"], 3).collect()} == {3, 0, 1}
    assert {r.i for r in pool.top_of_any(wide, "q", "i", ["b"], 3, positive=True).collect()} == {3}


def test_place_aware_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = np.random.default_rng(0)
    items, queries, bias = rng.normal(size=(50, 4)), rng.normal(size=(7, 4)), rng.normal(size=(2, 3))
    i = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(items)], "id long, v array<double>, g int").repartition(4)
    q = spark.createDataFrame([(f"q{k}", v.tolist(), k % 2) for k, v in enumerate(queries)], "q string, v array<double>, qg int")
    b = spark.createDataFrame([(x, y, float(bias[x, y])) for x in range(2) for y in range(3)], "qg int, g int, bias double")
    for extra in (False, True):
        got = vectors.text_key_topk(i, "id", q, "q", "v", 5, *([b, "qg", "g"] if extra else [])).collect()
        for k in range(7):
            s = np.round(items @ queries[k], 9) + (bias[k % 2][np.arange(50) % 3] if extra else 0)
            assert [r.id for r in sorted(got, key=lambda r: r.place) if r.q == f"q{k}"] == sorted(range(50), key=lambda n: (-round(s[n], 9), n))[:5]
    assert vectors.text_key_topk(i, "id", q.limit(0), "q", "v", 5).count() == 0
    ask = lambda: sorted(map(tuple, vectors.text_key_topk(i, "id", q, "q", "v", 5).collect()))
    want = ask()
    monkeypatch.setattr(vectors, "MOST", 3)  # several passes, the same answers
    assert ask() == want


def test_group_sample(spark):
    rows = [(1, k, int(k in (3, 40)), float(-k), float(k)) for k in range(60)]
    d = spark.createDataFrame(rows, "q long, i long, y int, a double, b double")
    got = {r.i: r.kind for r in history.group_sample(d, "q", "i", {"a": 4, "b": 3}, 5, 1).collect()}
    assert {k for k, v in got.items() if v == "positive"} == {3, 40}
    assert {k for k, v in got.items() if v == "hard"} == {0, 1, 2, 4, 59, 58, 57}
    assert sum(v == "tail" for v in got.values()) == 5 and len(got) == 14


def test_leaks_are_counted_and_raised(spark):
    h = spark.createDataFrame([("t1", "c1"), ("t2", "c2")], "t string, c string")
    bad, good = h.where("t = 't1'"), h.where("t = 'zz'")
    assert tuple(history.leaks(h, t=bad, c=good).first()) == (1, 0)
    assert history.assert_no_leak(h, t=good, c=good).count() == 2
    with pytest.raises(Exception, match="blocked"):
        history.assert_no_leak(h, t=bad).collect()


def test_missing_keys_are_encoded_once(spark):
    seen = []
    stored = spark.createDataFrame([("a", 1), ("z", 2)], "k string, v int")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")

    def encode(df):
        seen.extend(r.k for r in df.collect())
        return df.withColumn("v", F.lit(9))

    assert sorted(map(tuple, vectors.with_missing(wanted, stored, "k", encode).collect())) == [("a", 1), ("b", 9)] and seen == ["b"]


def test_misaligned_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x long")
    assert tuple(relational.misaligned(a, b).first()) == (1, 1) and tuple(relational.misaligned(a, a).first()) == (0, 0)


def test_hashed_vectors_have_unit_length(spark):
    d = spark.createDataFrame([("ab cd ab",), ("x",), ("",)], "t string")
    sums = {(r.t, r.kind): r.s for r in lexical.hashed_vectors(d, "t").groupBy("t", "kind").agg(F.sum("w").alias("s")).collect()}
    assert set(sums) == {("ab cd ab", "char"), ("ab cd ab", "word"), ("x", "char"), ("x", "word")} and all(math.isclose(s, 1) for s in sums.values())
    words = lexical.hashed_vectors(d, "t").where("kind = 'word' AND t = 'ab cd ab'").collect()
    assert sorted(r.w for r in words) == [0.2, 0.2, 0.2, 0.4]


def test_class_metrics(spark):
    truth = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "c", 2)], "q long, c string, n long")
    p = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.4), (1, "c", 0.0), (2, "a", 1.0), (2, "c", 0.0)], "q long, c string, p double")
    r = ev.class_metrics(truth, p, "q", "c", [1, 2]).first()
    assert (r.recall_1, r.recall_2, r.unseen_share) == (0.375, 1.0, 0.5)
    assert math.isclose(r.nll, ((3 * -math.log(0.6) - math.log(0.4)) / 4 - math.log(1e-8)) / 2)


def test_staged_tables_need_a_shared_folder(spark):
    d = spark.range(5)
    assert tables.staged(d, "t").count() == 5


def test_json_csv_and_large_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\n\"b"), (2, None)], "k int, v string").repartition(2)
    path = tables.write_json(d, str(tmp_path / "j"))
    assert sorted(map(tuple, tables.read_json(spark, path, "k int, v string").collect())) == [(1, 'a\n"b'), (2, None)]
    one = tables.write_csv(d.select("k"), str(tmp_path / "c"), single=True)
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1 and spark.read.csv(one, header=True).count() == 2
    p = tables.write_parquet(spark.range(20_000), str(tmp_path / "p"), codec="none")
    assert not tables.rewrite_if_large(spark, p) and tables.rewrite_if_large(spark, p, most=10) and spark.read.parquet(p).count() == 20_000


NAMES = [
    "baseline_score_full", "pool_hybrid_9", "class_transfer_full", "class_recall_nll", "leakage_assertions", "context_sample", "query_labels",
    "hashed_text_features", "composite_key", "encode_on_miss", "answer_validation", "bootstrap_ci", "table_digest", "compound_purge", "history_unseen_text",
]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    import glob
    import os

    import __spark_entry__ as e

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in glob.glob(folder + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = e.queries()[name](spark, folder)
    found = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = sorted(found.fetchall(), key=str)
    assert len(got) == len(want) and got
    assert list(map(str, got)) == list(map(str, want))


def test_more_queries_than_one_pass_takes(spark, monkeypatch):
    rng = random.Random(6)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    items = spark.createDataFrame([(i, vec()) for i in range(60)], "i long, v array<double>")
    asked = spark.createDataFrame([(f"q{i}", vec()) for i in range(40)], "q string, v array<double>")
    ask = lambda: sorted(map(tuple, vectors.text_key_topk(items, "i", asked, "q", "v", 5).collect()))
    want = ask()
    monkeypatch.setattr(vectors, "CELLS", 50)
    assert ask() == want and len(want) == 200


def test_growing_tables_are_not_collected_for_joins(spark):
    catalog.queries()
    d = "/root/testdata/sf0.001"
    pairs = spark.range(100).select(F.col("id").alias("item_id"))
    for df in (hybrid.past(spark, d), pairs.join(hybrid.Search(spark, d).listed("item_id", "micro"), "item_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # of the interactions' joins only that with the suppliers is left to the planner
    assert fx.interactions(spark, d)._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 3


def test_scores_of_distinct_texts_are_those_of_all_items(spark):
    texts = [("red bolt", 3), ("red ring", 1), ("old bolt bolt", 2), ("blue", 1)]
    each = [(10 * k + i, t) for k, (t, n) in enumerate(texts) for i in range(n)]
    docs = spark.createDataFrame(each, "item_id long, text string").withColumn("terms", F.split("text", " "))
    once = spark.createDataFrame(texts, "text string, copies long").withColumn("terms", F.split("text", " "))
    q = spark.createDataFrame([("a", ["red", "bolt"]), ("b", ["old", "blue", "none"])], "query_id string, q_terms array<string>")
    per_item = lexical.bm25_scores(docs, "item_id", "terms", q, "query_id", "q_terms").join(docs.select("item_id", "text"), "item_id")
    per_text = lexical.bm25_scores(once, "text", "terms", q, "query_id", "q_terms", copies="copies")
    assert {(r.query_id, r.text): r.score for r in per_item.collect()} == {(r.query_id, r.text): r.score for r in per_text.collect()}
    w_item, idf_item = lexical.tfidf_vectors(docs, "item_id", "terms", cap=None)
    w_text, idf_text = lexical.tfidf_vectors(once, "text", "terms", cap=None, copies="copies")
    assert sorted(idf_item.collect()) == sorted(idf_text.collect())
    want = {(r.text, r.term): round(r.w, 12) for r in w_item.join(docs.select("item_id", "text"), "item_id").collect()}
    assert want == {(r.text, r.term): round(r.w, 12) for r in w_text.collect()}


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    catalog.queries()
    d = "/root/testdata/sf0.001"
    plan = catalog._best(spark, d, 50)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("query_id" in line and "item_id" in line for line in exchanges)
    all_scores = lexical.channel_scores(catalog._channels(spark, d), "item_id", "query_id")
    some = all_scores.select("query_id", "item_id").where("item_id % 7 = 0")
    again = lexical.channel_scores(catalog._channels(spark, d), "item_id", "query_id", some)
    assert sorted(again.collect()) == sorted(all_scores.where("item_id % 7 = 0").collect())
    body = all_scores.where("channel = 'b'").select("query_id", "item_id", "score")
    assert sorted(body.collect()) == sorted(catalog._body(spark, d).select("query_id", "item_id", "score").collect())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_of_candidates_are_not_collected_for_a_broadcast(spark):
    x = hybrid.Search(spark, "/root/testdata/sf0.001")
    frames = {"marked": x._marked(), "covers": x._covers(), "frame": hybrid.lexical_frame(x), "structural": blocks.structural(x), "places": blocks.context_geo(x)}
    for name, df in frames.items():
        for line in _plan(df).splitlines():
            assert not ("BroadcastHashJoin" in line and "item_id" in line), (name, line[:200])


def test_history_is_read_once_and_counted(spark):
    x = hybrid.Search(spark, "/root/testdata/sf0.001")
    assert {tuple(r) for r in x.counted("query_norm", "micro").collect()} == {tuple(r) for r in x.fit.groupBy("query_norm", "micro").count().collect()}
    for df in (blocks.context_geo(x), hybrid.neighbour_classes(x), hybrid.lexical_frame(x)):
        assert "search-past" not in " ".join(df.inputFiles())


def test_vectors_of_pairs_equal_those_of_items(spark):
    x = hybrid.Search(spark, "/root/testdata/sf0.001")
    pairs = x.hybrid_pool.select("query_id", "item_id")
    want = pairs.join(x.vectors(3)[1], "item_id").select("query_id", "item_id", "embedding")
    got = x.with_vectors(pairs, "embedding", 3).select("query_id", "item_id", "embedding")
    assert got.count() == pairs.count() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_blocks_of_the_whole_frame_are_stage_tables(spark):
    x = hybrid.Search(spark, "/root/testdata/sf0.001")
    frame = blocks.whole_frame(x)
    assert len(frame.columns) == 106 and "Broadcast" not in _plan(frame)
    folders = {f.rpartition("/")[0] for f in frame.inputFiles()}
    assert len(folders) == len(blocks.BLOCKS) and all("search-block" in f for f in folders)


def test_keys_of_any_are_the_rows_of_top_of_any(spark):
    wide = spark.createDataFrame([(1, i, float(i % 4), float(i % 7)) for i in range(30)], "q long, i long, a double, b double")
    got = {tuple(r) for r in pool.keys_of_any(wide, "q", "i", ["a", "b"], 3).collect()}
    assert got == {(r.q, r.i) for r in pool.top_of_any(wide, "q", "i", ["a", "b"], 3).collect()} == {(1, 3), (1, 7), (1, 11), (1, 6), (1, 13), (1, 20)}


def test_items_of_a_corpus_are_not_collected_to_check_answers(spark):
    answers = spark.createDataFrame([("a", "1 2 9"), ("b", "1 1")], "q string, answer string")
    found = ev.validate(answers, spark.createDataFrame([("a",), ("c",)], "q string"), spark.range(5).withColumnRenamed("id", "i"), "q", "i", 2)
    r = found.first()
    assert (r.unknown, r.too_many, r.repeated_ids, r.missing_queries, r.foreign_queries) == (1, 1, 1, 1, 1)
    assert "SortMergeJoin [id#" in _plan(found)
