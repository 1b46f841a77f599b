import numpy as np
import pytest

from hayrake.operators import asked, best, history, lexical, pool, vectors
from hayrake.plans import catalog

D = "/root/testdata/sf0.001"


def _tables(spark):
    docs = spark.createDataFrame([(k, [f"w{(k * j) % 11}" for j in range(k % 7)]) for k in range(60)], "id long, terms array<string>").repartition(3)
    q = spark.createDataFrame([(n, [f"w{n}", f"w{n + 3}", "none", f"w{n}"]) for n in range(9)], "q long, q_terms array<string>")
    words = q.selectExpr("q", "explode(array_distinct(q_terms)) as term", "1.0D as w")
    terms = asked.vocabulary(words.select("term"))
    return docs, q, words, asked.bm25_postings(asked.counts(docs, "id", "terms", terms), "id", terms)


@pytest.mark.parametrize("cells, entries, piece", [(1 << 22, 1 << 22, 8 << 20), (4, 5, 1)])
def test_block_scores_equal_joins(spark, monkeypatch, cells, entries, piece):
    monkeypatch.setattr(asked, "CELLS", cells)
    monkeypatch.setattr(asked, "ENTRIES", entries)
    monkeypatch.setattr(asked, "PIECE", piece)
    docs, q, words, index = _tables(spark)
    whole = lexical.bm25_scores(docs, "id", "terms", q, "q", "q_terms")
    want = sorted(map(tuple, whole.collect()))
    got = sorted(map(tuple, asked.scores(index, "id", words, "q", 7).collect()))
    assert got == want and want
    cut = lambda x: sorted(map(tuple, pool.stable_topk(x, 3, "q", "id").select("q", "id", "score").collect()))
    assert cut(asked.scores(index, "id", words, "q", 7, 3)) == cut(whole)
    some = whole.where("id % 3 = 0")
    assert sorted(map(tuple, asked.pair_scores(index, "id", words, "q", some, 7).collect())) == sorted(map(tuple, some.collect()))


def test_bodies_are_scored_without_a_shuffle(spark):
    plan = catalog._body(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_a_query_without_known_words_and_no_documents(spark):
    docs, _, words, index = _tables(spark)
    assert asked.scores(index, "id", words.where("term = 'none'"), "q", 7, 3).count() == 0
    none = asked.bm25_postings(asked.counts(docs.limit(0), "id", "terms", index.terms), "id", index.terms)
    assert asked.scores(none, "id", words, "q", 7).count() == 0


def test_sample_candidates_choose_as_all_pairs_do(spark):
    rows = [(q, k, float((k * 37) % 101)) for q in range(3) for k in range(400 if q else 12)]
    whole = spark.createDataFrame(rows, "q long, id long, score double")
    truth = spark.createDataFrame([(q, k) for q in range(3) for k in range(0, 9, 2)], "q long, id long")

    def scores(k=None, pairs=None, queries=None):
        out = whole if pairs is None else whole.join(pairs, ["q", "id"], "left_semi")
        out = out if queries is None else out.join(queries, "q", "left_semi")
        return out if k is None else pool.stable_topk(out, k, "q", "id").drop("place")

    marked = whole.join(truth.selectExpr("q", "id", "1 as y"), ["q", "id"], "left").na.fill(0, ["y"])
    pick = lambda x: sorted(map(tuple, history.group_sample(x, "q", "id", {"score": 5}, 4, 7).select("q", "id", "y", "kind").collect()))
    found = history.sample_candidates(scores, "q", "id", truth, 5, 4, 7)
    assert pick(found) == pick(marked) and found.count() < whole.count()


def test_best_keeps_ties_by_key_and_bounds_what_waits(monkeypatch):
    monkeypatch.setattr(best, "WAITING", 10)
    rng = np.random.default_rng(1)
    s, keys = rng.integers(0, 5, (4, 300)).astype(float), rng.permutation(300)
    kept = best.Best(4, 6)
    for lo in range(0, 300, 7):
        kept.add(0, s[:, lo : lo + 7], keys[lo : lo + 7])
        assert kept.waiting <= kept.most + 4 * 7
    q, key, _ = kept.cut()
    for n in range(4):
        assert key[q == n].tolist() == keys[np.lexsort((keys, -s[n]))[:6]].tolist()


def test_vector_search_multiplies_pieces_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 3)
    items = spark.createDataFrame([(k, [float(k % 4), 1.0]) for k in range(25)], "id long, v array<float>").coalesce(1)
    got = vectors.exact_topk(items, "id", items.where("id < 6").withColumnRenamed("id", "q"), "q", "v", 4, True).collect()
    seen = [(r.q, r.id) for r in sorted(got, key=lambda r: (r.q, r.place))]
    assert seen[4:8] == [(1, 3), (1, 7), (1, 11), (1, 15)] and len(seen) == 24



def test_grams_and_passages_in_tasks_equal_joins(spark, monkeypatch):
    from pyspark.sql import functions as F

    from hayrake.functions.text import char_grams, word_grams
    from hayrake.plans import fixtures as fx

    rows = [(0, "a bc def a"), (1, ""), (2, "bc def ghijk bc"), (3, "ghijk a"), (4, "ñé bc")]
    docs = spark.createDataFrame(rows, "id long, t string").select("id", F.filter(F.split("t", " "), lambda w: w != "").alias("words"))
    for r in docs.select(F.array_join("words", " ").alias("t"), char_grams(F.array_join("words", " ")).alias("g")).collect():
        assert r.g == [g for w in r.t.split() for g in word_grams(w)]
    idf = lexical.gram_idf(docs, "words")
    terms = asked.vocabulary(idf.where("term like '%b%' or term like '%a%'").select("term"))
    get = lambda: sorted((r.id, c, round(w, 12)) for r in lexical.gram_postings(docs, "id", "words", idf, terms).collect() for c, w in zip(r.codes, r.ws, strict=True))
    here = get()
    monkeypatch.setattr(lexical, "WORDS", 0)
    assert get() == here and here

    texts = spark.createDataFrame([(0, "x one two three four y"), (1, "one two three"), (2, "zone two three fours"), (3, None), (4, "two one two\nthree one two three four")], "id long, body string")
    asks = spark.createDataFrame([(0, "one two three four"), (1, "one two three four five"), (2, "two three"), (3, ""), (4, "ne two three fou"), (5, "a b c d e")], "q long, p string")
    find = lambda: sorted(map(tuple, fx.holders(asks, "q", "p", texts, "id", "body").collect()))
    near = find()
    monkeypatch.setattr(fx, "ANCHORS", 0)
    assert find() == near
    brute = sorted((a.q, t.id) for a in asks.collect() for t in texts.collect() if a.p and t.body and a.p in t.body)
    assert near == brute
