import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hayrake.operators import boost, evaluation, history, learn, pool
from hayrake.plans import ranking as rk


def _lists(spark, seed, n=40, each=60):
    """Queries whose scale differs: what counts is where a candidate stands in its own list."""
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(n):
        a, b = rng.normal(size=each) + rng.normal() * 3, rng.uniform(size=each)
        value = (a - a.mean()) + 2 * b + rng.normal(size=each) * 0.5
        best = set(np.argsort(-value)[:4].tolist())
        rows += [(f"q{q}", i, f"text {q}", float(a[i]), float(b[i]), float(a[i] - a.max()), int(i in best), q % 3) for i in range(each)]
    return spark.createDataFrame(rows, "query_id string, item_id int, query_norm string, a double, b double, gap double, y int, fold int")


FEATURES = ["a", "b", "gap"]


def _ndcg(scored, rows, k=10):
    ranked = pool.stable_topk(scored.select("query_id", "item_id", F.round("score", 9).alias("score")), k, "query_id", "item_id")
    return evaluation.ndcg(ranked, rows.where("y = 1").select("query_id", "item_id"), "query_id", "item_id", k).agg(F.avg("ndcg")).first()[0]


def test_listwise_above_pointwise(spark):
    rows = _lists(spark, 1).cache()
    p = boost.Settings(trees=20, leaves=8, rate=0.2, least_rows=10)
    model, _ = boost.train(rows, "query_id", "item_id", FEATURES, "y", "fold", 3, p)
    listwise = _ndcg(boost.score(model, rows, ["query_id", "item_id"], "fold"), rows)
    parts = [learn.score(learn.fit_ranker(rows.where(F.col("fold") != k), FEATURES, weight=None, trees=20, depth=3), rows.where(F.col("fold") == k)) for k in range(3)]
    pointwise = _ndcg(parts[0].unionByName(parts[1]).unionByName(parts[2]), rows)
    assert listwise > pointwise - 0.01 and listwise > 0.75, (listwise, pointwise)


def test_ndcg(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)], "q string, i int, place int")
    truth = spark.createDataFrame([("a", 1), ("a", 3), ("a", 9), ("b", 5)], "q string, i int")
    got = {r.q: r.ndcg for r in evaluation.ndcg(ranked, truth, "q", "i", 3).collect()}
    ideal = sum(1 / np.log2(k + 1) for k in (1, 2, 3))
    assert abs(got["a"] - (1 + 0.5) / ideal) < 1e-12 and got["b"] == 0


def test_mining_by_text(spark):
    rows = _lists(spark, 2, 30, 700)
    first = history.group_sample(rows, "query_id", "item_id", {"a": 20}, 20, 7).drop("kind")
    found, scores = rk.mined(rows, first, FEATURES, trees=3, leaves=4)
    assert len(scores) == 2
    # the selection, given the scores of the last round
    scored = scores[-1].toArrow()  # noqa: F841
    order = "sha256('{}:' || query_id || '/' || item_id::VARCHAR)".format(rk.SEED)
    want = duckdb.sql(f"""SELECT query_id, item_id, CASE WHEN y = 1 THEN 'positive' WHEN n <= 400 THEN 'hard' ELSE 'tail' END FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, y = 0 AND n > 400 ORDER BY {order}, item_id) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, y ORDER BY score DESC, item_id) AS n FROM scored)) WHERE y = 1 OR n <= 400 OR k <= 96""").fetchall()
    assert sorted(tuple(r) for r in found.select("query_id", "item_id", "kind").collect()) == sorted(want)
    fixed = history.group_sample(rows, "query_id", "item_id", {"a": 400}, 96, rk.SEED).select("query_id", "item_id", "kind")
    assert found.select("query_id", "item_id", "kind").exceptAll(fixed).count() > 0


def test_a_text_in_two_folds_is_an_error(spark):
    rows = spark.createDataFrame([("t", 0), ("t", 1), ("u", 2)], "query_norm string, fold int")
    assert history.assert_apart(rows.where("fold <> 1"), "query_norm", "fold").count() == 2
    with pytest.raises(Exception, match="several folds"):
        history.assert_apart(rows, "query_norm", "fold").collect()


def test_whole_frame_has_104_columns(spark):
    from hayrake.plans import blocks
    from hayrake.plans.hybrid import Search

    x = Search(spark, "/root/testdata/sf0.001")
    frame = blocks.whole_frame(x)
    assert len(frame.columns) == 106 and len(set(frame.columns)) == 106
    assert frame.count() == x.hybrid_pool.count() == frame.select("query_id", "item_id").distinct().count()
