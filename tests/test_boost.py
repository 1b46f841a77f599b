import math

import numpy as np
import pytest

from hayrake.operators import boost as bt


def _pairs(s, y, truncation):
    """LambdaRank by its definition, pair by pair."""
    n = len(s)
    order = sorted(range(n), key=lambda i: (-s[i], i))
    rank = {i: k for k, i in enumerate(order)}
    disc = lambda k: 1 / math.log2(k + 2)
    best = sum((2 ** v - 1) * disc(k) for k, v in enumerate(sorted(y, reverse=True)[:truncation]))
    g, h, total = np.zeros(n), np.zeros(n), 0.0
    for a in range(n):
        for b in range(n):
            if y[a] > y[b] and min(rank[a], rank[b]) < truncation and best > 0:
                delta = (2 ** y[a] - 2 ** y[b]) * abs(disc(rank[a]) - disc(rank[b])) / best
                if max(s) != min(s):
                    delta /= 0.01 + abs(s[a] - s[b])
                p = 1 / (1 + math.exp(s[a] - s[b]))
                g[a] -= delta * p
                g[b] += delta * p
                h[a] += delta * p * (1 - p)
                h[b] += delta * p * (1 - p)
                total += 2 * delta * p
    scale = math.log2(1 + total) / total if total > 0 else 1
    return g * scale, h * scale


@pytest.mark.parametrize("truncation", [1, 3, 55])
def test_lambdarank_against_pairs(truncation):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        for ties in (False, True):
            s = rng.integers(0, 3, n).astype(float) if ties else rng.normal(size=n)
            y = (rng.uniform(size=n) < 0.3).astype(float)
            got = bt._lambdarank(s, y, bt.Settings(truncation=truncation), 0)
            want = _pairs(s.tolist(), y.tolist(), truncation)
            assert np.allclose(got, want, atol=1e-12)


def test_other_objectives():
    rng = np.random.default_rng(2)
    s, y = rng.normal(size=9), np.array([1.0, 0, 0, 1, 0, 0, 0, 0, 1])
    step = 1e-6
    for name, loss in (
        ("binary", lambda s: np.sum(np.log1p(np.exp(s)) - y * s)),
        ("xendcg", lambda s: -np.sum((phi := np.exp2(y) - np.random.default_rng(5).uniform(0, 1, 9)) / phi.sum() * (s - np.log(np.exp(s).sum())))),
    ):
        g, _ = bt.OBJECTIVES[name](s, y, bt.Settings(), 5)
        for k in range(9):
            e = np.eye(9)[k] * step
            assert abs((loss(s + e) - loss(s - e)) / (2 * step) - g[k]) < 1e-6, name
    p = bt.Settings(permutations=4, decay=0.5)
    g, h = bt._yetirank(s, y, p, 11)
    want_g, want_h, rng = np.zeros(9), np.zeros(9), np.random.default_rng(11)
    for _ in range(4):
        u = rng.uniform(1e-12, 1, 9)
        order = sorted(range(9), key=lambda i: -(s[i] - math.log(-math.log(u[i]))))
        for k, (a, b) in enumerate(zip(order, order[1:], strict=False)):
            if y[a] != y[b]:
                up, down = (a, b) if y[a] > y[b] else (b, a)
                chance = 0.5**k / 4 / (1 + math.exp(s[up] - s[down]))
                curve = chance * (1 - 1 / (1 + math.exp(s[up] - s[down])))
                want_g[down] += chance
                want_g[up] -= chance
                want_h[[up, down]] += curve
    assert np.allclose(g, want_g) and np.allclose(h, want_h)


def _brute_tree(codes, g, h, p):
    """Leaf by leaf on the rows themselves: the leaf with the greatest gain is split until there are enough."""

    def cut(rows):
        best = (0.0, None)
        gt, ht = g[rows].sum(), h[rows].sum()
        for f in range(codes.shape[1]):
            c = codes[rows, f]
            for b in range(p.bins - 1):
                for missing in (False, True):
                    if missing and not (c == p.bins).any():
                        continue
                    left = np.where(c == p.bins, missing, c <= b)
                    if min(left.sum(), (~left).sum()) < p.least_rows:
                        continue
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    if min(hl, ht - hl) < p.least_hessian:
                        continue
                    gain = gl**2 / (hl + p.l2) + (gt - gl) ** 2 / (ht - hl + p.l2) - gt**2 / (ht + p.l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
        return best

    leaves = [np.arange(len(g))]
    while len(leaves) < p.leaves:
        found = [cut(rows) for rows in leaves]
        k = max(range(len(leaves)), key=lambda i: found[i][0])
        if found[k][1] is None:
            break
        rows, left = leaves.pop(k), found[k][1]
        leaves += [rows[left], rows[~left]]
    out = np.zeros(len(g))
    for rows in leaves:
        out[rows] = -p.rate * g[rows].sum() / (h[rows].sum() + p.l2)
    return out


def _brute_level(codes, g, h, p):
    leaves = [np.arange(len(g))]
    score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p.l2)
    for _ in range(p.levels):
        best = (0.0, None)
        for f in range(codes.shape[1]):
            for b in range(p.bins - 1):
                for missing in (False, True):
                    left = np.where(codes[:, f] == p.bins, missing, codes[:, f] <= b)
                    gain = 0.0
                    for r in leaves:
                        if missing and not (codes[r, f] == p.bins).any():
                            continue
                        gain += max(0.0, score(r[left[r]]) + score(r[~left[r]]) - score(r))
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
        if best[1] is None:
            break
        leaves = [x for r in leaves for x in (r[best[1][r]], r[~best[1][r]])]
    out = np.zeros(len(g))
    for r in leaves:
        out[r] = -p.rate * g[r].sum() / (h[r].sum() + p.l2)
    return out


def _sample(spark, n_groups=24, each=30, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(n_groups):
        for i in range(each):
            a, b, c = rng.normal(), rng.integers(0, 5), rng.uniform()
            y = int(a + 0.3 * b + rng.normal() * 0.3 > 1.2)
            rows.append((f"q{q}", i, float(a) if rng.uniform() > 0.1 else None, float(b), float("nan") if rng.uniform() > 0.9 else float(c), y, 1.0 + (q % 2), q % 3, "x"))
    return spark.createDataFrame(rows, "q string, i int, a double, b double, c double, y int, w double, fold int, grp string").repartition(5, "i")


FEATURES = ["a", "b", "c"]


@pytest.mark.parametrize("more", [{"objective": "lambdarank", "leaves": 6}, {"objective": "binary", "leaves": 5}, {"objective": "yetirank", "levels": 3}, {"objective": "xendcg", "leaves": 4}])
def test_trees_against_brute_force(spark, more):
    p = bt.Settings(trees=3, bins=8, least_rows=5, l2=1.0, rate=0.3, keep=2, **more)
    df = _sample(spark)
    model, table = bt.train(df, "q", "i", FEATURES, "y", "fold", 3, p, "w")
    rows = sorted(df.collect(), key=lambda r: (r.q, r.i))
    values = np.array([[np.nan if getattr(r, f) is None else getattr(r, f) for f in FEATURES] for r in rows])
    for f in range(3):
        v = values[:, f][~np.isnan(values[:, f])]
        assert np.allclose(model.edges[f], np.unique(np.round(np.quantile(v, np.arange(1, 8) / 8), 9)))
    codes = np.array([[8 if np.isnan(v) else sum(e < v for e in model.edges[f]) for f, v in enumerate(row)] for row in values])
    assert (bt.encoded(values, model.edges, 8) == codes).all()
    y, w, q = np.array([r.y for r in rows], float), np.array([r.w for r in rows]), np.array([r.q for r in rows])
    fold = np.array([r.fold for r in rows])
    want = np.zeros(len(rows))
    for m in range(3):
        s = np.zeros(len(rows))
        for t in range(p.trees):
            g, h = np.zeros(len(rows)), np.zeros(len(rows))
            for name in np.unique(q):
                at = q == name
                g[at], h[at] = bt.gradients(s[at], y[at], w[at], p, name, t)
            g, h = np.rint(g * bt.SCALE) / bt.SCALE, np.rint(h * bt.SCALE) / bt.SCALE
            seen = fold != m
            brute = (_brute_level if p.levels else _brute_tree)(codes[seen], g[seen], h[seen], p)
            got = model.folds[m][t].predict(codes, 8)
            assert np.allclose(got[seen], brute, atol=1e-9), (m, t)
            s += got
        want[fold == m] = s[fold == m]
    found = sorted(bt.out_of_fold(model, table).collect(), key=lambda r: (r.grp, r.item))
    assert [(r.grp, r.item, r.y, r.fold) for r in found] == [(r.q, r.i, r.y, r.fold) for r in rows]
    assert np.allclose([r.score for r in found], want, atol=1e-9)


def test_dealing_changes_nothing(spark):
    p = bt.Settings(trees=2, bins=16, leaves=8, least_rows=3)
    df = _sample(spark)
    one, _ = bt.train(df.coalesce(1), "q", "i", FEATURES, "y", "fold", 3, p)
    many, _ = bt.train(df.repartition(11), "q", "i", FEATURES, "y", "fold", 3, p)
    assert [[vars(t) for t in trees] for trees in one.folds] == [[vars(t) for t in trees] for trees in many.folds]


def test_ranking_is_learnt_and_scored(spark):
    p = bt.Settings(trees=15, bins=32, leaves=8, least_rows=5, rate=0.2)
    df = _sample(spark, 30, 40)
    model, table = bt.train(df, "q", "i", FEATURES, "y", "fold", 3, p)
    new = _sample(spark, 10, 40, seed=9)
    scored = bt.score(model, new, ["q", "i", "y"]).collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in scored for b in scored if a.q == b.q and a.y > b.y]
    assert np.mean(pairs) > 0.85
    trees = bt.model_table(spark, model)
    shares = {r.feature: r for r in bt.gain_shares(trees).collect()}
    assert shares["a"].gain > shares["c"].gain
    assert trees.where("feature is null").count() == sum(t.feature.count(-1) for fold in model.folds for t in fold)


def test_edges(spark):
    p = bt.Settings(trees=1, bins=8)
    one = spark.createDataFrame([("q", 1, None, 1.0, 2.0, 0, 1.0, 0, "x"), ("q", 2, None, 1.0, 2.0, 1, 1.0, 0, "x")], _sample(spark).schema)
    model, table = bt.train(one, "q", "i", FEATURES, "y", "fold", 2, p)
    assert [r.score for r in bt.out_of_fold(model, table).collect()] == [0.0, 0.0]
    model, table = bt.train(one.limit(0), "q", "i", FEATURES, "y", "fold", 2, p)
    assert bt.out_of_fold(model, table).count() == 0
    with pytest.raises(ValueError):
        bt.train(one, "q", "i", FEATURES, "y", "fold", 2, bt.Settings(objective="x"))


def test_bin_edges_take_all_rows(spark):
    n = 260_000
    value = "id * 7919 % 260003"
    df = spark.range(n).selectExpr("'q' AS q", "id AS i", f"sqrt({value}) AS a", f"CASE WHEN id % 3 = 0 THEN ({value}) % 40 END AS b", "CASE WHEN id = 5 THEN 2.5 WHEN id % 2 = 0 THEN double('NaN') END AS c", "CAST(NULL AS DOUBLE) AS d")
    at = np.arange(n)
    values = at * 7919 % 260003
    want = {"a": np.sqrt(values), "b": values[at % 3 == 0] % 40, "c": [2.5]}
    found = {}
    for r in bt.bin_edges(df, ["a", "b", "c", "d"], 16).orderBy("feature", "place").collect():
        found.setdefault(r.feature, []).append(r.edge)
        assert r.place == len(found[r.feature]) - 1
    assert sorted(found) == sorted(want)
    for f, v in want.items():
        edges = np.unique(np.round(np.quantile(v, np.arange(1, 16) / 16), 9))
        assert len(found[f]) == len(edges) and np.allclose(found[f], edges, rtol=0, atol=2e-9)


def test_passes_are_dealt_to_tasks(spark):
    p = bt.Settings(trees=3, bins=8, leaves=3, least_rows=3, keep=2)
    _, table = bt.train(_sample(spark).coalesce(1), "q", "i", FEATURES, "y", "fold", 3, p)
    assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_chunks_are_whole_groups(spark, monkeypatch):
    import pyarrow as pa

    sizes, rng = [3, 0, 5, 1, 9], np.random.default_rng(4)
    codes = [[rng.integers(0, 9, 2, np.uint8).tobytes() for _ in range(n)] for n in sizes]
    scores = [rng.normal(size=(3, n)) if n != 5 else None for n in sizes]
    columns = {"grp": list("abcde"), "fold": pa.array(range(5), pa.int32()), "y": [[float(k)] * n for k, n in enumerate(sizes)], "w": [[1.0] * n for n in sizes], "codes": pa.array(codes, pa.list_(pa.binary())), "scores": [None if x is None else x.tobytes() for x in scores]}
    batch = pa.record_batch(columns)
    for held in (1, 4, 8, 100):
        monkeypatch.setattr(bt, "HELD", held)
        found = [(g, f, y[i:j].tolist(), c[i:j].tobytes(), s[:, i:j]) for groups, folds, bounds, y, w, c, s in bt._chunks(batch, 3, 2) for g, f, i, j in zip(groups, folds, bounds, bounds[1:], strict=False)]
        assert [x[:4] for x in found] == [(g, k, [float(k)] * n, b"".join(codes[k])) for k, (g, n) in enumerate(zip("abcde", sizes, strict=True))]
        assert all(np.array_equal(x[4], np.zeros((3, n)) if s is None else s) for x, n, s in zip(found, sizes, scores, strict=True))
