import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from hayrake.operators import classes as cl
from hayrake.operators import neural as nn

TEXTS = {"a": "x x y", "b": "y z", "c": "x", "d": "w w w z", "e": "q"}
TARGETS = [("a", "P", 1.5), ("a", "Q", 0.5), ("b", "Q", 1.0), ("c", "P", 1.0), ("d", "R", 0.25)]


def test_bayes_against_brute_force(spark):
    texts = spark.createDataFrame(list(TEXTS.items()), "key string, text string")
    inputs = cl.term_shares(texts, "key", {"w": (F.split("text", " "), 1.0), "h": (F.transform(F.split("text", " "), lambda t: F.lit("t")), 0.5)})
    x = {k: {**{f"w:{t}": n / len(v.split()) for t, n in Counter(v.split()).items()}, "h:t": 0.5} for k, v in TEXTS.items()}
    assert {(r.key, r.term): round(r.x, 12) for r in inputs.collect()} == {(k, t): round(v, 12) for k in x for t, v in x[k].items()}
    seen = inputs.where("key <> 'e'")
    targets = spark.createDataFrame(TARGETS, "key string, micro string, weight double")
    found = cl.bayes_probabilities(inputs, cl.fit_bayes(seen, targets, "key", "micro", 0.1), "key", "micro")
    mass, evidence = defaultdict(Counter), Counter()
    for k, c, w in TARGETS:
        evidence[c] += w
        for t, v in x[k].items():
            mass[c][t] += w * v
    vocabulary = {t for k in "abcd" for t in x[k]}
    want = {}
    for k in x:
        own = {c: math.log(evidence[c] / sum(evidence.values())) + sum(v * math.log((mass[c][t] + 0.1) / (sum(mass[c].values()) + 0.1 * len(vocabulary))) for t, v in x[k].items() if t in vocabulary) for c in evidence}
        total = sum(math.exp(v) for v in own.values())
        want |= {(k, c): math.exp(v) / total for c, v in own.items()}
    got = {(r.key, r.micro): r.p for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def _slope(loss, w, at, step=1e-6):
    e = np.zeros_like(w)
    e[at] = step
    return (loss(w + e) - loss(w - e)) / (2 * step)


def test_perceptron_gradients_against_differences():
    rng = np.random.default_rng(1)
    weights = [rng.normal(size=s) for s in ((5, 4), (4,), (4, 3), (3,))]
    x, w = rng.normal(size=(6, 5)), rng.uniform(1, 2, 6)
    target = rng.dirichlet(np.ones(3), 6)
    drop = (rng.uniform(size=(6, 4)) > 0.3) / 0.7
    _, gradients = nn.perceptron_gradients(weights, x, target, w, drop)
    for k, g in enumerate(gradients):
        for at in np.ndindex(g.shape):
            loss = lambda v, k=k: nn.perceptron_gradients([*weights[:k], v, *weights[k + 1 :]], x, target, w, drop)[0]
            assert abs(_slope(loss, weights[k], at) - g[at]) < 1e-5


def test_projection_gradients_against_differences():
    rng = np.random.default_rng(2)
    q, d = rng.normal(size=(7, 4)), rng.normal(size=(7, 4))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    same = np.eye(7)
    same[0, 3] = same[3, 0] = 1
    p = np.eye(4) + 0.1 * rng.normal(size=(4, 4))
    _, g = nn.projection_gradients(p, q, d, same, 0.5, 0.2)
    for at in np.ndindex(4, 4):
        assert abs(_slope(lambda v: nn.projection_gradients(v, q, d, same, 0.5, 0.2)[0], p, at) - g[at]) < 1e-5


def test_perceptron_learns_soft_labels(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{i}", f"{'sun' if i % 2 else 'tax'} {rng.choice(['a', 'b', 'c'])}") for i in range(80)]
    inputs = cl.term_shares(spark.createDataFrame(rows, "key string, text string"), "key", {"w": (F.split("text", " "), 1.0)})
    targets = spark.createDataFrame([(k, c, s, s * 2) for i, (k, _) in enumerate(rows[:60]) for c, s in ((("P", 0.75), ("Q", 0.25)) if i % 2 else (("Q", 1.0),))], "key string, micro string, share double, weight double")
    table = nn.perceptron_rows(inputs, targets, "key", "micro", ["P", "Q"], 64)
    one = nn.fit_perceptron(table.repartition(3), ["P", "Q"], 64, hidden=8, steps=60, rate=0.05, dropout=0.1)
    two = nn.fit_perceptron(table.coalesce(1), ["P", "Q"], 64, hidden=8, steps=3, rate=0.05, dropout=0.1)
    assert one.losses[-1] < 0.6 * one.losses[0] and np.allclose(two.losses, one.losses[:3], atol=1e-6)
    p = {(r.key, r.label): r.p for r in nn.perceptron_probabilities(one, table, 64).collect()}
    assert len(p) == 160
    # texts that had no targets, too
    assert all(abs(p[f"t{i}", "P"] - (0.75 if i % 2 else 0.0)) < 0.15 for i in range(60, 80))


def test_projection_learns_a_turn(spark):
    rng = np.random.default_rng(4)
    d = rng.normal(size=(120, 6))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    q = d @ turn.T + 0.05 * rng.normal(size=d.shape)
    pairs = spark.createDataFrame([(i, i, q[i].tolist(), d[i].tolist()) for i in range(100)], "query int, item int, q array<double>, d array<double>")
    p, losses = nn.fit_projection(nn.projection_blocks(pairs, 32), 6, steps=40, rate=0.05, teacher=0.01)
    assert losses[-1] < 0.5 * losses[0]
    hit = lambda m: np.mean(np.argmax(q[100:] @ m @ d.T, 1) == np.arange(100, 120))
    assert hit(p) > hit(np.eye(6)) + 0.3
    moved = nn.projected(pairs.where("query < 3"), "q", p).orderBy("query").collect()
    want = q[:3] @ p
    assert np.allclose([r.q for r in moved], want / np.linalg.norm(want, axis=1, keepdims=True))
