import random
import re

import numpy as np

from hayrake.llm import near_join as nj


def _set(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _brute(docs, width, percent):
    """Least doc_id of each row's component; rows are (doc_id, text)."""
    sets = [_set(t, width) for _, t in docs]
    top = list(range(len(docs)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return [(d, len(sets[k]), least.get(root(k))) for k, (d, _) in enumerate(docs)], len({root(k) for k, s in enumerate(sets) if s})


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for percent in (80, 85, 95):
        for n in (1, 2, 5, 6, 7, 9, 12, 13, 20, 37, 60, 150, 400, 2500):
            for _ in range(12):
                a = rng.integers(0, 1 << 62, n).astype(np.uint64)
                drop = rng.integers(0, n + 1)
                add = rng.integers(0, n + 1)
                while 100 * (n - drop) < percent * (n + add):
                    drop, add = max(0, drop - 1) if rng.random() < 0.5 else drop, max(0, add - 1) if rng.random() < 0.5 else add
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, add).astype(np.uint64)]))
                assert np.intersect1d(nj.signatures(np.unique(a), percent), nj.signatures(b, percent)).size, (percent, n, drop, add)


def _family(rng, n, words, change):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    return [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < change else w for w in base) for _ in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(7)
    texts = [t for words, change in ((6, 0.1), (15, 0.05), (60, 0.02), (60, 0.05), (200, 0.03), (400, 0.01)) for t in _family(rng, 14, words, change)]
    texts += ["", None, "a", "A", "a b", "a  B\n", "a b c", "the same old words", "The SAME old words", " \t", "é é é é é", "long " * 20000, "long " * 20000]
    docs = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    docs += [docs[3], (docs[4][0], "other text for a taken id"), (None, texts[0])]
    d = spark.createDataFrame([(*r, 1, b"z") for r in docs], "doc_id bigint, text string, comp int, text_hash binary").repartition(3)
    for width, percent in ((4, 85), (5, 80)):
        found = nj.groups(d, width, percent)
        least = {r.comp: r.m for r in found.where("comp is not null").groupBy("comp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "m").collect()}
        got = sorted(((r.doc_id, r.n_shingles, least[r.comp] if r.comp is not None else r.doc_id) for r in found.collect()), key=str)
        assert got == sorted(_brute(docs, width, percent)[0], key=str)
    kept = nj.keep_one(d)
    assert kept.columns == d.columns
    rows = kept.collect()
    found, n_groups = _brute(docs, 5, 80)
    assert len(rows) == n_groups + sum(n == 0 for _, n, _ in found)
    assert {r.doc_id for r in rows} >= {least for _, n, least in found if n} - {None}


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    assert nj.groups(d, 4, 85).count() == 0 and nj.keep_one(d).count() == 0


def test_signatures_grow_with_the_set_and_no_faster():
    for percent in (80, 85, 95):
        seen = nj.windows(percent)
        for n in (1, 2, 3, 5, 8, 10, 15, 30, 44, 100, 333, 1000, 5000, 20_000, 200_000):
            assert seen.of(n) and seen.cost(n) <= nj.most_signatures(n)
            for m in range(-(-n * percent // 100), n + 1, max(1, n // 50)):
                # a pair of sizes that can be similar has a window that holds both and bounds their differences
                k = (100 - percent) * (m + n) // (100 + percent)
                assert any(seen.windows[t][2] >= k for t in set(seen.of(m)) & set(seen.of(n)))


def test_hubs_of_a_bucket_do_not_depend_on_the_folds(monkeypatch):
    rng = np.random.default_rng(3)
    sigs, nums = rng.integers(0, 50, 400).astype("<u8"), np.sort(rng.integers(0, 90, 400))
    for fold in (10_000, 60):
        monkeypatch.setattr(nj, "FOLD", fold)
        bucket, got = nj._Bucket(), set()
        for lo in range(0, 400, 40):
            wide = sigs[lo : lo + 40].view(np.uint8).reshape(-1, 8)[:, :6]
            for pairs in (bucket.add(wide.tobytes(), nums[lo : lo + 40].astype("<u2").tobytes(), 0),):
                got |= set(map(tuple, pairs.T.tolist())) if pairs is not None else set()
        last = bucket.fold()
        got |= set(map(tuple, last.T.tolist())) if last is not None else set()
        least = {s: min(nums[sigs == s]) for s in set(sigs.tolist())}
        assert got == {(least[s], n) for s, n in zip(sigs.tolist(), nums.tolist(), strict=True) if n != least[s]}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.op5_near_join(spark, sf).collect())
    assert got == sorted((d, n, d if least is None else least) for d, n, least in _brute(docs, 4, 85)[0])


def test_slices_have_the_sets_of_the_whole():
    import pyarrow as pa

    from hayrake.llm.common import slices

    rng = random.Random(1)
    texts = pa.array([None if k % 17 == 0 else " ".join(rng.choice(["Aé", "b\t", "\nC", "日本", "d d", ""]) for _ in range(rng.randrange(60))) for k in range(700)])
    whole = [s.tolist() for s in nj.shingle_sets(texts, 3)]
    for most in (1, 500, 9000, 1 << 30):
        parts = [s.tolist() for part in slices(texts, most) for s in nj.shingle_sets(part, 3)]
        assert parts == whole == [s.tolist() for part in slices(texts.slice(0), most) for s in nj.shingle_sets(part, 3)]
    assert [s.tolist() for part in slices(texts.slice(100, 50), 700) for s in nj.shingle_sets(part, 3)] == whole[100:150]
