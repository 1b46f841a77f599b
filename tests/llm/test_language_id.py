import zlib
from collections import Counter

from hayrake.llm import language_id as li

SF = "/root/testdata/sf0.01"


def _grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    n = Counter()
    for w in words:
        n.update(w)
        p = f" {w} "
        n.update(p[i : i + 2] for i in range(len(p) - 1))
        n.update(p[i : i + 3] for i in range(len(p) - 2))
    # a three-character window around a one-letter word starts and ends with a space, as here
    return n


def _code(g):
    k = 0
    for c in g:
        k = (k << 21) | ord(c)
    return k


def test_counts_against_brute_force():
    for text in ["", "a", "Été  à la plage! x", "12 34", "ǅ İstanbul ß", "日本語 text", "word " * 500]:
        want = Counter({_code(g): n for g, n in _grams(text).items()})
        got = Counter(li.grams(li.folded(text.encode())).tolist())
        assert got == want, text
        order = sorted(want, key=lambda g: (-want[g], g))[:7]
        assert li.ranked(text.encode(), 7).tolist() == order


def test_query_against_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    totals = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            totals.setdefault(r.lang, Counter()).update(_grams(r.text))
    ranks = {
        lang: {g: k for k, g in enumerate(sorted(n, key=lambda g: (-n[g], _code(g)))[:300])} for lang, n in totals.items()
    }
    got = {r.doc_id: r for r in li.op9_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    right = held = 0
    for r in rows[:150]:
        n = _grams(r.text)
        own = sorted(n, key=lambda g: (-n[g], _code(g)))[:300]
        far = {k: sum(abs(i - v[g]) if g in v else 300 for i, g in enumerate(own)) for k, v in sorted(ranks.items())}
        best = min(far, key=far.get)
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - (1 - far[best] / (300 * len(own)))) < 1e-12
    for r in rows:
        if got[r.doc_id].held_out:
            held += 1
            right += got[r.doc_id].lang_pred == r.lang
    assert held > 100 and right / held > 0.95


def test_edge_rows(spark):
    rows = [(1, "the cat the dog", "en"), (1, "the cat the dog", "en"), (2, None, "fr"), (3, "", "fr"), (4, "12 !", None),
            (6, "le chat et le chien", "fr"), (7, "x" * 200000, None), (None, "the dog", None)]
    docs = spark.createDataFrame([(*r, "z", 3) for r in rows], "doc_id bigint, text string, lang string, row string, score int")
    ranks = li.learn(docs)
    got = li.identify(docs, ranks, ["doc_id", "row"]).collect()
    by = {r.row.doc_id: r.lang_pred for r in got}
    assert len(got) == 8 and [by[k] for k in (1, 2, 3, 4, 6, None)] == ["en", "und", "und", "und", "fr", "en"]
    assert li.learn(docs.limit(0)) == [] and li.identify(docs, [], ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert li.keep_identified(docs).columns == docs.columns


def test_profiles_are_cut_before_the_shuffle(spark):
    sums = spark.createDataFrame([(lang, g, g % 7) for lang in ("a", "b") for g in range(50)], "lang string, gram bigint, n bigint")
    top = li.profile_places(sums, 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    want = sorted(range(50), key=lambda g: (-(g % 7), g))[:5]
    assert {(r.lang, r.gram, r.place) for r in top.collect()} == {(lang, g, k + 1) for lang in ("a", "b") for k, g in enumerate(want)}
