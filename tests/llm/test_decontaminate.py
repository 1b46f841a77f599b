import random
import re

from hayrake.llm import decontaminate as dc


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, of = _words(text), set(), set()
        for item_id, item in items:
            iw = _words(item)
            n = min(window, len(iw))
            for s in range(len(iw) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == iw[s : s + n]:
                        hit |= set(range(i, i + n))
                        of.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(of)))
    return out


def _got(found):
    return [(r.row.doc_id, r.n_words, sum(s.past - s.first for s in r.spans), list(r.items)) for r in found.collect()]


def test_random_streams(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "c,d", "É"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (62, "q " * 9000)]
    items = [(i, text(rng.randrange(0, 12))) for i in range(9)] + [(9, None), (3, "q q q q q q q"), (10, "zz")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, n_words int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for window in (1, 2, 4, 6):
        want = _brute(docs, items, window)
        assert sorted(_got(dc.scan(d, b, ["doc_id", "n_words"], window))) == sorted(want)
    assert sorted(_got(dc.scan(d, b, ["doc_id"], 4, bound=12))) == sorted(_brute(docs, items, 4))
    assert dc.scan(d, b.limit(0), ["doc_id"]).where("size(items) > 0").count() == 0
    assert dc.scan(d.limit(0), b, ["doc_id"]).count() == 0


def test_cleaning_removes_spans_and_covered_documents(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "Clean. text", 11), (2, f"before, {item.upper()}! after it all and more", 0), (3, item, 0), (4, None, 7), (5, "", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint")
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in dc.decontaminate(d, b).collect()}
    assert got == {1: ("Clean. text", 11), 2: ("before, ! after it all and more", 31), 4: (None, 7), 5: ("", 0)}
