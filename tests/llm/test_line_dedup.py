import hashlib
import random
import re

from hayrake.llm import line_dedup as ld


def _words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def _brute(docs, least):
    """docs: (doc_id, text), unique.  All runs of all documents against all earlier places."""
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    seqs = []
    for doc_id, text in order:
        lines = (text or "").split("\n")
        seqs.append((doc_id, text, lines, [(k, x.rstrip(" \t\r\x0b\x0c"), _words(x)) for k, x in enumerate(lines) if _words(x)]))
    gone = [set() for _ in seqs]
    for d, (*_, seq) in enumerate(seqs):
        for a in range(len(seq)):
            for e in range(d + 1):
                other = seqs[e][3]
                for b in range(len(other) if e < d else a):
                    n = words = 0
                    while a + n < len(seq) and b + n < len(other) and seq[a + n][1] == other[b + n][1] and (e < d or b + n < a):
                        words += seq[a + n][2]
                        n += 1
                    if words >= least:
                        gone[d] |= {seq[a + x][0] for x in range(n)}
    return {(doc_id, text): "\n".join(x for k, x in enumerate(lines) if k not in gone[d]) for d, (doc_id, text, lines, _) in enumerate(seqs)}


def _got(found):
    return [((r.row.doc_id, r.row.text), r.text) for r in found.collect()]


def test_against_brute_force(spark):
    rng = random.Random(11)
    bits = ["a", "b b", "c c c", "", "d d  ", "e", "f f f f f", " ", "g"]
    for least in (1, 3, 7):
        docs = {(rng.randrange(40), "\n".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))) for _ in range(45)}
        docs |= {(None, "a\nb b\nc c c\ne"), (50, None), (51, ""), (52, "\n".join(["x y z"] * 20)), (3, "a\nb b\nc c c\ne")}
        docs = sorted(docs, key=str)
        rows = [(*r, i, "k") for i, r in enumerate([*docs, docs[4], docs[9]])]
        d = spark.createDataFrame(rows, "doc_id bigint, text string, windows int, hash string")
        want = _brute(docs, least)
        got = _got(ld.dedup_lines(d, least))
        assert len(got) == len(rows)
        for key, text in got:
            assert (text or "") == want[key], (least, key)


def test_long_and_empty_inputs(spark):
    block = "\n".join(f"line {k} of a long passage" for k in range(3000))
    rows = [(1, block), (2, "own words\n" + block + "\nmore"), (3, "short line\nx"), (4, "short line\nx")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {k[0]: t for k, t in _got(ld.dedup_lines(d))}
    assert got == {1: block, 2: "own words\nmore", 3: "short line\nx", 4: "short line\nx"}
    assert ld.dedup_lines(d.limit(0)).count() == 0
    kept = ld.keep_first_lines(spark.createDataFrame([*[(*r, 7) for r in rows], (9, block, 7)], "doc_id bigint, text string, n_chars int"))
    assert {r.doc_id: r.n_chars for r in kept.collect()} == {1: 7, 2: 14, 3: 7, 4: 7}


def test_no_python_on_the_main_path(spark):
    plan = ld.op7_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = _brute(docs, ld.MIN_WORDS)
    got = {r.doc_id: r for r in ld.op7_line_dedup(spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        kept, r = want[doc_id, text], got[doc_id]
        assert (r.n_lines, r.n_removed) == (text.count("\n") + 1, text.count("\n") + 1 - (kept.count("\n") + 1 if kept or r.n_removed <= text.count("\n") else 0))
        assert r.kept_chars == len(kept) and r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
