import random
import re

from hayrake.llm import secrets as sc


def _brute(text, scope=sc.SCOPE):
    text = text or ""
    raw = []
    rules = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        ("access", r"AKIA[A-Z0-9]+", 0),
        ("hex", r"[0-9a-f]+", 0),
        ("ident", r"""(username|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A),
        ("key", sc.KEY, 0),
        ("endpoint", sc.ENDPOINT, 0),
    ]
    for k, (kind, p, flags) in enumerate(rules):
        for m in re.finditer(p, text, flags):
            size = m.end() - m.start()
            if kind == "assign" and len(m[2]) < 6 or kind == "access" and size < 20 or kind == "hex" and size < 24:
                continue
            raw.append((m.start(), k, m.end(), kind))
    raw.sort()
    out = []
    for s in raw:
        others = [o for o in raw if o is not s]
        near = lambda ks: any(o[1] in ks and max(o[0] - s[2], s[0] - o[2]) <= scope for o in others)  # noqa: B023, E731
        if s[1] >= 3 and any(o[1] < 3 and o[0] < s[2] and o[2] > s[0] for o in others):
            continue
        owner, secret = near((1, 3)), near((0, 2, 4))
        if s[1] < 3 or (s[1] == 3 and secret) or (s[1] == 4 and owner) or (s[1] == 5 and owner and secret):
            out.append(s)
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in out)


def _shown(found):
    return [(r.row.doc_id, ",".join(f"{s.kind}:{s.first}:{s.past}" for s in r.spans)) for r in found.collect()]


def test_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["password: ", "Secret='", "api_key=", "token token=abc", "abcdefgh", "AKIA" + "Z9" * 8, "AKIAAKIA" + "Q" * 9, "0123456789abcdef" * 2,
            "deadbeef", "user=", "client_id: bob77", "x/+Y" * 10, "https://db.example.com/a?b ", "redis://h:6379", "é🙂", " ", "\n", "'", "=", "A" * 90, "word " * 30]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (5, docs[5][1]), (302, "token=abcdef1 " * 4000), (None, "secret=abcdefg")]
    d = spark.createDataFrame([(*r, 0, "y") for r in docs], "doc_id bigint, text string, kind int, row string")
    want = sorted(((i, _brute(t) if i != 302 else None) for i, t in docs), key=str)
    got = sorted(_shown(sc.find(d, ["doc_id", "kind"])), key=str)
    assert len(got) == len(want)
    for (i, x), (j, y) in zip(sorted(got, key=lambda r: str(r[0])), sorted(want, key=lambda r: str(r[0])), strict=True):
        assert i == j
        if i == 302:
            assert x == ",".join(f"assign:{14 * n}:{14 * n + 13}" for n in range(4000))
        else:
            assert x == y, docs[i if i is not None else -1]
    assert sc.find(d.limit(0), ["doc_id"]).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = sc.op2_secrets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
