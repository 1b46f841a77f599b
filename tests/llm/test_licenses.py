import random
import re

import duckdb

from hayrake.llm import licenses as lc

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _brute(text, rules=lc.RULES, phrases=lc.BASE):
    words = _WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    base = []
    for phrase, label in phrases.items():
        p = phrase.split(" ")
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    joined = f" {' '.join(words)} "
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined) if r.keyword in words else ():
            first = joined[: m.start()].count(" ") - 1
            found.append((first, first + len(m[0].split()), k, r.tier, r.label))

    def inside(s, o):
        within = o[0] <= s[0] and o[1] >= s[1] and o is not s
        return within and (o[3] < s[3] or o[3] == s[3] and (o[1] - o[0] > s[1] - s[0] or o[2] < s[2]))

    spans = sorted(s for s in found if not any(inside(s, o) for o in found))
    labels = {label for _, label in base}
    score = max([lc.SURE[s[3]] for s in spans] + [0.6 if base else 0.0])
    places = [i for i, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), sorted(labels), sorted(labels | {s[4] for s in spans}), score, spans


def _texts():
    rng = random.Random(11)
    bits = [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0-or-later", "CC BY", "CC-BY-NC-SA 4.0", "CC BY CC BY", "cc by 3.0",
        "This work is licensed under the GNU General Public License, version 3.", "GPLv2 or later", "GNU Lesser General Public License v2.1 only",
        "Creative Commons Attribution-ShareAlike 4.0", "https://creativecommons.org/licenses/by-nd/2.5/", "All rights reserved.", "Copyright (c) 2019",
        "Apache License", "apache", "license", "MIT", "gnu general public", "BSD 3-Clause License", "the", "und", "word", "É", "日本", "\n", "\x00", "Tous droits réservés",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "see LICENSE", "mit license mit license", "2.0", "or later",
    ]
    return [" ".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(250)] + [*bits, None, "", "!?", bits[0], "word " * 50_000 + "CC BY-SA 4.0 " * 300]


def test_against_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, row string, rid int")
    found = lc.scan(df, ["doc_id", "rid"])
    assert found.columns == ["row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (*r[1:8], [tuple(s) for s in r.spans]) == _brute(texts[r.row.doc_id]), texts[r.row.doc_id]
    assert lc.scan(df.limit(0), ["doc_id"]).count() == 0


def test_sql_says_the_same(spark):
    df = spark.createDataFrame([(i % 200, t) for i, t in enumerate(_texts())], "doc_id bigint, text string")
    df.createOrReplaceTempView("license_docs")
    documents = df.toArrow()  # noqa: F841
    want = sorted(duckdb.sql(lc.OP11_SQL).fetchall(), key=str)
    found = lc.scan(df, ["doc_id"])
    got = [(r.row.doc_id, *r[1:5], ",".join(r.base_labels), ",".join(r.labels), r.score) for r in found.collect()]
    assert sorted(got, key=str) == want


def test_own_rules_and_phrases(spark):
    rules = [lc.Rule(lc.HINT, "b", "weak", "a b a"), lc.Rule(lc.NOTICE, "c", "strong", "b a c"), lc.Rule(lc.HINT, "a", "one", "a")]
    df = spark.createDataFrame([(1, "a b a b a c a"), (2, "x")], "doc_id int, text string")
    for phrases in ({"a b a": "p", "a": "q"}, {}):
        for r in lc.scan(df, ["doc_id"], rules, phrases).collect():
            text = "a b a b a c a" if r.row.doc_id == 1 else "x"
            assert (*r[1:8], [tuple(s) for s in r.spans]) == _brute(text, rules, phrases)


def test_rules():
    assert len(lc.RULES) > 300
    for r in lc.RULES:
        # the keyword gates: no match may do without it
        assert r.keyword in re.split(r"[^a-z0-9é]+", r.pattern), r
        assert not re.search(rf"\(\?:[^()]*\b{r.keyword}\b[^()]*\)\?", r.pattern), r


def test_labels_of_the_given_lines():
    want = {
        "Licensed under CC BY-NC 4.0.": ["cc-by", "cc-by-nc-4.0", "license-reference"],
        "Released under the MIT License.": ["mit"],
        "Licensed under the Apache License, Version 2.0.": ["apache", "apache-2.0", "license-reference"],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl", "gpl-3.0", "license-reference"],
        "All rights reserved.": ["all-rights-reserved"],
    }
    for text, labels in want.items():
        assert _brute(text)[5] == labels


def test_no_python_on_the_main_path(spark):
    plan = lc.op11_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
