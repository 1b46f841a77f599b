"""License scans with ordered signature rules, in DataFrame functions only.

A text is reduced to its words, lower-cased and joined by single spaces.  Rules are regular expressions over that form; each has a
keyword, a word that every match of it holds, and a tier.  Only the rules whose keyword a text holds are tried on it: the keywords
in a text are one set intersection, and the rules that belong to them one equi-join with the table of rules, whose size is fixed.

Overlapping detections are resolved by interval containment: one that lies within a detection of a stronger tier goes, and so
does one within a longer or, at equal places, earlier listed detection of its own tier.  Both are running maxima of ends in order
of starts, so a text with n detections costs n log n and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, quoted, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Tiers, strongest first: tags and whole notices, names with a version, names, hints; and how sure each makes.
NOTICE, VERSIONED, NAMED, HINT = 1, 2, 3, 4
SURE = {NOTICE: 1.0, VERSIONED: 0.9, NAMED: 0.6, HINT: 0.2}


@dataclass(frozen=True)
class Rule:
    tier: int
    keyword: str
    label: str
    pattern: str


#: Sentences of notices and license texts, as words: label, keyword, pattern.
_NOTICES = """
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit-0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
bsl-1.0 | hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
isc | hereby | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | documentation | permission to use copy modify and distribute this software and its documentation for any purpose
ntp | hereby | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
ofl-1.1 | sil | this font software is licensed under the sil open font license version 1 1
unicode | unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of (?:its|their) contributors may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
apache-2.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | apache | a copy of the license is located at https? www apache org licenses license 2 0
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl-2.0-or-later | gnu | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | gnu | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only | gnu | under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-3.0-only | gnu | under the terms of the gnu general public license version 3 (?:only )?as published by the free software foundation
lgpl-2.1-or-later | gnu | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | gnu | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later | gnu | under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later | gnu | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gfdl | gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
epl-1.0 | eclipse | made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse | made available under the terms of the eclipse public license(?: v)? 2 0
cddl-1.0 | development | the contents of this file are subject to the terms of the common development and distribution license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
public-domain | domain | (?:this (?:work|file|software|code)|it) (?:is|has been) (?:placed|released|dedicated) (?:in|in to|into|to) the public domain
public-domain | waived | to the extent possible under law (?:[^ ]+ ){0,12}waived all copyright
cc0-1.0 | cc0 | (?:released|licensed|available) under (?:the )?cc0(?: 1 0)?
wtfpl | fuck | do what the fuck you want to public license
beerware | beer | you can buy me a beer in return
json | evil | the software shall be used for good not evil
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized | unauthorized (?:copying|use|distribution)(?: [^ ]+){0,8} (?:is )?strictly prohibited
proprietary | permission | may not be (?:reproduced|copied|distributed)(?: [^ ]+){0,8} without (?:the )?(?:prior )?(?:written )?permission
"""

#: Licenses with versions: label | keyword | names | versions.
_VERSIONED = """
gpl | gnu | gnu general public license(?: as published by the free software foundation)?;gnu gpl | 1 0;2 0;3 0
gpl | gpl | gpl;gpl license | 1 0;2 0;3 0
lgpl | gnu | gnu (?:lesser|library) general public license;gnu lgpl | 2 0;2 1;3 0
lgpl | lgpl | lgpl;lgpl license | 2 0;2 1;3 0
agpl | affero | (?:gnu )?affero general public license | 1 0;3 0
agpl | agpl | (?:gnu )?agpl;agpl license | 1 0;3 0
gfdl | documentation | gnu free documentation license | 1 1;1 2;1 3
apache | apache | apache license;apache software license;apache | 1 0;1 1;2 0
mpl | mozilla | mozilla public license | 1 0;1 1;2 0
mpl | mpl | mpl | 1 0;1 1;2 0
epl | eclipse | eclipse public license | 1 0;2 0
epl | epl | epl | 1 0;2 0
eupl | european | european union public licen[cs]e | 1 1;1 2
eupl | eupl | eupl | 1 1;1 2
cddl | cddl | cddl | 1 0;1 1
cpl | common | common public license | 1 0
ipl | ibm | ibm public license | 1 0
osl | osl | osl;osl license | 2 0;2 1;3 0
osl | open | open software license | 2 0;2 1;3 0
afl | academic | academic free license | 2 0;2 1;3 0
artistic | artistic | artistic license | 1 0;2 0
cecill | cecill | cecill(?: free software license agreement)? | 1 0;2 0;2 1
ofl | font | (?:sil )?open font license | 1 0;1 1
upl | universal | universal permissive license | 1 0
zpl | zope | zope public license | 2 0;2 1
ecl | educational | educational community license | 1 0;2 0
bsl | boost | boost software license | 1 0
qpl | public | q public license | 1 0
lppl | latex | latex project public license | 1 0;1 2;1 3
odbl | database | open (?:data commons open )?database license | 1 0
ncsa | illinois | university of illinois ncsa open source license | 1 0
php | php | php license | 3 0;3 01
busl | business | business source license | 1 1
sspl | server | server side public license | 1 0
elastic | elastic | elastic license | 1 0;2 0
"""

#: Names without a version: label | keyword | pattern.
_NAMES = """
gpl | gnu | gnu general public licen[cs]e
gpl | gpl | (?:the )?gpl licen[cs]e
lgpl | lesser | (?:gnu )?lesser general public licen[cs]e
agpl | affero | (?:gnu )?affero general public licen[cs]e
apache | apache | apache (?:software )?licen[cs]e
apache | apache | apache licensed
mit | mit | (?:the )?mit(?: x11| expat)? licen[cs]e
mit | mit | mit licensed
mit | mit | licen[cs]ed under (?:the )?mit
bsd-2-clause | bsd | bsd 2 clause(?: licen[cs]e)?;(?:2|two) clause bsd(?: licen[cs]e)?;(?:simplified|freebsd) bsd licen[cs]e
bsd-3-clause | bsd | bsd 3 clause(?: licen[cs]e)?;(?:3|three) clause bsd(?: licen[cs]e)?;(?:new|revised|modified) bsd licen[cs]e
bsd-4-clause | bsd | bsd 4 clause(?: licen[cs]e)?;(?:4|four) clause bsd(?: licen[cs]e)?;original bsd licen[cs]e
bsd | bsd | bsd(?: style| like)? licen[cs]e
bsd | bsd | licen[cs]ed under (?:the )?bsd
isc | isc | isc licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
eupl | european | european union public licen[cs]e
artistic | artistic | artistic licen[cs]e
psf | python | python software foundation licen[cs]e
ofl | font | open font licen[cs]e
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
vim | vim | vim licen[cs]e
ruby | ruby | ruby licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
cc0 | cc0 | cc0
cc | commons | creative commons(?: licen[cs]e)?
public-domain | domain | (?:in|into) the public domain
proprietary | proprietary | proprietary licen[cs]e
commercial | commercial | commercial licen[cs]e
"""

#: What only hints at a license: label | keyword | pattern.
_HINTS = """
all-rights-reserved | reserved | all rights reserved
all-rights-reserved | réservés | tous droits réservés
all-rights-reserved | vorbehalten | alle rechte vorbehalten
all-rights-reserved | reservados | todos los derechos reservados
copyright | copyright | copyright(?: c)? (?:19|20)\\d\\d
copyright | copyrighted | copyrighted (?:material|work)
license-reference | licensed | licensed under
license-reference | license | (?:see|read) (?:the )?license(?: file)?
license-reference | licence | (?:see|read) (?:the )?licence(?: file)?
license-reference | agreement | end user license agreement
license-reference | eula | eula
license-reference | copying | see (?:the )?(?:file )?copying
"""

#: Identifiers that follow a tag, as they are written there.
_TAGS = (
    "MIT MIT-0 ISC 0BSD Zlib X11 NCSA NTP HPND Unlicense WTFPL Beerware JSON BSL-1.0 PSF-2.0 Python-2.0 Ruby Vim OpenSSL curl "
    "BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause Apache-1.0 Apache-1.1 Apache-2.0 "
    "GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only "
    "LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only "
    "AGPL-3.0-or-later MPL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 CDDL-1.0 CDDL-1.1 CPL-1.0 IPL-1.0 OSL-3.0 AFL-3.0 "
    "Artistic-1.0 Artistic-2.0 CECILL-2.1 OFL-1.1 UPL-1.0 ECL-2.0 MS-PL MS-RL CC0-1.0 ODbL-1.0 PDDL-1.0 BUSL-1.1 SSPL-1.0 Elastic-2.0 PostgreSQL"
).split()

_CC_KINDS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:atives|s)?", "nc": "non ?commercial"}


def _listed(text: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(" | ")] for line in text.strip().splitlines()]


def _all_rules() -> list[Rule]:
    """The rules in order; those of licenses with versions and of Creative Commons are made from their lists."""
    rules = []
    for tag in _TAGS:
        rules.append(Rule(NOTICE, "spdx", tag.lower(), "spdx licen[cs]e identifier " + tag.lower().replace("-", " ").replace(".", " ")))
    rules += [Rule(NOTICE, keyword, label, pattern) for label, keyword, pattern in _listed(_NOTICES)]
    for kind in _CC_KINDS:
        short, spelt = kind.replace("-", " "), "(?: and)? ".join(_CC_WORDS[part] for part in kind.split("-"))
        for version in _CC_VERSIONS:
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            rules.append(Rule(NOTICE, "creativecommons", label, f"creativecommons org licenses {short} {version}"))
            rules.append(Rule(VERSIONED, "cc", label, f"cc {short} (?:version |v )?{version}"))
            rules.append(Rule(VERSIONED, "commons", label, f"creative commons {spelt} (?:licen[cs]e )?(?:version |v )?{version}"))
        rules.append(Rule(NAMED, "cc", f"cc-{kind}", f"cc {short}"))
        rules.append(Rule(NAMED, "commons", f"cc-{kind}", f"creative commons {spelt}"))
    for label, keyword, names, versions in _listed(_VERSIONED):
        for name in names.split(";"):
            for version in versions.split(";"):
                # a minor version of nought may be left out
                digits = version[:-2] + "(?: 0)?" if version.endswith(" 0") else version
                of = f"{label}-{version.replace(' ', '.')}"
                said = f"{name} (?:version |v |v)?{digits}"
                rules.append(Rule(VERSIONED, keyword, f"{of}-or-later", f"{said}(?: of the license)? or (?:at your option )?(?:any )?(?:later|newer)"))
                rules.append(Rule(VERSIONED, keyword, f"{of}-only", f"{said} only"))
                rules.append(Rule(VERSIONED, keyword, of, said))
    for major in "123":
        rules.append(Rule(VERSIONED, f"gplv{major}", f"gpl-{major}.0", f"gplv{major}(?: 0)?"))
        rules.append(Rule(VERSIONED, f"lgplv{major}", f"lgpl-{major}.0", f"lgplv{major}(?: 0)?"))
        rules.append(Rule(VERSIONED, f"agplv{major}", f"agpl-{major}.0", f"agplv{major}(?: 0)?"))
    for tier, text in ((NAMED, _NAMES), (HINT, _HINTS)):
        for label, keyword, patterns in _listed(text):
            rules += [Rule(tier, keyword, label, p.replace("\\\\", "\\")) for p in patterns.split(";")]
    return rules


RULES = _all_rules()


def _low(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrase(words: Column, phrase: str) -> Column:
    """Struct (n, first, last) of the places where a phrase's words stand, in words; overlapping places count."""
    head, _, tail = phrase.partition(" ")
    found = f"(?<= ){head}(?= {tail} )" if tail else f"(?<= ){head}(?= )"
    pieces = F.split(words, found, -1)
    held = F.when(words.contains(f" {phrase} "), pieces)
    n = (F.size(held) - 1).cast("bigint")
    first = _spaces(F.get(held, 0)) - 1
    last = _spaces(words) - _spaces(F.element_at(held, -1)) - 1
    return F.when(held.isNotNull(), F.struct(n.alias("n"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last")))


def words_of(docs: DataFrame, keep: list[str], keywords: list[str], phrases: Mapping[str, str]) -> DataFrame:
    """``row``, rid, n_words, keywords (those in the text), words (single-spaced, of texts with a keyword or a phrase) and base."""
    listed = sorted({*keywords, *(p.partition(" ")[0] for p in phrases)})
    kept = F.struct(*[F.col(quoted(c)) for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    cut = docs.select(kept.alias("row"), F.regexp_extract_all(_low(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0)).alias("all"))
    held = F.array_intersect("all", F.array(*[F.lit(k) for k in listed]))
    cut = cut.select("row", F.size("all").cast("bigint").alias("n_words"), held.alias("keywords"), "all")
    joined = F.when(F.size("keywords") > 0, F.concat(F.lit(" "), F.array_join("all", " "), F.lit(" ")))
    cut = cut.select("row", "n_words", "keywords", joined.alias("words")).withColumn("rid", F.monotonically_increasing_id())
    places = [F.when(F.col("words").isNotNull(), _phrase(F.col("words"), p)).alias(f"base_{k}") for k, p in enumerate(phrases)]
    return cut.select("*", *places)


def _rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(k, r.tier, r.keyword, r.label, f"(?<= )(?:{r.pattern})(?= )") for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, tier int, keyword string, label string, pattern string")


def scan(docs: DataFrame, keep: list[str], rules: list[Rule] | None = None, phrases: Mapping[str, str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns), n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    One row per input row, repeated rows included.  ``spans`` are the detections that stand, by (first, past, rule): words, the end
    exclusive, with rule number, tier and label.  The rules are broadcast: their number is that of the list.
    """
    rules, phrases = RULES if rules is None else rules, BASE if phrases is None else phrases
    spark = prepare(docs.sparkSession)
    cut = words_of(docs, keep, [r.keyword for r in rules], phrases)
    bases = [F.col(f"base_{k}") for k in range(len(phrases))]
    n_base = sum((F.coalesce(b["n"], F.lit(0)) for b in bases), F.lit(0).cast("bigint"))
    first = F.array_min(F.array(*[b["first"] for b in bases])) if bases else F.lit(None).cast("bigint")
    last = F.array_max(F.array(*[b["last"] for b in bases])) if bases else F.lit(None).cast("bigint")
    said = F.array(*[F.when(b.isNotNull(), label) for b, label in zip(bases, phrases.values(), strict=True)]) if bases else F.expr("cast(array() as array<string>)")
    base_labels = F.array_sort(F.array_distinct(F.array_compact(said)))
    facts = F.struct("row", "n_words", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"), base_labels.alias("base_labels"))
    gated = cut.select("rid", facts.alias("facts"), "words", "keywords").select("rid", "facts", "words", F.explode_outer("keywords").alias("keyword"))
    tried = gated.join(F.broadcast(_rule_table(spark, rules)), "keyword", "left")
    found = F.regexp_extract_all("words", F.col("pattern"), F.lit(0))
    tried = tried.select("rid", "facts", "rule", "tier", "label", "pattern", "words", found.alias("found"))
    pieces = F.when(F.size("found") > 0, F.split("words", F.col("pattern"), -1))
    steps = F.zip_with("found", pieces, lambda m, p: F.when(m.isNotNull(), F.struct(_spaces(p).alias("gap"), _spaces(m).alias("inner"))))
    each = tried.select("rid", "facts", "rule", "tier", "label", F.posexplode_outer(F.array_compact(steps)).alias("i", "step"))
    own = Window.partitionBy("rid", "rule").orderBy("i")
    hit = F.col("step").isNotNull()
    upto = F.sum(F.col("step.gap") + F.col("step.inner")).over(own)
    placed = each.repartition("rid").withColumn("upto", upto)
    start = (F.col("upto") - F.col("step.inner") - 1).cast("bigint")
    placed = placed.select("rid", "facts", "rule", F.when(hit, F.col("tier")).alias("tier"), "label", start.alias("first"), (start + F.col("step.inner") + 1).alias("past"))
    inside = Window.partitionBy("rid", "tier").orderBy("first", F.desc("past"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("same", F.max("past").over(inside))
    upto_start = Window.partitionBy("rid").orderBy("first")
    for t in (NOTICE, VERSIONED, NAMED):
        placed = placed.withColumn(f"past_{t}", F.max(F.when(F.col("tier") <= t, F.col("past"))).over(upto_start))
    stronger = F.when(F.col("tier") == VERSIONED, F.col("past_1")).when(F.col("tier") == NAMED, F.col("past_2")).when(F.col("tier") == HINT, F.col("past_3"))
    covered = (F.coalesce(stronger, F.lit(-1)) >= F.col("past")) | (F.coalesce("same", F.lit(-1)) >= F.col("past"))
    span = F.when(F.col("tier").isNotNull() & ~covered, F.struct("first", "past", "rule", "tier", "label"))
    spans = placed.groupBy("rid").agg(F.first("facts").alias("facts"), F.array_sort(F.collect_list(span)).alias("spans"))
    labels = F.array_sort(F.array_union("facts.base_labels", F.transform("spans", lambda s: s["label"])))
    sure = F.create_map(*[F.lit(x) for t, w in SURE.items() for x in (t, w)])
    score = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: sure[s["tier"]])), F.lit(0.0)), F.when(F.col("facts.n_base") > 0, SURE[NAMED]).otherwise(0.0))
    return spans.select("facts.*", labels.alias("labels"), score.alias("score"), "spans")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and labels of licenses in every document.

    Null and empty texts have no words, no labels, null places and score 0; repeated rows have equal results; whole texts count,
    however long; ties between detections fall to the earlier rule; an empty table gives an empty result.
    """
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


def _rules_sql() -> str:
    """The rules for a text in which two spaces part the words, so that neighbouring matches need not share one."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    wide = lambda p: f" (?:{p.replace('[^ ]', '[^_]').replace(' ', '  ').replace('[^_]', '[^ ]').replace('  ?', '(?:  )?')}) "
    return ", ".join(f"({k}, {r.tier}, {quote(r.keyword)}, {quote(r.label)}, {quote(wide(r.pattern))})" for k, r in enumerate(RULES))


def _base_sql() -> str:
    out = []
    for phrase, label in BASE.items():
        same = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(" ")))
        out.append(f"SELECT r, '{label}' AS label, unnest(list_filter(range(1, len(ws) + 1), lambda i: {same})) - 1 AS place FROM cut")
    return " UNION ALL ".join(out)


OP11_SQL = rf"""
WITH rules(rule, tier, keyword, label, re) AS (VALUES {_rules_sql()}),
cut AS (SELECT r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
base AS ({_base_sql()}),
based AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base_list FROM base GROUP BY r),
wide AS (SELECT r, ws, ' ' || array_to_string(ws, '  ') || ' ' AS t FROM cut WHERE list_has_any(ws, (SELECT list(DISTINCT keyword) FROM rules))),
tried AS (SELECT r, rule, tier, label, regexp_extract_all(t, re, 0) AS m, string_split_regex(t, re) AS p FROM wide JOIN rules ON list_contains(ws, keyword) WHERE regexp_matches(t, re)),
laid AS (SELECT r, rule, tier, label, i, len(list_filter(string_split(p[i], ' '), lambda w: w <> '')) AS gap, len(list_filter(string_split(m[i], ' '), lambda w: w <> '')) AS size
  FROM tried, unnest(range(1, len(m) + 1)) AS t(i)),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, rule ORDER BY i) AS past FROM laid),
spans AS (SELECT r, rule, tier, label, past - size AS first, past FROM placed),
shown AS (SELECT * FROM spans s WHERE NOT exists(SELECT 1 FROM spans o WHERE o.r = s.r AND o.first <= s.first AND o.past >= s.past
    AND (o.tier < s.tier OR (o.tier = s.tier AND (o.past - o.first > s.past - s.first OR o.rule < s.rule))))),
labelled AS (SELECT r, list(DISTINCT label) AS more, max(CASE tier {" ".join(f"WHEN {t} THEN {w}" for t, w in SURE.items())} END)::DOUBLE AS sure FROM shown GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base_list, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(more, [])))), ','), '') AS labels,
  greatest(coalesce(sure, 0), CASE WHEN n_base > 0 THEN {SURE[NAMED]} ELSE 0 END)::DOUBLE AS score
FROM cut LEFT JOIN based USING (r) LEFT JOIN labelled USING (r)
"""
