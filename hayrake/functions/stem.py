"""The Russian Snowball stemmer, which no JVM function offers; words of other scripts stay as they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "аеиоуыэюя"
#: The endings of the published algorithm.  Those of *_AFTER count only behind а or я.
GERUND_AFTER = "в вши вшись".split()
GERUND = "ив ивши ившись ыв ывши ывшись".split()
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE_AFTER = "ем нн вш ющ щ".split()
PARTICIPLE = "ивш ывш ующ".split()
REFLEXIVE = "ся сь".split()
VERB_AFTER = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _region(word: str, start: int) -> int:
    """Behind the first non-vowel that follows a vowel from ``start`` on."""
    for k in range(start + 1, len(word)):
        if word[k] not in _VOWELS and word[k - 1] in _VOWELS:
            return k + 1
    return len(word)


def _cut(rest: str, plain: list[str], after: list[str] = ()) -> str | None:
    """Rest without its longest ending, or None."""
    found = [e for e in plain if rest.endswith(e)]
    found += [e for e in after if rest.endswith(e) and rest[: -len(e)][-1:] in ("а", "я")]
    return rest[: -len(max(found, key=len))] if found else None


def stem(word: str) -> str:
    word = word.replace("ё", "е")
    rv = next((k + 1 for k, c in enumerate(word) if c in _VOWELS), len(word))
    r2 = _region(word, _region(word, 0))
    head, rest = word[:rv], word[rv:]
    cut = _cut(rest, GERUND, GERUND_AFTER)
    if cut is None:
        rest = next((r for r in [_cut(rest, REFLEXIVE)] if r is not None), rest)
        cut = _cut(rest, ADJECTIVE)
        if cut is not None:
            shorter = _cut(cut, PARTICIPLE, PARTICIPLE_AFTER)
            cut = cut if shorter is None else shorter
        else:
            cut = _cut(rest, VERB, VERB_AFTER)
            if cut is None:
                cut = _cut(rest, NOUN)
    rest = rest if cut is None else cut
    rest = rest.removesuffix("и")
    for ending in ("ость", "ост"):
        if rest.endswith(ending) and rv + len(rest) - len(ending) >= r2:
            rest = rest[: -len(ending)]
            break
    shorter = _cut(rest, ["ейш", "ейше"])
    rest = rest if shorter is None else shorter
    if rest.endswith("нн"):
        rest = rest[:-1]
    elif shorter is None:
        rest = rest.removesuffix("ь")
    return head + rest


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_table(words: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of the distinct words: each is stemmed once, however often it stands; words without Cyrillic letters stay in the JVM."""
    distinct = words.select(F.col(term).alias("term")).distinct()
    russian = F.col("term").rlike("[а-яё]")
    return distinct.where(russian).select("term", _stem("term").alias("stem")).unionByName(distinct.where(~russian).select("term", F.col("term").alias("stem")))


def stemmed_terms(rows: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, terms) with every word by its stem, in order; rows without words keep their empty array.

    Words are joined with their table by word, so no array goes through Python and Spark can split a frequent word.
    """
    each = rows.select(key, F.posexplode_outer(terms).alias("at", "term"))
    table = stem_table(each.where(F.col("term").isNotNull()))
    joined = each.join(table, "term", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "stem")))).alias("words"))
    return joined.select(key, F.transform("words", lambda w: w["stem"]).alias(terms))
