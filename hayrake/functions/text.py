"""Normalisation, tokens, n-grams and keys as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stop words of the tokeniser.
STOP_WORDS = "и в во на с со к ко по из за от до для у о об а но или это как что я мы вы он она они не без при под над".split()
WORD = "[a-zа-я0-9]+"


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities and compatibility forms; neither has a JVM function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def folded(text: Column) -> Column:
    """Lower case, yo as ye, no tags, single spaces: all that needs no Python."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "<[^>]+>", " "), "(?U)\\s+", " "))


def normalized(text: Column) -> Column:
    """Entities are resolved before tags are taken out, so an escaped tag goes too."""
    return folded(unescaped(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """Words of two characters or more that are no stop words; ``text`` is folded already."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams within words padded by a space each side; a padded word shorter than n gives itself once for that n."""
    words = F.filter(F.split(text, " "), lambda w: w != "")

    def of(word: Column, n: int) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        last = F.greatest(F.length(padded) - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(n)))

    # a word shorter than the least n stands once, not once for each n
    def all_of(word: Column) -> Column:
        size = F.length(word) + 2
        parts = [of(word, low), *[F.when(size >= n, of(word, n)).otherwise(F.array().cast("array<string>")) for n in range(low + 1, high + 1)]]
        return F.concat(*parts)

    return F.flatten(F.transform(words, all_of))


def word_grams(word: str, low: int = 3, high: int = 5) -> list[str]:
    """The n-grams of one word as ``char_grams`` has them."""
    padded = f" {word} "
    return [padded[i : i + n] for n in range(low, high + 1) if n == low or len(padded) >= n for i in range(max(len(padded) - n + 1, 1))]


#: The short escapes of JSON.
_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_list(*values: Column) -> Column:
    """A JSON list of the values as strings, nulls as empty ones, so that no two rows of different fields look alike."""

    def quoted(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        whole = text
        for code in range(32):
            whole = F.replace(whole, F.lit(chr(code)), F.lit(_ESCAPES.get(chr(code), f"\\u{code:04x}")))
        return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), whole).otherwise(text), F.lit('"'))

    return F.concat(F.lit("["), F.concat_ws(", ", *[quoted(v) for v in values]), F.lit("]"))


def context_key(*columns: str) -> Column:
    """First 24 hex digits of the SHA-256 of a JSON list of the values as strings; a null counts as an empty one."""
    return F.substring(F.sha2(json_list(*[F.col(c) for c in columns]), 256), 1, 24)


def canonical_filter(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?U)\\s+", " "))


def required_rating(text: Column) -> Column:
    """The rating that a filter text asks for, or null."""
    found = F.regexp_extract(folded(text), r"рейтинг[^\d]{0,40}([0-5])", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def hashed(seed: int, key: Column | str) -> Column:
    """A seeded order of keys that any engine with SHA-256 can repeat."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
