"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams of one to three characters.  A document's own list is compared
with every profile by the out-of-place distance: the sum, over the document's n-grams, of the difference of
ranks, where an n-gram that the profile lacks counts as one full profile length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import annotate, claim, prepare, quoted, table

PROFILE = 300
UNKNOWN = "und"
#: A document is rejected when it has no letters or its score is below this.
LEAST_SCORE = 0.2
#: Characters that are counted at once while learning; bounds a task's memory.
CHUNK = 400_000


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or a space for all that is no letter."""
    out = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(text: bytes) -> np.ndarray:
    """Letters as code points, each stretch of anything else as one space, with a space at both ends."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    c = np.concatenate([[32], _folding()[points], [32]])
    space = c == 32
    return c[~(space & np.concatenate([[False], space[:-1]]))]


def grams(c: np.ndarray) -> np.ndarray:
    """All 1-, 2- and 3-grams within padded words; 21 bits a character, so that equal numbers mean equal n-grams."""
    if len(c) < 3:
        return np.empty(0, np.int64)
    one = c[1:-1]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([one[one != 32], two, three[one != 32]])


def ranked(text: bytes, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, ties by number."""
    found, n = np.unique(grams(folded(text)), return_counts=True)
    if len(found) > size:
        least = -np.partition(-n, size - 1)[size - 1]
        keep = n >= least
        found, n = found[keep], n[keep]
    return found[np.argsort(-n, kind="stable")][:size]


class Profiles:
    """Profiles of all languages, for one lookup of an n-gram's rank in each."""

    def __init__(self, ranks: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in ranks})
        self.grams = np.array(sorted({g for _, g, _ in ranks}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        at = {lang: k for k, lang in enumerate(self.langs)}
        for lang, g, r in ranks:
            self.ranks[np.searchsorted(self.grams, g), at[lang]] = r

    def judge(self, text: bytes | None) -> tuple[str, float]:
        own = ranked(text, self.size) if text else np.empty(0, np.int64)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        k = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = self.ranks[np.where(self.grams[k] == own, k, len(self.grams))]
        places = np.arange(len(own), dtype=np.int32)[:, None]
        far = np.where(there < 0, self.size, np.abs(there - places)).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def profile_places(sums: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent n-grams of each language with ``place`` from 1; tasks drop the rest before they are dealt."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return sums.withColumn("place", place).where(F.col("place") <= size)


def learn(docs: DataFrame, size: int = PROFILE) -> list[tuple[str, int, int]]:
    """(language, n-gram, rank) from text and lang of all rows where both are non-null.

    Counts cover every text.  A task sums its own before the shuffle; a profile is cut from the global sums, ties by
    number.  Languages without any letter in their texts have no profile.
    """
    spark = prepare(docs.sparkSession)

    def run(batches):
        claim("languages")
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}
        size_of: dict[str, int] = {}

        def add(lang):
            found, n = np.unique(np.concatenate([grams(c) for c in held.pop(lang)]), return_counts=True)
            size_of[lang] = 0
            if lang in total:
                both = np.concatenate([total[lang][0], found])
                found, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.concatenate([total[lang][1], n]), len(found)).astype(np.int64)
            total[lang] = found, n

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(c := folded(text))
                size_of[lang] = size_of.get(lang, 0) + len(c)
                if size_of[lang] >= CHUNK:
                    add(lang)
        for lang in list(held):
            add(lang)
        for lang, (found, n) in total.items():
            for lo in range(0, len(found), 50_000):
                part = found[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part), pa.array(n[lo : lo + 50_000])], names=["lang", "gram", "n"]
                )

    rows = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string"), F.col("text").cast("string").cast("binary").alias("text")
    )
    sums = rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # compared as it is, so that the planner keeps the first ones of every task before the shuffle
    top = profile_places(sums, size)
    return [(r.lang, r.gram, r.place - 1) for r in top.select("lang", "gram", "place").collect()]


def held_out(doc_id: str = "doc_id"):
    """Documents whose crc32(doc_id as text) mod 5 is 0 are never learnt from; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, ranks: list[tuple[str, int, int]], keep: list[str]) -> DataFrame:
    """``row`` (struct of the kept columns), lang_pred and score of every row.

    Null texts and texts without a letter get ``und`` and 0; so does everything where no language was learnt.  Equal
    distances go to the language that sorts first.  The whole text counts, however long.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(Profiles(ranks))

    def build():
        claim("languages")
        judge = shared.value.judge

        def work(texts):
            got = [judge(t) for t in texts]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return work

    return annotate(docs, "text", keep, "lang_pred string, score double", build)


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents in a language that the profiles recognise, with the columns that came in."""
    found = identify(docs, learn(docs.where(~held_out())), docs.columns)
    good = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return good.select(*[F.col("row." + quoted(c)).alias(c) for c in docs.columns])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learnt from those that are not held out.

    Null and empty texts and those without a letter are ``und`` with score 0; repeated rows are judged alike; ties go to the language
    that sorts first; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    ranks = learn(docs.where(~held_out()).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), ranks, ["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score"
    )
