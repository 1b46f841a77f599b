"""URL filter: host rules, then word segmentation and multinomial naive Bayes for what no rule judges.

Names such as ``cheappills`` are split by unigram Viterbi.  The unigrams are words of running text (the visible text of the
pages, or any other text that is given; without one the words of the paths), never the names that are to be split: a
name would else be a word of its own as soon as it is frequent.  Naive Bayes then scores the words of host and path; it learns
from the URLs that the rules judge and from nothing else, so multiplying all rows changes no verdict but through
SMOOTHING and the prior's added ones.

Both models are over all words: counts and weights are tables, and distinct letter runs are joined with them.  Only the
split and weights of the most frequent runs are broadcast; URLs with others join the table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, prepare, quoted, store, table

#: (verdict, host, path prefix): a rule fits its host and all subdomains, the longest wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Most letter runs whose split and weights executors hold, by count; the others are joined, so no result depends on it.
MODEL_WORDS = 100_000
#: Longest word of the unigram model; longer runs of letters are split into such.
LONGEST = 24
#: Words up to this length are few whatever the input (26 + 26**2 + 26**3), and so are broadcast whole.
SHORT = 3
SMOOTHING = 1.0
_TOKEN = "[A-Za-z]+"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where no :// is."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as text, or null.  Rules of equal length: the first in order of text."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


class Segmenter:
    """Most probable split of letters into words; an unknown string of n letters has 10 / (total * 10**n)."""

    def __init__(self, counts: dict[str, int], total: int = 0):
        self.total = max(total or sum(counts.values()), 20)
        self.score = {w: math.log(n / self.total) for w, n in counts.items() if n and len(w) <= LONGEST}
        self.memo: dict[str, list[str]] = {}

    def unknown(self, n: int) -> float:
        return math.log(10 / self.total) - n * math.log(10)

    def words(self, name: str) -> list[str]:
        if name in self.memo:
            return self.memo[name]
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            top, at = None, end - 1
            for start in range(max(0, end - LONGEST), end):
                piece = name[start:end]
                s = best[start] + (self.score[piece] if piece in self.score else self.unknown(end - start))
                if top is None or s > top:
                    top, at = s, start
            best.append(top)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[name] = out[::-1]
        return self.memo[name]

    def tokens(self, host: str, path: str) -> tuple[list[str], list[str]]:
        """Words of the host, and of the path marked so that they are features of their own."""
        cut = lambda s: [w for t in re.findall(_TOKEN, s) for w in self.words(t.lower())]
        return cut(host), ["/" + w for w in cut(path)]


class NaiveBayes:
    """Multinomial, with SMOOTHING on the known vocabulary; unknown words say nothing."""

    def __init__(self, rows: Iterable[tuple[str, str, int]], docs: dict[str, int]):
        self.counts: dict[str, list[int]] = {}
        total = [0, 0]
        for verdict, word, n in rows:
            k = int(verdict == "block")
            self.counts.setdefault(word, [0, 0])[k] += n
            total[k] += n
        size = len(self.counts)
        self.weight = {
            w: math.log((b + SMOOTHING) / (total[1] + SMOOTHING * size)) - math.log((a + SMOOTHING) / (total[0] + SMOOTHING * size))
            for w, (a, b) in self.counts.items()
        }
        self.prior = math.log((docs.get("block", 0) + 1) / (docs.get("allow", 0) + 1))

    def p_block(self, words: list[str]) -> float:
        return chance(self.prior + sum(self.weight.get(w, 0.0) for w in words))


def chance(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def _parsed(pages: DataFrame, rules) -> DataFrame:
    host, path = split_url(F.col("url"))
    whole = F.struct(*[F.col(quoted(c)) for c in pages.columns])
    out = pages.select(whole.alias("row"), host.alias("host"), path.alias("path"))
    verdicts = F.lit(None).cast("string")
    for v, h, p in rules:
        verdicts = F.when(F.col("rule") == h + p, F.lit(v)).otherwise(verdicts)
    return out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdicts)


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    return F.regexp_replace(html.cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def word_counts(text: DataFrame, column: Column) -> DataFrame:
    """word, n: counts of the letter runs (A-Z lower-cased) of a text column, up to LONGEST letters."""
    runs = F.regexp_extract_all(F.lower(column), F.lit("(?<![^\\x00-\\x7f])[a-z]+(?![^\\x00-\\x7f])"), F.lit(0))
    counts = text.select(F.explode(runs).alias("word")).where(F.length("word") <= LONGEST)
    return counts.groupBy("word").agg(F.count("*").alias("n"))


def token_counts(parsed: DataFrame) -> DataFrame:
    """mark, token, n, allow, block: how often each letter run stands in hosts and (mark /) paths, and how often by verdict of a rule."""

    def runs(name, mark):
        found = F.regexp_extract_all(F.col(name), F.lit(_TOKEN), F.lit(0))
        return F.transform(found, lambda t: F.struct(F.lit(mark).alias("mark"), F.lower(t).alias("token")))

    each = parsed.select("by_rule", F.explode(F.concat(runs("host", ""), runs("path", "/"))).alias("t")).select("by_rule", "t.*")
    verdicts = [F.count_if(F.col("by_rule") == v).alias(v) for v in ("allow", "block")]
    return each.groupBy("mark", "token").agg(F.count("*").alias("n"), *verdicts)


def segmented(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """token, words: every distinct token, split over all words of counts.

    The parts of a token are joined with the counts.  They come back under a hash of the token, as long tokens have
    many parts; where two tokens share a hash, each only sees true counts of words that it does not hold.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    short = {r.word: r.n for r in counts.where(F.length("word") <= SHORT).collect()}
    keyed = tokens.select("token").distinct().withColumn("key", F.xxhash64("token"))

    def parts(batches):
        for b in batches:
            for token, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at in range(0, len(token), 2000):
                    starts = range(at, min(at + 2000, len(token)))
                    found = list({token[i:j] for i in starts for j in range(i + SHORT + 1, min(len(token), i + LONGEST) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found, pa.string())], names=["key", "word"])

    known = keyed.mapInArrow(parts, "key bigint, word string").join(counts.where(F.length("word") > SHORT), "word")
    known = known.groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    def cut(batches):
        for b in batches:
            tokens, known = (c.to_pylist() for c in b.columns)
            seg = Segmenter(short | {w["word"]: w["n"] for k in known for w in k or ()}, total)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([seg.words(t) for t in tokens], pa.list_(pa.string()))], names=["token", "words"])

    return keyed.join(known, "key", "left").select("token", "known").mapInArrow(cut, "token string, words array<string>")


def weighted(tokens: DataFrame, cuts: DataFrame) -> DataFrame:
    """mark, token, n, words, weights: every token's features and their naive Bayes weights, over all words; 0 for unknown ones."""
    named = F.transform("words", lambda w: F.concat("mark", w))
    split = tokens.join(cuts, "token").select("mark", "token", "n", "allow", "block", F.posexplode(named).alias("pos", "word"))
    seen = split.where("allow + block > 0").select("word", "allow", "block")
    features = seen.groupBy("word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    size, allow, block = (x or 0 for x in features.agg(F.count("*"), F.sum("allow"), F.sum("block")).first())
    rate = lambda v, total: F.log((F.col(v) + SMOOTHING) / (total + SMOOTHING * size))
    weights = features.select("word", (rate("block", block) - rate("allow", allow)).alias("weight"))
    part = F.struct("pos", "word", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    whole = split.select("mark", "token", "n", "pos", "word").join(weights, "word", "left").groupBy("mark", "token")
    whole = whole.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select("mark", "token", "n", F.col("parts.word").alias("words"), F.col("parts.weight").alias("weights"))


def judge(pages: DataFrame, rules=RULES, unigrams: DataFrame | None = None) -> DataFrame:
    """``row`` (struct of all columns), host, path, rule, verdict, p_block, words of every row.

    ``unigrams`` (word, n) are the words into which names are split; those of the paths where none are given.  Null URLs and those without :// have empty host and path, fit no rule and get the prior's verdict.  Equal odds
    allow.  Repeated rows count as often as they occur.  An empty table gives none.
    """
    spark = prepare(pages.sparkSession)
    parsed = _parsed(pages, rules)
    slim = _parsed(pages.select("url"), rules).drop("row")
    docs = {r.by_rule: r["count"] for r in slim.where("by_rule is not null").groupBy("by_rule").count().collect()}
    prior = NaiveBayes([], docs).prior
    counts, counts_at = store(word_counts(slim, F.col("path")) if unigrams is None else unigrams, "url-words")
    tokens, tokens_at = store(token_counts(slim), "url-tokens")
    cuts, cuts_at = store(segmented(tokens, counts), "url-cuts")
    split, split_at = store(weighted(tokens, cuts), "url-weights")
    for at in (counts_at, tokens_at, cuts_at):
        discard(spark, at)
    top = split.orderBy(F.desc("n"), "mark", "token").limit(MODEL_WORDS).collect()
    shared = spark.sparkContext.broadcast({(r.mark, r.token): (r.words, r.weights) for r in top})
    carried = ["row", "host", "path", "rule", "by_rule"]
    extra = spark.createDataFrame([], "p_block double, words array<string>").schema
    schema = type(extra)([*(parsed.schema[c] for c in carried), *extra.fields])

    def keys(host, path):
        return [(mark, t.lower()) for mark, s in (("", host), ("/", path)) for t in re.findall(_TOKEN, s)]

    def score(batches):
        """Rows with a token that is neither shared nor in a further column ``more`` get null."""
        for b in batches:
            more = b.column(len(carried)).to_pylist() if b.num_columns > len(carried) else [()] * b.num_rows
            odds, words = [], []
            for host, path, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), more, strict=True):
                held = {(m["mark"], m["token"]): (m["words"], m["weights"]) for m in own}
                parts = [shared.value.get(k) or held.get(k) for k in keys(host, path)]
                whole = None not in parts
                odds.append(chance(prior + sum(x for _, weights in parts for x in weights)) if whole else None)
                words.append([w for ws, _ in parts for w in ws] if whole else None)
            arrays = [*b.columns[: len(carried)], pa.array(odds, pa.float64()), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def lacking(batches):
        for b in batches:
            rows = [(h, p, *k) for h, p in zip(*(c.to_pylist() for c in b.columns), strict=True) for k in set(keys(h, p)) if k not in shared.value]
            arrays = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "path", "mark", "token"])

    scored = parsed.select(*carried).mapInArrow(score, schema)
    if len(top) < MODEL_WORDS:
        discard(spark, split_at)
    else:
        # the tokens not shared are rare, so no key of these joins has many rows
        left = scored.where("p_block is null").select(*carried)
        lacked = left.select("host", "path").distinct().mapInArrow(lacking, "host string, path string, mark string, token string")
        found = lacked.join(split.drop("n"), ["mark", "token"]).groupBy("host", "path")
        found = found.agg(F.collect_list(F.struct("mark", "token", "words", "weights")).alias("more"))
        rest = left.join(found, ["host", "path"]).select(*carried, "more").mapInArrow(score, schema)
        scored = scored.where("p_block is not null").unionByName(rest)
    verdict = F.coalesce("by_rule", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return scored.select("row", "host", "path", "rule", verdict.alias("verdict"), "p_block", "words")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every page; unigrams are the words of the visible text of all pages.

    Null, empty and scheme-less URLs have empty host and path and get the prior's verdict; repeated rows are judged alike and
    count as often as they occur; an empty table gives none; null markup has no words.
    """
    pages = table(spark, sf_dir, "pages")
    unigrams = word_counts(pages, visible_text(F.col("html")))
    found = judge(pages.select("page_id", "url"), unigrams=unigrams)
    return found.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "p_block", F.array_join("words", " ").alias("words"))
