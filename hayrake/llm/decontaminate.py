"""Benchmark decontamination with a generalised suffix automaton of the test items.

All items go into one automaton over word numbers.  A document is streamed through it; the state and the
length of the longest suffix that matches are kept at each word, and a state knows which item windows end
there.  The stream only enters the automaton where two neighbouring words also stand side by side in some item;
elsewhere no match of two words can exist, and that test is vectorised.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, prepare, quoted, store, table

WINDOW = 10
#: Words of items in one automaton, which every executor holds; more items are taken in several passes.
AUTOMATON_WORDS = 100_000
#: Bytes that belong to words, after A-Z are lower-cased: 0-9, a-z and all of non-ASCII.
_WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TO_WORDS = bytes(c if c in _WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences, with item windows attached to its states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.number: dict[bytes, int] = {}
        seqs = [(k, [self.number.setdefault(w, len(self.number)) for w in ws]) for k, ws in items if ws]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self._attach(seqs, window)
        base = max(1, len(self.number))
        self.base = base
        pairs = {a * base + b for _, seq in seqs for a, b in zip(seq, seq[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        sizes = {min(window, len(seq)) for _, seq in seqs}
        self.shortest = min((n for n in sizes if n > 1), default=0)
        self.single: dict[int, list[str]] = {}
        for k, seq in seqs:
            for c in set(seq) if min(window, len(seq)) == 1 else ():
                self.single.setdefault(c, []).append(k)
        self.single_ids = np.array(sorted(self.single), np.int64)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that end in p's longest one and c."""
        step, link, length = self.step, self.link, self.length
        copy = self._new(length[p] + 1, dict(step[q]), link[q])
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._new(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _attach(self, seqs: list[tuple[str, list[int]]], window: int) -> None:
        """ends[s]: (window length, items) of all windows among the suffixes that state s stands for."""
        own: dict[int, dict[int, set[str]]] = {}
        for k, seq in seqs:
            size, state = min(window, len(seq)), 0
            for i, c in enumerate(seq):
                state = self.step[state][c]
                if i + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    own.setdefault(at, {}).setdefault(size, set()).add(k)
        self.ends: list[tuple] = [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            mine = tuple((n, frozenset(ks)) for n, ks in sorted(own.get(s, {}).items()))
            self.ends[s] = self.ends[self.link[s]] + mine

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items of which a window occurs."""
        hit, items = np.zeros(len(words), bool), set()
        if not words or not self.number:
            return hit, items
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        if len(self.single_ids):
            alone = np.isin(ids, self.single_ids)
            hit |= alone
            for c in np.unique(ids[alone]):
                items.update(self.single[int(c)])
        if not self.shortest or len(words) < 2:
            return hit, items
        known = ids >= 0
        both = np.flatnonzero(known[1:] & known[:-1])
        code = ids[both] * self.base + ids[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        linked = both[self.pairs[at] == code] if len(self.pairs) else both[:0]
        if not len(linked):
            return hit, items
        gap = np.flatnonzero(np.diff(linked) > 1)
        first, last = linked[np.concatenate([[0], gap + 1])], linked[np.concatenate([gap, [len(linked) - 1]])] + 1
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a + 1 >= self.shortest:
                self._stream(ids[a : b + 1].tolist(), a, hit, items)
        return hit, items

    def _stream(self, run: list[int], at: int, hit: np.ndarray, items: set[str]) -> None:
        step, link, length, ends = self.step, self.link, self.length, self.ends
        state = matched = 0
        for i, c in enumerate(run):
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            if c in step[state]:
                state, matched = step[state][c], matched + 1
            for size, of in ends[state]:
                if size > matched:
                    break
                hit[at + i + 1 - size : at + i + 1] = True
                items |= of


_HIT = "n_words bigint, spans array<struct<first:bigint,past:bigint>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, bound: int = AUTOMATON_WORDS, clean: bool = False) -> DataFrame:
    """Find item windows in documents.

    Returns ``row`` (struct of the kept columns), n_words, spans (merged runs of hit words, numbered from 0) and
    items (ids as strings, sorted) per row.  A window is ``window`` consecutive words of an item, or the whole
    of a shorter one.  Null and empty texts have no words and no hits; items without words or without an id never
    occur; rows of an equal item id are searched one by one and count as one item; repeated documents are each
    scanned.  ``bound`` limits the words of an automaton: items beyond it form further automata, and the documents
    are scanned once for each of them, carrying what was found so far.  With ``clean`` a column of that name has
    the text without its spans, so that whole texts go to Python and back once.
    """
    spark = prepare(docs.sparkSession)
    sized = benchmark.select(
        F.col("item_id").cast("string").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    ).where("id is not null")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // (4 * bound)))
    found = docs.select(
        (F.struct(*[F.col(quoted(c)) for c in keep]) if keep else F.struct(F.lit(0).alias("_"))).alias("row"),
        F.col("text").cast("string").cast("binary").alias("text"),
        F.expr("cast(array() as array<struct<first:bigint,past:bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    for k in range(passes):
        mine = sized if passes == 1 else sized.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k)
        rows = [(r.id, words_of(bytes(r.text))) for r in mine.toLocalIterator()]
        found = _pass(found, spark.sparkContext.broadcast(SuffixAutomaton(rows, window)), k == passes - 1, clean)
        if k < passes - 1:
            found, _ = store(found, "decontaminate")
    return found


def _pass(found: DataFrame, shared, last: bool, clean: bool) -> DataFrame:
    spark = found.sparkSession
    clean = clean and last
    extra = spark.createDataFrame([], _HIT + ", clean string" * clean).schema
    carried = [found.schema["row"]] + ([] if last else [found.schema["text"]])
    schema = type(extra)([*carried, *extra.fields])

    def run(batches):
        claim("items")
        machine = shared.value
        for b in batches:
            n, spans, items, left = [], [], [], []
            for t, old, had in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = words_of(t)
                hit, of = machine.matches(words)
                for s in old:
                    hit[s["first"] : s["past"]] = True
                n.append(len(words))
                spans.append([{"first": x, "past": y} for x, y in spans_of(hit)] if of or old else [])
                items.append(sorted({*of, *had}))
                if clean:
                    left.append(cut(t, [(x["first"], x["past"]) for x in spans[-1]]) if spans[-1] else t)
            new = [pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), *([pa.array(left, pa.binary()).cast(pa.string())] if clean else [])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], *new], names=schema.names)

    return found.select("row", "text", "spans", "items").mapInArrow(run, schema)


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text without the word spans; a span goes from its first word's first byte to its last word's last."""
    at = [m.span() for m in _WORD.finditer(raw)]
    kept, done = [], 0
    for first, past in spans:
        kept.append(raw[done : at[first][0]])
        done = at[past - 1][1]
    return b"".join([*kept, raw[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.8) -> DataFrame:
    """Documents without benchmark passages, with the columns that came in.

    Every run of words that item windows cover is removed from ``text``; a document of which they cover more than
    ``coverage`` of the words is removed whole.  ``n_chars``, where it is a column, follows the text.  All other
    documents, those with null or empty text included, stay as they are.
    """
    found = scan(docs, benchmark, [c for c in docs.columns if c != "text"], window, clean=True)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["past"] - s["first"])
    kept = found.where(n_hit <= F.lit(coverage) * F.col("n_words"))
    columns = []
    for c in docs.columns:
        if c == "text":
            col = F.col("clean").cast(docs.schema[c].dataType)
        elif c == "n_chars":
            col = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars"))
        else:
            col = F.col("row." + quoted(c))
        columns.append(col.alias(c))
    return kept.select(*columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that item windows cover, and the items that have such windows.

    Null and empty texts and items have no words; repeated documents have equal results, repeated items count by their id; an empty
    benchmark hits nothing; an empty table of documents gives an empty result.
    """
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = scan(docs.select("doc_id", "text"), benchmark, ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["past"] - s["first"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The same by joining windows: hashed windows of items against every place in the documents.
OP6_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
         array_to_string(list_slice(w, i + 1, i + least(10, len(w))), ' ') AS win
  FROM item_words, unnest(range(0, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i + 1, i + size), ' ') AS win
  FROM doc_words, (SELECT DISTINCT size FROM windows) s, unnest(range(0, len(w) - size + 1)) AS t(i) WHERE len(w) >= size),
found AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows USING (size, win)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, size)) AS t(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
