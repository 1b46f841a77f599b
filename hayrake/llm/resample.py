"""Importance resampling towards a target: hashed word n-grams, counted by DuckDB within Spark's partitions.

Each task hands slices of its texts to a DuckDB of its own, which unnests the words, windows them into n-grams, takes their CRC by
a registered function and counts buckets per document.  The counts are written as a Parquet table; Spark adds up the buckets of
raw and target texts, turns them into gains and scores every document.  Gumbel noise from the document's id makes the draw of
the highest scores a sample without replacement.  Ranks come from range partitions and offsets, so no task sees all rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, discard, prepare, quoted, store, table

WIDTH, BUCKETS = 2, 10_000
SEED, SHARE, LEAST_WORDS = 7, 25, 20
#: Bytes of one piece of a text, and of the pieces that DuckDB takes at once.
PIECE, SLICE = 1 << 18, 4 << 20
#: Bytes up to which the CRC of many strings is taken in step.
_STEPS = 64
_WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TO_WORDS = bytes(c if c in _WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


def crc32(words: pa.Array) -> pa.Array:
    """zlib's CRC of every string: byte by byte over all strings at once, the few long ones by zlib itself."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    data = words.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    start = ends[:-1][order]
    at_least = np.bincount(np.minimum(size, _STEPS + 1), minlength=_STEPS + 2)[::-1].cumsum()[::-1]
    crc, known = np.full(len(data), 0xFFFFFFFF, np.uint32), _crc_table()
    for j in range(_STEPS):
        n = at_least[j + 1]
        if not n:
            break
        crc[:n] = known[(crc[:n] ^ raw[start[:n] + j]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(data), np.uint32)
    out[order] = ~crc
    for i in order[: at_least[_STEPS + 1]]:
        out[i] = zlib.crc32(raw[ends[i] : ends[i + 1]])
    return pa.array(out)


def _pieces(words: bytes, width: int):
    """(own and following words, number of following ones) of a text of words and spaces, in pieces of about PIECE bytes."""
    lo = 0
    while len(words) - lo > PIECE:
        hi = words.find(b" ", lo + PIECE)
        if hi < 0:
            break
        # the n-grams that start in a piece need the next words; a look-ahead of growing size finds them
        ahead, reach = [], 64
        while True:
            cut = words[hi : hi + reach]
            ahead = cut.split(None, width)
            if len(ahead) > width or hi + reach >= len(words):
                break
            reach *= 4
        ahead = ahead[: width - 1]
        yield words[lo:hi] + b" " + b" ".join(ahead), len(ahead)
        lo = hi
    yield words[lo:], 0


def _grams_sql(width: int) -> str:
    leads = "".join(f", lead(w, {j}) OVER p AS w{j}" for j in range(1, width))
    # single words need no window, and pieces no look-ahead
    window = "WINDOW p AS (PARTITION BY piece ORDER BY i) QUALIFY i <= own" if width > 1 else ""
    return f"""
CREATE OR REPLACE TEMP TABLE grams AS SELECT k, w{leads} FROM (
  SELECT k, piece, own, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (
    SELECT k, piece, ws, len(ws) - ahead AS own FROM (
      SELECT k, piece, ahead, list_filter(string_split(words, ' '), lambda x: x <> '') AS ws FROM slice)))
{window}"""


def _counts_sql(width: int, buckets: int) -> str:
    runs = [" || ' ' || ".join(["w", *(f"w{j}" for j in range(1, n))]) for n in range(1, width + 1)]
    each = " UNION ALL ".join(f"SELECT k, crc32({run}) % {buckets} AS bucket FROM grams WHERE {f'w{n} IS NOT NULL' if n else 'true'}" for n, run in enumerate(runs))
    return f"SELECT k, bucket::INTEGER AS bucket, count(*) AS n FROM ({each}) GROUP BY ALL"


@lru_cache(maxsize=1)
def _engine():
    """The worker's DuckDB: one thread, memory only."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
    con.create_function("crc32", crc32, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def _release() -> None:
    if _engine.cache_info().currsize:
        _engine().close()
        _engine.cache_clear()


def _slices(texts: list[bytes | None], width: int):
    """Runs of (text number, words, following words) of about SLICE bytes."""
    out, size = [], 0
    for k, text in enumerate(texts):
        for words, ahead in _pieces((text or b"").translate(_TO_WORDS), width):
            out.append((k, words, ahead))
            size += len(words)
            if size >= SLICE:
                yield out
                out, size = [], 0
    if out:
        yield out


def _count(texts: list[bytes | None], width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; then text number, bucket and count, in that order."""
    con, n_words, found = _engine(), np.zeros(len(texts), np.int64), []
    for rows in _slices(texts, width):
        ks, words, ahead = zip(*rows, strict=True)
        con.register("slice", pa.table({"k": pa.array(ks, pa.int32()), "piece": pa.array(range(len(ks)), pa.int32()), "words": [w.decode("utf-8", "replace") for w in words], "ahead": pa.array(ahead, pa.int32())}))
        con.execute(_grams_sql(width))
        got = con.sql("SELECT k, count(*) AS n FROM grams GROUP BY k").to_arrow_table()
        n_words[got["k"].to_numpy()] += got["n"].to_numpy()
        got = con.sql(_counts_sql(width, buckets)).to_arrow_table()
        found.append((got["k"].to_numpy().astype(np.int64) * buckets + got["bucket"].to_numpy(), got["n"].to_numpy().astype(np.int64)))
        con.unregister("slice")
    con.execute("DROP TABLE IF EXISTS grams")
    code, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    n = np.bincount(at, np.concatenate([n for _, n in found]) if found else [], len(code)).astype(np.int64)
    return n_words, code // buckets, code % buckets, n


def bucket_counts(docs: DataFrame, keep: list[str], width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """``row`` (struct of the kept columns), n_words, and the text's buckets with their counts, as two arrays."""
    kept = F.struct(*[F.col(quoted(c)) for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    slim = docs.select(kept.alias("row"), F.col("text").cast("string").cast("binary").alias("text"))
    kind = slim.schema["row"].dataType.simpleString()

    def run(batches):
        claim("resample", _release)
        for b in batches:
            n_words, k, bucket, n = _count(b.column(1).to_pylist(), width, buckets)
            ends = pa.array(np.searchsorted(k, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((bucket, pa.int32()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), *lists], names=["row", "n_words", "buckets", "counts"])

    return slim.mapInArrow(run, f"row {kind}, n_words bigint, buckets array<int>, counts array<bigint>")


def _summed(counts: DataFrame, name: str) -> DataFrame:
    """(bucket, count): all texts' counts added up, within tasks first."""
    each = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: the gain of every bucket, as an array by bucket number; ``buckets`` numbers, whatever the input's size."""
    both = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(_summed(raw, "s"), "bucket", "left").join(_summed(target, "t"), "bucket", "left")
    rows = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    # partial sums of whole numbers are exact, so the totals are the same in any order
    total = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    gain = F.struct(F.col("bucket"), F.floor(F.log(ratio) * 1000).alias("gain"))
    ordered = F.array_sort(F.collect_list(gain))
    return rows.crossJoin(total).agg(F.transform(ordered, lambda x: x["gain"]).alias("gains"))


def _noise(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def scores(counts: DataFrame, gained: DataFrame, seed: int = SEED) -> DataFrame:
    """``row``, n_words, n_features, weight and score of every text of ``bucket_counts``."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    # one row of ``buckets`` numbers beside every text
    both = counts.crossJoin(F.broadcast(gained))
    parts = F.zip_with("buckets", "counts", lambda b, n: F.get("gains", b) * n)
    summed = both.select("row", "n_words", total(F.col("counts")).alias("n_features"), total(parts).alias("gain"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("bigint")
    return summed.select("row", "n_words", "n_features", weight.alias("weight"), (weight + _noise(F.col("row.doc_id"), seed)).cast("bigint").alias("score"))


def drawn(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> tuple[DataFrame, list[str]]:
    """Add ``rank`` to stored scores: the highest ``share`` percent of texts with enough words, from 1; null for the rest.

    Ties go to the smaller doc_id (nulls last), then to fewer features and the smaller weight; whole ties are repeated rows.
    """
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    flat = scored.select("*", F.col("row.doc_id").alias("doc_id"))
    ordered = flat.where(able).repartitionByRange(*by).sortWithinPartitions(*by)
    placed, path = store(ordered.withColumn("place", F.monotonically_increasing_id()), "resample-order")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("start") + row + 1
    numbered = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    chosen = F.when(rank <= F.floor(F.col("all") * share / 100), rank).cast("bigint")
    columns = ["row", "n_words", "n_features", "weight", "score"]
    rest = scored.where(~able).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return numbered.select(*columns, chosen.alias("rank")).unionByName(rest), [path]


def resample(docs: DataFrame, target: DataFrame, keep: list[str], share: int = SHARE, seed: int = SEED, width: int = WIDTH, buckets: int = BUCKETS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``row`` (struct of ``keep``, doc_id among them), n_words, n_features, weight, score and rank of every row of ``docs``."""
    spark = prepare(docs.sparkSession)
    raw, raw_path = store(bucket_counts(docs, keep, width, buckets), "resample-raw")
    wanted, target_path = store(bucket_counts(target, [], width, buckets), "resample-target")
    scored, _ = store(scores(raw, gains(raw, wanted, buckets), seed), "resample-scores")
    for path in (raw_path, target_path):
        discard(spark, path)
    return drawn(scored, share, least_words)[0]


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's n-grams.

    Null and empty texts have no features, weight 0 and no rank; rows that repeat a doc_id are documents of their own with equal
    noise; equal scores go to the smaller doc_id.  Whole texts count, in pieces where they are long.  An empty benchmark
    leaves a gain that falls with a bucket's frequency; an empty table gives an empty result.
    """
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = resample(docs.select("doc_id", "text"), target.select("text"), ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_sql(source: str) -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT r, list_filter(string_split_regex({low}, '{_SEPARATORS}'), lambda w: w <> '') AS ws FROM (SELECT row_number() OVER () AS r, text FROM {source})"


def _features_sql(words: str) -> str:
    return f"SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM {words}"


OP13_SQL = rf"""
WITH RECURSIVE bits(n, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS crc_table FROM bits WHERE k = 8),
numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
doc_words AS ({_words_sql("documents").replace("(SELECT row_number() OVER () AS r, text FROM documents)", "numbered")}),
item_words AS ({_words_sql("benchmark")}),
doc_features AS ({_features_sql("doc_words")}), item_features AS ({_features_sql("item_words")}),
named AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM doc_features UNION SELECT f FROM item_features)),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1),
    lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM named, crc),
raw AS (SELECT bucket, count(*) AS s FROM doc_features JOIN hashed USING (f) GROUP BY 1),
target AS (SELECT bucket, count(*) AS t FROM item_features JOIN hashed USING (f) GROUP BY 1),
sums AS (SELECT range AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range({BUCKETS}) LEFT JOIN raw ON range = raw.bucket LEFT JOIN target ON range = target.bucket),
gained AS (SELECT bucket, floor(ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))) * 1000)::BIGINT AS gain FROM sums),
weighed AS (SELECT r, count(*)::BIGINT AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM doc_features JOIN hashed USING (f) JOIN gained USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)) * -1000)::BIGINT AS score
  FROM numbered LEFT JOIN doc_words USING (r) LEFT JOIN weighed USING (r)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
    count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= n * {SHARE} // 100 THEN place END AS rank FROM ordered
"""
