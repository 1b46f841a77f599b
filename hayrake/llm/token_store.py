"""Token ids as canonical, length-limited Huffman blocks.

File format.  A store is a folder with two Parquet tables, so that any Hadoop file system can hold it
and Spark's commit protocol guards it:

* ``codebook``: (token_id, n, bits) - the code length of every id that occurs, from global counts.
  Codes are canonical: ids sorted by (bits, token_id) get consecutive codes, so lengths are enough.
* ``blocks``: one row per block, in ascending document order within a file
  (file_no, block_no, first_token, n_tokens, doc_ids, doc_tokens, marks, payload).
  ``payload`` holds the codes of the block, most significant bit first.  ``marks`` are the
  bit-offset checkpoints: the length in bits of each stretch of CHECKPOINT ids as little-endian
  uint16.  Every block can be decoded by itself, and every checkpoint is an entry point.

Decoding looks up a window of MAX_BITS bits in a table and advances all checkpoints of a block in
step, so the number of vector steps is CHECKPOINT, whatever the block's size.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordMemo, claim, coded_words, discard, passing, prepare, slices, stage_path, store

MAX_BITS = 20
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 18
MEMO_WORDS = 1_500_000
#: Characters of words that a memo holds before it restarts.
MEMO_CHARS = 24 << 20
#: Pre-tokens of words with punctuation that are kept apart.
MEMO_PARTS = 200_000
#: Bytes of text that are tokenised at a time.
SLICE = 12 << 20
#: A single space between two visible characters starts a pre-token of its own, whatever surrounds it.
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space but the space and the line feed; a text without any of it needs no search for its cuts.
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Words of ASCII and Latin letters, also several with one line feed between each two, and their pre-tokens.
_PLAIN = re.compile(" ?[!-~\xa1-\u024f]+(?:\n[!-~\xa1-\u024f]+)*")
_PLAIN_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ \n{_L}{_N}]+|\n")


def _visible_bytes() -> dict[int, int]:
    """Byte -> the character that byte-level BPE files write for it: unprintable bytes follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_VISIBLE = _visible_bytes()
_SPACE = chr(_VISIBLE[0x20])
_NOTHING, _BLANK = (pa.scalar(x, pa.large_string()) for x in ("", " "))

_RAW = (
    "file_no int, block_no int, first_token bigint, n_tokens bigint, "
    "doc_ids array<bigint>, doc_tokens array<bigint>, ids binary"
)
_PACKED = (
    "file_no int, block_no int, first_token bigint, n_tokens bigint, "
    "doc_ids array<bigint>, doc_tokens array<bigint>, marks binary, payload binary"
)


# ---------------------------------------------------------------- tokenising


class MemoTokenizer:
    """Whole-text ids of a byte-level BPE file of ``tokenizers``, with one look-up per word.

    BPE never merges across a pre-token boundary, and a single space between two visible characters is always
    such a boundary.  The text is cut there, the distinct words of a slice of texts are looked up, new ones are encoded once
    by the library, and ids are gathered by index.  Plain Latin words are cut further, so that "word," and "word" share the
    model's work; any other piece goes through the library's own pre-tokenizer.  The memo is bounded in words, ids and
    characters, so memory does not depend on the corpus.  All this holds for byte-level BPE without
    normaliser and without a space before the text; texts of any other file go to the library whole.
    """

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.lib, self.memo = Tokenizer.from_file(path), WordMemo(limit, MEMO_CHARS)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut, merges = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_word = (
            spec.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space", True)
            and cut.get("use_regex", True)
            and merges.get("type", "BPE") == "BPE"
            and not any(merges.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        self.model = self.lib.model
        names = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.letters_only = not any(n.strip().isalpha() for n in names)
        self.reset()

    def reset(self) -> None:
        self.memo.reset()
        self.parts: dict[str, tuple[int, ...]] = {}

    def _tokens(self, part: str) -> list[int]:
        """Ids of a pre-token of visible characters, with a space before it or none; ASCII stands for itself."""
        if part.isascii() and part != "\n":
            shown = _SPACE + part[1:] if part[0] == " " else part
        else:
            shown = part.encode().decode("latin-1").translate(_VISIBLE)
        return [t.id for t in self.model.tokenize(shown)]

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = tuple(self._tokens(part))
        return ids

    def _ids(self, piece: str):
        if self.letters_only and piece.isascii() and (piece[1:] if piece[0] == " " else piece).isalpha():
            return self._tokens(piece)
        if _PLAIN.fullmatch(piece) and not self.special.search(piece):
            ids = []
            for part in _PLAIN_PART.findall(piece):
                ids += self._part(part)
            return ids
        return self.lib.encode(piece, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> list:
        """Ids of words of the memo: those that start a text are marked by a space, all others have one before them."""
        return [self._ids(w[1:]) if w[:1] == " " and len(w) > 1 else () if w == " " else self._ids(" " + w) for w in words]

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether some space is not a cut between two visible characters."""
        return text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text) is not None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch(texts, add_special_tokens=False)]
        self.memo.prune()
        if len(self.parts) > MEMO_PARTS:
            self.parts = {}
        plain, odd = [], []
        for k, t in enumerate(texts):
            if t:
                (odd if self._odd(t) else plain).append(k)
        words, codes, ends = coded_words([texts[k] for k in plain], [_SAFE_CUT.split(texts[k]) for k in odd])
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
        later = np.ones(len(codes), bool)
        later[first] = False
        wanted = np.zeros(len(words), bool)
        wanted[codes[later]] = True
        heads = pc.binary_join_element_wise(_NOTHING, words.take(pa.array(codes[first])), _BLANK).dictionary_encode()
        place = np.full(len(words), -1, np.int64)
        found = self.memo.places(pa.concat_arrays([words.filter(pa.array(wanted)), heads.dictionary]), self._learn)
        n = int(wanted.sum())
        place[wanted] = found[:n]
        at = place[codes]
        at[first] = found[n:][heads.indices.to_numpy()]
        out = [np.empty(0, np.uint32)] * len(texts)
        for k, ids in zip([*plain, *odd], self.memo.gather(at, ends), strict=True):
            out[k] = ids
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> MemoTokenizer:
    return MemoTokenizer(path)


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenised_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, text) -> raw id blocks in ascending doc_id order (nulls first, then by text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = _tokenizer(tokenizer_path)
        claim("tokens", tok.reset, block=1 << 22)
        kind = _id_type(tok.lib.get_vocab_size())
        file_no, block_no, first = TaskContext.get().partitionId(), 0, 0
        ids, sizes, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            row = [[file_no], [block_no], [first], [held], [ids], [sizes], [b"".join(parts)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _RAW_ARROW, strict=True)], names=_RAW_NAMES)

        for b in batches:
            numbers = iter(b.column(0).to_pylist())
            for part in slices(b.column(1), SLICE):
                for got in tok.encode(part.to_pylist()):
                    doc_id = next(numbers)
                    ids.append(doc_id)
                    sizes.append(len(got) + 1)
                    parts += [got.astype(kind).tobytes(), np.array([end_id], kind).tobytes()]
                    held += len(got) + 1
                    if held >= block_tokens:
                        yield flush()
                        first, block_no = first + held, block_no + 1
                        ids, sizes, parts, held = [], [], [], 0
        if ids:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return ordered.mapInArrow(run, _RAW)


_RAW_NAMES = [c.split()[0] for c in _RAW.split(", ")]
_RAW_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


# ---------------------------------------------------------------- the code


def limited_lengths(weights: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive weights (package-merge)."""
    n = len(weights)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    if 1 << limit < n:
        raise ValueError(f"{limit} bits cannot name {n} ids")
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.float64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(row) // 2 * 2
        both = np.concatenate([leaves, row[0:even:2] + row[1:even:2]])
        by = np.argsort(both, kind="stable")
        row = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Consecutive codes over (bits, id); the shift at each longer length keeps them prefix-free."""
    order = np.lexsort((ids, bits))
    scaled = np.cumsum(np.concatenate([[0], 1 << (MAX_BITS - bits[order])]))[:-1]
    codes = np.empty(len(ids), np.int64)
    codes[order] = scaled >> (MAX_BITS - bits[order])
    return codes


def pack(values: np.ndarray, code_of: np.ndarray, bits_of: np.ndarray) -> tuple[bytes, bytes]:
    """Ids -> (checkpoint lengths, bits).  Each code is added into the 32-bit word where it starts."""
    if not len(values):
        return b"", b""
    size = bits_of[values].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word = start >> 5
    placed = code_of[values].astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[heads]] += np.add.reduceat(placed >> np.uint64(32), heads)
    words[word[heads] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), heads)
    marks = np.add.reduceat(size, np.arange(0, len(size), CHECKPOINT)).astype("<u2")
    return marks.tobytes(), words.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8]


def lookup_table(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of MAX_BITS bits: the id whose code it starts with, and that code's length."""
    order = np.lexsort((ids, bits))
    reach = 1 << (MAX_BITS - bits[order])
    ids_at, bits_at = np.repeat(ids[order], reach), np.repeat(bits[order], reach)
    rest = (1 << MAX_BITS) - len(ids_at)
    return (
        np.concatenate([ids_at, np.zeros(rest, ids_at.dtype)]).astype(np.uint32),
        np.concatenate([bits_at, np.ones(rest, bits_at.dtype)]).astype(np.uint8),
    )


def unpack(marks: bytes, payload: bytes, n: int, ids_at: np.ndarray, bits_at: np.ndarray) -> np.ndarray:
    """All ids of a block; every checkpoint is a lane, and all lanes move in step."""
    if not n:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    span = np.frombuffer(marks, "<u2").astype(np.int64)
    at = np.cumsum(span) - span
    out = np.zeros((CHECKPOINT, len(span)), np.uint32)
    last = n - (len(span) - 1) * CHECKPOINT
    for step in range(CHECKPOINT):
        if step == last:
            at = at[:-1]
        if not len(at):
            break
        key = (window[at >> 3] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)) & np.uint32((1 << MAX_BITS) - 1)
        out[step, : len(at)] = ids_at[key]
        at = at + bits_at[key]
    return out.T.reshape(-1)[:n]


# ---------------------------------------------------------------- store and read back


def token_counts(raw: DataFrame, vocabulary: int) -> DataFrame:
    """Global counts of ids: one row per id and task before the shuffle."""
    kind = _id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["token_id", "n"])

    return raw.select("ids").mapInArrow(run, "token_id bigint, n bigint").groupBy("token_id").agg(F.sum("n").alias("n"))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> str:
    """Tokenise documents and write a store at ``path``.

    Null and empty texts become the end id alone; repeated rows are kept, each as a document; rows with
    equal doc_id are ordered by text; null ids come first; an empty table makes an empty store.  Columns
    other than doc_id and text are ignored.  Only the codebook (at most the vocabulary) reaches the driver.
    """
    from tokenizers import Tokenizer

    spark = prepare(docs.sparkSession)
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    raw, raw_path = store(tokenised_blocks(docs, tokenizer_path, end_id), "ids")
    rows = sorted((r.token_id, r.n) for r in token_counts(raw, vocabulary).collect())
    ids, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    bits = limited_lengths(n)
    spark.createDataFrame(
        [(int(a), int(b), int(c)) for a, b, c in zip(ids, n, bits, strict=True)], "token_id bigint, n bigint, bits int"
    ).coalesce(1).write.parquet(f"{path}/codebook")
    code_of, bits_of = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
    code_of[ids], bits_of[ids] = canonical_codes(ids, bits), bits
    kind = _id_type(vocabulary)
    shared = spark.sparkContext.broadcast((code_of.astype(np.uint32), bits_of.astype(np.uint8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = shared.value
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                marks, payload = pack(np.frombuffer(one.column(6)[0].as_buffer(), kind), codes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [*one.columns[:6], pa.array([marks], pa.binary()), pa.array([payload], pa.binary())],
                    names=[*_RAW_NAMES[:6], "marks", "payload"],
                )

    raw.mapInArrow(run, _PACKED).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(spark, raw_path)
    return path


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a store: (doc_id, file_no, start_in_file, n_tokens, ids_crc32[, ids]) per document.

    ``ids`` are little-endian unsigned 32-bit integers, end id included, as ``ids_crc32`` is.
    """
    prepare(spark)
    rows = spark.read.parquet(f"{path}/codebook").select("token_id", "bits").collect()
    ids, bits = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    shared = spark.sparkContext.broadcast(lookup_table(ids, bits))
    schema = "doc_id bigint, file_no int, start_in_file bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_at, bits_at = shared.value
        for b in batches:
            for file_no, first, n, doc_ids, doc_tokens, marks, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = unpack(marks, payload, n, ids_at, bits_at)
                end = np.cumsum(np.array(doc_tokens, np.int64))
                start = end - doc_tokens
                raw = memoryview(got.astype("<u4").tobytes())
                cut = [raw[4 * s : 4 * e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([file_no] * len(doc_ids), pa.int32()),
                    pa.array(start + first),
                    pa.array(doc_tokens, pa.int64()),
                    pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in cut], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    blocks = spark.read.schema(_PACKED).parquet(f"{path}/blocks")
    return blocks.select("file_no", "first_token", "n_tokens", "doc_ids", "doc_tokens", "marks", "payload").mapInArrow(run, schema)


def with_global_start(spark: SparkSession, path: str, decoded: DataFrame) -> DataFrame:
    """Turn starts within a file into starts within the store.

    Files are ranges of doc_id in the order of file_no, so a running sum over one row per file is enough.
    """
    sizes = spark.read.schema(_PACKED).parquet(f"{path}/blocks").groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("file_no", F.coalesce(before, F.lit(0)).alias("file_start"))
    return decoded.join(starts, "file_no").withColumn("start", F.col("start_in_file") + F.col("file_start"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, stored and read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; repeated rows are documents of their own, in the order of their texts; null ids come
    first; an empty table gives an empty result; doc_ids that are no whole numbers are an error.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = passing(spark, write_store(docs, stage_path(spark, "store"), public_tokenizers.path("byte_bpe_50k.json")))
    found = with_global_start(spark, path, read_store(spark, path))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
