"""SentencePiece encoding and decoding with a Viterbi search that shares prefixes.

A text is cut into marked words: a run of spaces (as U+2581) and what follows up to the next space.  No piece has
a mark behind another character, so the best segmentation of a text is that of its marked words one by
one.  The distinct new words of a batch are sorted, which makes them the leaves of a trie in depth-first order; the
forward scores along the common prefix with the word before are reused, and only the rest is scored.
Scores at a position depend on the prefix alone, because each position pulls from the pieces that end there.

In a unigram model the forward score is the highest sum of piece scores, and of equal ones that with the longest last
piece wins.  In a BPE model scores are merge ranks, whose sum means nothing: the right segmentation is the one that merging
yields.  A row of pieces is that one exactly if each two neighbours are (merging the two joined gives the two back),
and every prefix has only one.  So the forward score of a position is then whether a piece may end there behind the last
piece of its start's own prefix, and the search is the same otherwise.  Characters that no piece covers become bytes, or
the unknown id where the model has no byte pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordMemo, annotate, claim, coded_words, prepare, table

MARK = "▁"
_MARK = MARK.encode()
MEMO_WORDS = 600_000
#: Characters of words that a memo holds before it restarts.
MEMO_CHARS = 24 << 20
MEMO_PAIRS = 200_000
_CHUNK = re.compile(" +[^ ]*|[^ ]+")
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message: ints, or bytes for nested ones, strings and floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + n]
            at += n


class PieceModel:
    """Pieces of a model file, and ids of texts."""

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        self.prefix, self.squeeze, self.merging = True, True, False
        for number, value in _fields(raw):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, bytes(4)))[0], got.get(3, NORMAL)))
            elif number == 2:
                self.merging = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                got = dict(_fields(value))
                self.prefix, self.squeeze = bool(got.get(3, 1)), bool(got.get(4, 1))
        usable = [(p, s, k) for k, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER)]
        if any(MARK in p.lstrip(MARK) for p, _, _ in usable):
            raise ValueError("a piece has a mark behind another character; marked words cannot be encoded one by one")
        self.unknown = next(k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.rank = {p: s for p, s, _ in usable}
        #: Whether a piece may follow another, by (id of the left one + 1, or 0 for none) * number of pieces + id of the right one.
        self.pairs: dict[int, bool] = {}
        self.unknown_score = min(s for _, s, _ in usable) - 10.0
        #: Pieces by their characters from last to first; the key "" holds (score, id).
        self.tails: dict = {}
        for p, s, k in usable:
            node = self.tails
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = (s, k)
        self.bytes_of = [self._bytes(p, t) for p, _, t in self.pieces]
        self.byte_column = pa.array(self.bytes_of, pa.large_binary())
        self.memo = WordMemo(limit, MEMO_CHARS)
        self.reset()

    def reset(self) -> None:
        self.memo.reset()
        self.pairs.clear()

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    # ------------------------------------------------------------ encoding

    def keys(self, text: str) -> list[str]:
        """The marked words of a text, each without its first mark."""
        text = text.replace(MARK, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(" " + text)]

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: always the best-ranked pair, of equal ones the leftmost."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            found = [(-rank[j], k) for k in range(len(parts) - 1) if (j := parts[k] + parts[k + 1]) in rank]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fits(self, key: int, left: str, right: str) -> bool:
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        fits = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return fits

    def _choose_pair(self, word: str, end: int, last: list[tuple[int, int]]) -> tuple[int, int]:
        """The piece that ends at ``end`` in the one segmentation of word[:end].

        A character that no piece covers merges with nothing, so behind it a piece stands as it does at the start.
        """
        node, at, ending, pairs, size = self.tails, end, [], self.pairs, len(self.pieces)
        while at:
            node = node.get(word[at - 1])
            if node is None:
                break
            at -= 1
            if "" in node:
                ending.append((at, node[""][1]))
        for at, k in reversed(ending):
            left = last[at][1] if at else -1
            key = (left + 1) * size + k
            fits = pairs.get(key)
            if fits or fits is None and self._fits(key, word[last[at][0] : at] if left >= 0 else "", word[at:end]):
                return at, k
        return end - 1, -1

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted marked words."""
        best, back, before, out = [0.0], [(0, 0)], "", []
        tails, worst = self.tails, self.unknown_score
        for word in words:
            same = len(commonprefix((before, word)))
            del best[same + 1 :], back[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                if self.merging:
                    best.append(0.0)
                    back.append(self._choose_pair(word, end, back))
                    continue
                node, at, top, choice, single = tails, end, None, None, False
                while at:
                    node = node.get(word[at - 1])
                    if node is None:
                        break
                    at -= 1
                    if "" in node:
                        single = single or at == end - 1
                        score = best[at] + node[""][0]
                        if top is None or score >= top:
                            top, choice = score, (at, node[""][1])
                if not single and (top is None or best[end - 1] + worst > top):
                    top, choice = best[end - 1] + worst, (end - 1, -1)
                best.append(top)
                back.append(choice)
            ids, at = [], len(word)
            while at:
                start, k = back[at]
                if k >= 0:
                    ids.append(k)
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in reversed(word[start].encode("utf-8", "replace"))]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
                at = start
            out.append(ids[::-1])
            before = word
        return out

    def _learn(self, words: list[str]) -> list[list[int]]:
        """Segment new words in sorted order, so that those with a common prefix are neighbours.

        A mark stands before a word, but not before one that starts a text without one: the memo has those behind a mark.
        """
        marked = [k[1:].replace(" ", MARK) if k.startswith(MARK) else MARK + k.replace(" ", MARK) for k in words]
        order = sorted(range(len(words)), key=marked.__getitem__)
        out: list = [()] * len(words)
        for k, ids in zip(order, self.segment([marked[k] for k in order]), strict=True):
            out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text.  The distinct words of all texts are looked up once, and ids are gathered by index."""
        self.memo.prune()
        odd, plain = [], []
        for k, t in enumerate(texts):
            if not t:
                continue
            t = t.replace(MARK, " ")
            if "  " in t or t[0] == " " or t[-1] == " ":
                if keys := self.keys(t):
                    odd.append((k, keys))
            else:
                plain.append((k, t))
        words, codes, ends = coded_words([t for _, t in plain], [keys for _, keys in odd])
        at = self.memo.places(words, self._learn)[codes]
        if not self.prefix and len(ends):
            first = np.concatenate([[0], ends[:-1]])
            bare = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), words.take(pa.array(codes[first])), pa.scalar("", pa.large_string())).dictionary_encode()
            at[first] = self.memo.places(bare.dictionary, self._learn)[bare.indices.to_numpy()]
        out = [np.empty(0, np.int32)] * len(texts)
        for (k, _), ids in zip([*plain, *odd], self.memo.gather(at, ends), strict=True):
            out[k] = ids.astype(np.int32)
        return out

    def both(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids of UTF-8 texts, and what they decode to."""
        ids = self.encode([None if t is None else t.decode("utf-8", "replace") for t in texts])
        return ids, self.decode_all(ids, [(t or b"").replace(_MARK, b" ") for t in texts])

    # ------------------------------------------------------------ decoding

    def decode_all(self, ids: list[np.ndarray], texts: list[bytes]) -> list[bytes]:
        """Decoded UTF-8 texts; ``texts`` are those that were encoded, which spares checking what comes back equal."""
        flat = np.concatenate([np.empty(0, np.int32), *ids])
        got = self.byte_column.take(pa.array(flat))
        offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset :] if len(got) else np.zeros(1, np.int64)
        data, at, out = got.buffers()[2], 0, []
        data = memoryview(data) if data is not None else memoryview(b"")
        for one, t in zip(ids, texts, strict=True):
            lo, hi = int(offsets[at]), int(offsets[at + len(one)])
            at += len(one)
            raw = bytes(data[lo + (self.prefix and data[lo : lo + 1] == b" ") : hi])
            out.append(raw if raw == t else self.decode(one.tolist()).encode())
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def runs(texts: list[bytes | None], most: int = 3 << 20):
    """Runs of texts of about ``most`` bytes."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or b"")
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``row`` (struct of the kept columns), ids (array of int) and decoded text of every row.

    Null and empty texts have no ids; the decoded text of a null one is null, else it is the text in which U+2581 is a
    space.  Repeated rows are encoded alike.  Long words cost time in proportion to their length.
    """
    prepare(docs.sparkSession)

    def build():
        m = model(path)
        claim("pieces", model.cache_clear)

        def work(texts):
            ids, decoded = [], []
            for part in runs(texts):
                got, back = m.both(part)
                ids += got
                decoded += [None if t is None else d for t, d in zip(part, back, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in ids])]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32())
            return [pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(decoded, pa.binary()).cast(pa.string())]

        return work

    return annotate(docs, "text", keep, "ids array<int>, decoded string", build)


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces and ids: the documents as training input; null and empty texts have no ids, repeated rows stay."""
    found = encode(docs, path, ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_pieces"), "ids")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: number of ids, their crc32 as little-endian 32-bit integers, crc32 of the decoded text, round trip."""
    prepare(docs.sparkSession)

    def build():
        m = model(path)
        claim("pieces", model.cache_clear)

        def work(texts):
            out = []
            for part in runs(texts):
                for t, g, back in zip(part, *m.both(part), strict=True):
                    out.append((len(g), zlib.crc32(g.astype("<i4").tobytes()), zlib.crc32(back), back == (t or b"").replace(_MARK, b" ")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)]

        return work

    return annotate(docs, "text", ["doc_id"], "n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean", build)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document, and whether the text comes back.

    Null and empty texts have no ids and come back empty; repeated rows have equal results; of pieces with equal scores the longest
    last one wins; whole texts count, however long; an empty table gives an empty result.
    """
    import public_tokenizers

    found = digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_pieces", "ids_crc32", "decoded_crc32", "round_trip")
