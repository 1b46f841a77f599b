"""Exact n-gram Jaccard join with PartEnum signatures, and the groups that its links form.

A document is the set of its word shingles.  Sets of sizes a and b with Jaccard similarity p % or more differ in at
most k = (a+b)(100-p)/(100+p) shingles.  Pairs are therefore dealt into windows by the sum of their sizes; a window bounds k
and the sizes that take part, and a set takes part in the few windows that its size allows.  In a window the
shingles are dealt by hash into n1 partitions of n2 parts, and for each partition every choice of n2-k2 parts gives a signature.
At most k/(k2+1) partitions can hold more than k2 differences, so in any other one some
choice avoids them all: similar sets share a signature, whatever they are.

Signatures of nothing would bring all sets together.  n1 therefore has some partitions more than needed, and a set leaves
its empty signatures out if no more of its partitions have one than that; else it keeps them.  The number of
signatures is in proportion to the set's size (``most_signatures``).

Sets with equal shingles are one set from the start.  Of the sets under a signature each is compared with one of them, the hub,
exactly; then, only where the sets under a signature still fall into several groups, with the members of the other
groups that two bounds do not rule out: the triangle inequality, and the parities of the sets in PARITIES buckets (every
differing shingle turns one parity, so sets differ at least as often as their parities do).  So no link that
could join two groups is left out, and pairs within a group are not expanded.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, discard, prepare, quoted, slices, store, table

PARITIES = 1024
#: Members of a hub that meet all others in one task.
HUB_BLOCK = 4096
_P = [f"p{k}" for k in range(PARITIES // 64)]
_M = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that a worker signs at a time, entries that the other side of the shuffle sorts at a time.
SLICE, FOLD = 1 << 19, 1 << 20
#: Bytes of text that are cut into shingles at a time.
TEXT = 4 << 20
#: Fingerprints that a task remembers, so that it signs equal sets once.
SEEN = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of ``width`` words; fewer words make one shingle, none an empty set."""
    import xxhash

    rows = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, ends = rows.flatten(), rows.offsets.to_numpy() - rows.offsets[0].as_py()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        words, ends = words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends]
    coded = words.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    w = known[coded.indices.to_numpy()]
    whole = np.full(max(0, len(w) - width + 1), width, np.uint64)
    for k in range(width):
        whole = _mix(whole * _M + w[k : len(w) - width + 1 + k]) if len(whole) else whole
    out = []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(whole[lo : hi - width + 1]))
            continue
        h = np.full(min(hi - lo, 1), hi - lo, np.uint64)
        for k in range(lo, hi):
            h = _mix(h * _M + w[k : k + 1])
        out.append(h)
    return out


def fingerprint(shingles: np.ndarray) -> int | None:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


# ---------------------------------------------------------------- signatures

#: Least mean number of shingles in a signature, and the share of sets that may have to keep empty ones.
COVER, TAIL = 3.5, 0.002


def most_signatures(n: int) -> int:
    """What a set of n shingles may have at most, in all windows."""
    return 150 + 3 * n


@lru_cache(maxsize=None)
def scheme(least: int, k: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for sets of at least ``least`` shingles that differ in k: the fewest signatures of enough shingles.

    Where no choice keeps the signatures full enough (very small sets), the one with the fewest empty ones of those affordable.
    """
    if k == 0:
        return 1, 1, 0, 0
    best, second = None, None
    for k2 in range(min(k, 6) + 1):
        for n2 in range(k2 + 1, k2 + 6 if k2 else 2):
            choices = math.comb(n2, k2)
            for spare in range(0, max(4, k // 4) + 1):
                n1 = k // (k2 + 1) + 1 + spare
                cost = n1 * choices
                if cost > 48 + least or best and cost >= best[0]:
                    break
                cover = least / n1 * (n2 - k2) / n2
                thin = n1 * choices * math.exp(-cover)
                term = total = math.exp(-thin)
                for j in range(1, spare + 1):
                    term *= thin / j
                    total += term
                tail = 1 - total
                if cover >= COVER and tail < TAIL:
                    best = cost, (n1, n2, k2, spare)
                    break
                if cover < COVER and spare:
                    break
                second = min(second or (math.inf,), (round(tail, 6), cost, (n1, n2, k2, spare)))
    return best[1] if best else second[2]


class Windows:
    """The windows of one percentage: sums of sizes grow by the factor 1/p to the power of 1/steps."""

    def __init__(self, percent: int, steps: int):
        self.percent, self.ratio = percent, (100 / percent) ** (1 / steps)
        self.windows: list[tuple[int, int, int]] = []
        self.least, self.most = [], []
        self.sum = 0

    def _grow(self, n: int) -> None:
        p = self.percent
        while not self.least or self.least[-1] <= n:
            low = self.sum + 1
            k = (100 - p) * low // (100 + p)
            high = max(int(self.sum * self.ratio), ((k + 1) * (100 + p) - 1) // (100 - p))
            k = (100 - p) * high // (100 + p)
            self.sum = high
            self.windows.append((max(1, -(-p * low // (100 + p))), 100 * high // (100 + p), k))
            self.least.append(self.windows[-1][0])
            self.most.append(self.windows[-1][1])

    def of(self, n: int) -> list[int]:
        """Numbers of the windows in which sets of size n take part."""
        self._grow(n)
        first = bisect_left(self.most, n)
        out = []
        for t in range(first, len(self.windows)):
            least = self.windows[t][0]
            if least > n:
                break
            out.append(t)
        return out

    def scheme(self, t: int) -> tuple[int, int, int, int]:
        least, _, k = self.windows[t]
        return scheme(least, k)

    def cost(self, n: int) -> int:
        return sum(n1 * math.comb(n2, k2) for n1, n2, k2, _ in map(self.scheme, self.of(n)))


@lru_cache(maxsize=None)
def windows(percent: int) -> Windows:
    """The steps that give the fewest signatures to sets of about a thousand shingles."""
    tried = [Windows(percent, steps) for steps in (1, 2, 3, 4)]
    return min(tried, key=lambda w: sum(w.cost(n) for n in (700, 800, 900, 1000, 1100)))


@lru_cache(maxsize=64)
def _choices(n2: int, k2: int) -> np.ndarray:
    return np.array(list(combinations(range(n2), n2 - k2)), np.int64)


def signatures_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all sets, and the number of the set that each is of."""
    seen = windows(percent)
    by_window: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        if len(s):
            for t in seen.of(len(s)):
                by_window.setdefault(t, []).append(k)
            if seen.cost(len(s)) > most_signatures(len(s)):
                raise ValueError(f"{len(s)} shingles get more than {most_signatures(len(s))} signatures at {percent} %")
    spreads = [_mix(s + _M) for s in sets]
    weights = [_mix(s ^ np.uint64(0x5851F42D4C957F2D)) for s in sets]
    sigs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for t, wanted in by_window.items():
        n1, n2, k2, spare = seen.scheme(t)
        cells, chosen = n1 * n2, _choices(n2, k2)
        step = max(1, (1 << 20) // (n1 * len(chosen)))
        for at in range(0, len(wanted), step):
            part = wanted[at : at + step]
            size = [len(sets[k]) for k in part]
            cell = (np.concatenate([spreads[k] for k in part]) % np.uint64(cells)).astype(np.int64)
            cell += np.repeat(np.arange(len(part)) * cells, size)
            weight = np.concatenate([weights[k] for k in part])
            whole = len(part) * cells
            count = np.bincount(cell, minlength=whole).reshape(len(part), n1, n2)
            lo = np.bincount(cell, (weight & np.uint64(0xFFFFFFFF)).astype(np.float64), whole).astype(np.uint64)
            hi = np.bincount(cell, (weight >> np.uint64(32)).astype(np.float64), whole).astype(np.uint64)
            own = _mix(lo + _mix(hi + _M)).reshape(len(part), n1, n2)
            sums = np.zeros((len(part), n1, len(chosen)), np.uint64)
            held = np.zeros(sums.shape, np.int64)
            for j in range(n2 - k2):
                sums = _mix(sums * _M + own[:, :, chosen[:, j]])
                held += count[:, :, chosen[:, j]]
            place = np.arange(n1 * len(chosen), dtype=np.uint64).reshape(1, n1, -1) + np.uint64(t) * np.uint64(1 << 40)
            found = _mix(sums + _mix(place + _M))
            thin = (held == 0).any(axis=2).sum(axis=1)
            stay = (held > 0) | (thin > spare)[:, None, None]
            sigs.append(found[stay])
            owners.append(np.repeat(np.array(part), stay.reshape(len(part), -1).sum(axis=1)))
    return np.concatenate(sigs), np.concatenate(owners)


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of one set."""
    return signatures_of([shingles], percent)[0]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each bucket holds an odd number of shingles, as 64-bit numbers."""
    odd = np.bincount((_mix(shingles ^ _M) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


# ---------------------------------------------------------------- frames


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def members(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fp) of every row; fp is null where the set is empty."""

    def run(batches):
        claim("shingles")
        for b in batches:
            sizes, fps = [], []
            for part in slices(b.column(1), TEXT):
                sets = shingle_sets(part, width)
                sizes += map(len, sets)
                fps += map(fingerprint, sets)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64())],
                names=["doc_id", "text_hash", "n_shingles", "fp"],
            )

    return docs.mapInArrow(run, "doc_id bigint, text_hash binary, n_shingles bigint, fp bigint")


_BLOCK = "bucket int, base bigint, sigs binary, owners binary"
_WIDE = 6


def _pieces(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows of binary from a byte array of equal items that is cut at ``starts``."""
    offsets = np.concatenate([starts, [len(data)]]) * (data.strides[0] if data.ndim else 1)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def signed_blocks(docs: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """Signatures in blocks: one row per slice of documents and bucket (the top ``bits`` bits of the signatures).

    Sets get numbers; an entry is the next 48 bits of a signature and, in 16 bits, its set's number behind ``base``.  Rows of bucket
    -1 and below hold the fingerprints of the sets from ``base`` on.  A task signs equal sets once, as long as it remembers them.
    """

    def run(batches):
        from pyspark import TaskContext

        claim("shingles")
        base, seen = TaskContext.get().partitionId() << 40, set()

        def block(fps, sets):
            nonlocal base
            sigs, owners = signatures_of(sets, percent)
            bucket = (sigs >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
            inner = np.ascontiguousarray((sigs[order] << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDE]
            n = len(starts)
            own = pa.array([np.array(fps, np.int64).tobytes()], pa.binary())
            columns = [
                pa.array(np.concatenate([[-1 - (base >> 8) % (1 << 20)], bucket[starts].astype(np.int64)]), pa.int32()),
                pa.array(np.full(n + 1, base, np.int64)),
                pa.concat_arrays([pa.array([None], pa.binary()), _pieces(np.ascontiguousarray(inner), starts)]),
                pa.concat_arrays([own, _pieces(owners[order].astype("<u2"), starts)]),
            ]
            base += len(fps)
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "base", "sigs", "owners"])

        for b in batches:
            fps, sets, held = [], [], 0
            for part in slices(b.column(1), TEXT):
                for s in shingle_sets(part, width):
                    fp = fingerprint(s)
                    if fp is None or fp in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(fp)
                    fps.append(fp)
                    sets.append(s)
                    held += len(s)
                    if held > SLICE or len(fps) == 1 << 15:
                        yield block(fps, sets)
                        fps, sets, held = [], [], 0
            if fps:
                yield block(fps, sets)

    return docs.mapInArrow(run, _BLOCK)


def _entries(sigs: bytes, owners: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(sigs) // _WIDE, 8), np.uint8)
    wide[:, :_WIDE] = np.frombuffer(sigs, np.uint8).reshape(-1, _WIDE)
    return wide.view("<u8").reshape(-1), np.frombuffer(owners, "<u2").astype(np.int64) + base


class _Bucket:
    """The hubs of one bucket.  Memory is that of its distinct signatures, whatever the number of sets under one of them.

    Entries come in order of the sets' numbers, so the hub is the set of the least number under a signature; similar sets then
    have the same few hubs under all signatures that they share.
    """

    def __init__(self):
        self.sigs, self.hubs, self.held, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, sigs: bytes, owners: bytes, base: int):
        self.held.append((sigs, owners, base))
        self.size += len(owners) // 2
        return self.fold() if self.size > FOLD else None

    def fold(self):
        """Distinct (hub, set) pairs of what was added."""
        if not self.held:
            return None
        got = [_entries(*h) for h in self.held]
        self.held, self.size = [], 0
        sig, num = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        order = np.argsort(sig, kind="stable")
        sig, num = sig[order], num[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        heads, run = np.flatnonzero(first), np.cumsum(first) - 1
        hub = num[heads]
        if len(self.sigs):
            at = np.minimum(np.searchsorted(self.sigs, sig[heads]), len(self.sigs) - 1)
            known = self.sigs[at] == sig[heads]
            hub = np.where(known, self.hubs[at], hub)
            new = ~known
            sigs, hubs = np.concatenate([self.sigs, sig[heads][new]]), np.concatenate([self.hubs, hub[new]])
            order = np.argsort(sigs, kind="stable")
            self.sigs, self.hubs = sigs[order], hubs[order]
        else:
            self.sigs, self.hubs = sig[heads], hub
        hub = hub[run]
        other = hub != num
        pairs = np.stack([hub[other], num[other]])
        if not pairs.size:
            return None
        order = np.lexsort(pairs)
        pairs = pairs[:, order]
        return pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])]


def met_sets(blocks: DataFrame) -> DataFrame:
    """(is_pair, a, b): number and fingerprint of a set, or numbers of a hub and of a set that share a signature."""

    def run(batches):
        claim("shingles")
        last, bucket = None, None

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array(np.ones(pairs.shape[1], bool)), pa.array(pairs[0]), pa.array(pairs[1])], names=["is_pair", "a", "b"])

        for b in batches:
            for k in range(b.num_rows):
                number, base, owners = b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(3)[k].as_py()
                if number < 0:
                    fps = np.frombuffer(owners, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fps), bool)), pa.array(base + np.arange(len(fps))), pa.array(fps)], names=["is_pair", "a", "b"])
                    continue
                if number != last:
                    if bucket is not None and (pairs := bucket.fold()) is not None:
                        yield out(pairs)
                    last, bucket = number, _Bucket()
                if (pairs := bucket.add(b.column(2)[k].as_py(), owners, base)) is not None:
                    yield out(pairs)
        if bucket is not None and (pairs := bucket.fold()) is not None:
            yield out(pairs)

    return blocks.mapInArrow(run, "is_pair boolean, a bigint, b bigint")


def hub_pairs(docs: DataFrame, width: int, percent: int, n_signatures: int) -> tuple[DataFrame, list[str]]:
    """(a, b): fingerprints of a hub and of another set under one signature, each pair once; and the tables behind it."""
    spark = docs.sparkSession
    bits = min(24, max(8, (n_signatures >> 20).bit_length()))
    dealt = signed_blocks(docs, width, percent, bits)
    needed, default = n_signatures // (1 << 25), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(needed, "bucket") if needed > default else dealt.repartition("bucket")
    met, path = store(met_sets(dealt.sortWithinPartitions("bucket", "base")), "near-signatures")
    named = met.where("not is_pair").select(F.col("a").alias("number"), F.col("b").alias("fp"))
    pairs = met.where("is_pair").select("a", "b").distinct()
    for side in "ab":
        pairs = pairs.join(named.select(F.col("number").alias(side), F.col("fp").alias(f"fp_{side}")), side)
    pairs = pairs.where("fp_a <> fp_b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()
    stars, stars_path = store(pairs, "near-stars")
    return stars, [path, stars_path]


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def similar(inter: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * inter >= percent * (n_a + n_b - inter)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, inter) of pairs of fingerprints."""
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("s_b"))
    both = pairs.join(right, "b").join(left, "a")
    n_a, n_b = F.size("s_a").cast("bigint"), F.size("s_b").cast("bigint")
    return both.select("a", "b", n_a.alias("n_a"), n_b.alias("n_b"), F.size(F.array_intersect("s_a", "s_b")).cast("bigint").alias("inter"))


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(fp, comp) of linked numbers: comp is the least number of the component.

    Large-star and small-star rounds; every round is stored, minima are taken before the shuffle, and the joins are plain
    equi-joins whose large keys Spark can split.
    """
    spark = links.sparkSession
    edges, path = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        new_edges, new_path = store(small, "links")
        discard(spark, path)
        edges, path = new_edges, new_path
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    labels = edges.select(F.col("u").alias("fp"), F.col("v").alias("comp"))
    return labels.unionByName(edges.select(F.col("v").alias("fp"), F.col("v").alias("comp")).distinct()), path


def groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fp, comp) per row: comp names the group of linked sets, null for an empty one.

    Null and empty texts have no shingles and no links; repeated rows share their set; rows of equal doc_id and different text are
    documents of their own.  Links are decided on exact counts of shingle hashes of 64 bits.
    """
    spark = prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    member, _ = store(members(slim.withColumn("text_hash", _hash(F.col("text"))), width), "near-members")
    total = windows(percent).cost(1000) * (member.agg(F.sum("n_shingles")).first()[0] or 0) // 1000
    stars, old = hub_pairs(slim.select("doc_id", "text"), width, percent, total)

    wanted = stars.select(F.col("a").alias("fp")).unionByName(stars.select(F.col("b").alias("fp"))).distinct()
    holders = member.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(wanted, "fp", "left_semi")
    holders, holders_path = store(holders.withColumnRenamed("doc_id", "holder"), "near-holders")

    def expand(batches):
        claim("shingles")
        for b in batches:
            wanted, at = b.column(0).to_pylist(), 0
            for part in slices(b.column(1), TEXT):
                sets = shingle_sets(part, width)
                fps = np.array([fingerprint(s) or 0 for s in sets], np.int64)
                keep = [k for k in range(len(sets)) if len(sets[k]) and fps[k] == wanted[at + k]]
                at += len(sets)
                odd = np.array([parities(sets[k]) for k in keep], np.int64).reshape(len(keep), len(_P))
                shingles = pa.array([_signed(sets[k]) for k in keep], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(fps[keep]), shingles, *(pa.array(odd[:, j]) for j in range(len(_P)))], names=["fp", "shingles", *_P])

    texts = slim.join(holders.hint("shuffle_hash"), slim["doc_id"].eqNullSafe(holders["holder"])).select("fp", "text")
    schema = "fp bigint, shingles array<bigint>, " + ", ".join(f"{c} bigint" for c in _P)
    sets = texts.mapInArrow(expand, schema).groupBy("fp").agg(*[F.first(c).alias(c) for c in ("shingles", *_P)])
    sets, sets_path = store(sets, "near-sets")
    checked, checked_path = store(compared(stars, sets), "near-checked")
    links = checked.where(similar(F.col("inter"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    label, label_path = components(links)

    rest, rest_path = store(_open_pairs(checked, label, sets, percent), "near-rest")
    more = compared(rest, sets)
    more, more_path = store(more.where(similar(F.col("inter"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"), "near-more")
    if not more.isEmpty():
        label, _ = components(links.unionByName(more))
    for path in (*old, holders_path, sets_path, rest_path, more_path, checked_path):
        discard(spark, path)
    return member.join(label, "fp", "left").select("doc_id", "text_hash", "n_shingles", "fp", F.coalesce("comp", "fp").alias("comp"))


def _open_pairs(checked: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that were compared with one hub, in different groups, that neither bound rules out.

    Sets under one signature have its hub in common, so these are all pairs under one signature, and few pairs meet at
    more than a few hubs, while similar sets meet under many signatures.

    Jaccard distance is a metric: sets whose distances from one third set, the hub, differ by more than the limit are
    farther apart than the limit.  Both bounds are conditions of the join, so pairs that they rule out are not made.
    """
    union = F.col("n_a") + F.col("n_b") - F.col("inter")
    far = checked.select(F.col("a").alias("hub"), F.col("b").alias("fp"), F.col("n_b").alias("n"), (1 - F.col("inter") / union).alias("far"))
    placed = far.join(label, "fp", "left").select("hub", "fp", F.coalesce("comp", "fp").alias("comp"), "n", "far")
    several = placed.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / HUB_BLOCK).cast("int").alias("blocks"))
    left = placed.join(several.where("low < high").select("hub", "blocks"), "hub").join(sets.select("fp", *_P), "fp")
    # a hub's members meet in blocks, so that no task has more than HUB_BLOCK of them on one side
    own, every = F.pmod("fp", "blocks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["fp", "comp", "n", "far", *_P]
    a, b = (left.select("hub", block.alias("block"), *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side, block in (("a", own.cast("int")), ("b", every)))
    limit = (100 - percent) / 100 + 1e-9
    apart = sum([F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _P], F.lit(0))
    return (
        a.join(b, ["hub", "block"])
        .where("fp_a < fp_b and comp_a <> comp_b")
        .where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
        .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.abs(F.col("far_a") - F.col("far_b")) <= limit))
        .select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
        .distinct()
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked ones: that of the least doc_id (a null one last), of equal ones that of the
    least text hash, and of rows that repeat both any one.  Documents without words and those without links stay.
    """
    found, _ = store(groups(docs, width, percent), "near-groups")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "text_hash")
    tied = found.where("comp is not null").groupBy("comp").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    tied, _ = store(tied, "near-tied")
    judged = found.join(tied, "comp").select("doc_id", "text_hash", (order == F.col("first")).alias("stays"))
    keys, _ = store(judged.groupBy("doc_id", "text_hash", "stays").agg(F.count("*").alias("n")), "near-keys")
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    keyed = docs.select(whole.alias("row"), F.col("doc_id").cast("bigint").alias("k_id"), _hash(F.col("text").cast("string")).alias("k_hash"))

    def against(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.hint("shuffle_hash")
        return rows.join(some, [rows["k_id"].eqNullSafe(some["doc_id"]), rows["k_hash"] == some["text_hash"]], how)

    kept = against(keyed, keys.where(~F.col("stays")), "left_anti")
    again = keys.where(F.col("stays") & (F.col("n") > 1))
    if not again.isEmpty():
        kept = against(kept, again, "left_anti").unionByName(against(kept, again, "left_semi").dropDuplicates(["k_id", "k_hash"]))
    return kept.select(*[F.col("row." + quoted(c)).alias(c) for c in docs.columns])


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents under 85 % of four-word shingles: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and are their own component; repeated rows stay, each with its component; an empty
    table gives an empty result.  Minima of components are stored before they are joined, so that Spark can split large ones.
    """
    found, _ = store(groups(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85), "near-groups")
    least, _ = store(found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "near-least")
    joined = found.join(least, "comp", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
