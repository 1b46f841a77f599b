"""Lossless WebP as a media column: a complete decoder to pixel arrays, and an encoder for samples.

The decoder reads every lossless feature: prefix codes (also in groups), back-references with the two-dimensional distance
map, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms with pixel bundling.
``decode`` works on one file; ``decode_many`` decodes files of one varying channel without cache and groups
in step, one lane per file, back-references and transforms included, and hands the others to ``decode``.

The encoder of the media column chooses per file: payloads of at most 16 different bytes get the palette transform with
bundled pixels; a line of LEAST_LINE bytes or more that stood before in the payload, and a run of LEAST_RUN bytes or more at its
end, become back-references; all else is literals under optimal length-limited prefix codes.  The other transforms and the colour
cache make text larger, so only ``encode`` writes them, on request.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, claim, prepare, store, table
from .token_store import limited_lengths

UNIT = 576
SIDE = 1 << 14
#: Bytes in one image; longer payloads go on in further images.
IMAGE_BYTES = SIDE // UNIT * UNIT * SIDE
LANE_BITS = 11
LEAST_LINE, LEAST_RUN, LONGEST_COPY = 64, 16, 4096
#: Lanes fewer than this go one by one.
FEW = 8
#: Fixed values of the format: the order in which lengths of code-length codes are stored ...
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: ... and the offsets (x to the left, y up) of the 120 short distance codes.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
HASH = 0x1E35A7BD
OPAQUE = 0xFF000000


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        p = self.at
        if n and p + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        self.at = p + n
        return (int.from_bytes(self.data[p >> 3 : (p >> 3) + 8], "little") >> (p & 7)) & ((1 << n) - 1)


@lru_cache(maxsize=16)
def _reversal(n: int) -> np.ndarray:
    """The numbers of n bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class Code:
    """Table from a window of ``bits`` bits to symbol * 16 + length; a lone symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.lone = 0, int(used[0]) if len(used) else 0
            self.table = np.array([self.lone * 16], np.int64)
        else:
            order = used[np.lexsort((used, lengths[used]))]
            size = lengths[order].astype(np.int64)
            self.bits, self.lone = int(size.max()), None
            spread = np.repeat(order * 16 + size, 1 << (self.bits - size))
            if len(spread) != 1 << self.bits:
                raise ValueError("an incomplete prefix code")
            self.table = spread[_reversal(self.bits)]
        self.highest = int(used[-1]) if len(used) else 0

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return self.lone
        p = bits.at
        got = int(self.table[(int.from_bytes(bits.data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7)) & ((1 << self.bits) - 1)])
        bits.at = p + (got & 15)
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
        return got >> 4


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    small = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        small[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(small)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        n, value = (3 + bits.read(2), before) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if at + n > size:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = value
        at += n
    return Code(lengths)


def _prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _header(bits: Bits, width: int, height: int, main: bool):
    """Cache bits, block bits and group numbers of the meta image, and the groups of five codes."""
    cache = bits.read(4) if bits.read(1) else 0
    block, meta, groups = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        meta = (_pixels(bits, -(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
    return cache, block, meta, [[_read_code(bits, n) for n in sizes] for _ in range(groups)]


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    return _body(bits, width, height, *_header(bits, width, height, main))


def _body(bits: Bits, width: int, height: int, cache: int, block: int, meta, groups) -> np.ndarray:
    total, out, saved = width * height, [], [0] * (1 << cache if cache else 0)
    across = -(-width >> block) if meta is not None else 0
    meta = meta.tolist() if meta is not None else None
    held = 0  # pixels already in the cache
    while len(out) < total:
        k = len(out)
        green, red, blue, alpha, far = groups[meta[(k // width >> block) * across + (k % width >> block)] if meta else 0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _prefixed(bits, s - 256)
            d = _prefixed(bits, far.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > k or k + n > total:
                raise ValueError("a back-reference beyond the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            while held < k:
                saved[(HASH * out[held] & 0xFFFFFFFF) >> (32 - cache)] = out[held]
                held += 1
            out.append(saved[s - 280])
        if cache:
            while held < len(out):
                saved[(HASH * out[held] & 0xFFFFFFFF) >> (32 - cache)] = out[held]
                held += 1
    return np.array(out, np.uint32)


# ---------------------------------------------------------------- transforms


def _channels(p: np.ndarray) -> np.ndarray:
    return np.stack([(p >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, up, up_left, up_right) -> tuple:
    """The predicted channels; arguments are tuples of four."""
    half = lambda a, b: tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 1:
        return left
    if mode == 2:
        return up
    if mode == 3:
        return up_right
    if mode == 4:
        return up_left
    if mode == 5:
        return half(half(left, up_right), up)
    if mode == 6:
        return half(left, up_left)
    if mode == 7:
        return half(left, up)
    if mode == 8:
        return half(up_left, up)
    if mode == 9:
        return half(up, up_right)
    if mode == 10:
        return half(half(left, up_left), half(up, up_right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(up, up_left, strict=True))  # distance of left + up - up_left from left
        by_up = sum(abs(a - c) for a, c in zip(left, up_left, strict=True))
        return left if by_left < by_up else up
    if mode == 12:
        return tuple(clamp(a + b - c) for a, b, c in zip(left, up, up_left, strict=True))
    if mode == 13:
        return tuple(clamp(m + int((m - c) / 2)) for m, c in zip(half(left, up), up_left, strict=True))
    return (255, 0, 0, 0)


def _predictor(p: np.ndarray, width: int, height: int, modes: list[int], block: int, add: bool) -> np.ndarray:
    """Add the predictions to residuals, or take them from pixels."""
    across, given = -(-width >> block), list(map(tuple, _channels(p).tolist()))
    full: list[tuple] = [] if add else given
    out: list[tuple] = []
    for k, own in enumerate(given):
        y, x = divmod(k, width)
        if k == 0:
            guess = (255, 0, 0, 0)
        elif y == 0:
            guess = full[k - 1]
        elif x == 0:
            guess = full[k - width]
        else:
            mode = modes[(y >> block) * across + (x >> block)]
            guess = _predict(mode, full[k - 1], full[k - width], full[k - width - 1], full[k - width + 1])
        if add:
            full.append(tuple((a + g) & 255 for a, g in zip(own, guess, strict=True)))
        else:
            out.append(tuple((a - g) & 255 for a, g in zip(own, guess, strict=True)))
    return _joined(np.array(full if add else out, np.int64).reshape(-1, 4))


def _cross(p: np.ndarray, width: int, height: int, elements: np.ndarray, block: int, add: bool) -> np.ndarray:
    y, x = np.divmod(np.arange(len(p)), width)
    e = elements[(y >> block) * -(-width >> block) + (x >> block)]
    signed = lambda v: (v.astype(np.int64) & 255 ^ 128) - 128
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    c, sign = _channels(p), 1 if add else -1
    red = c[:, 1] + sign * delta(e & 255, c[:, 2])
    after = red if add else c[:, 1]
    blue = c[:, 3] + sign * (delta(e >> 8, c[:, 2]) + delta(e >> 16, after))
    c[:, 1], c[:, 3] = red, blue
    return _joined(c)


def _green(p: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(p)
    c[:, 1] += sign * c[:, 2]
    c[:, 3] += sign * c[:, 2]
    return _joined(c)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _frame(data: bytes) -> tuple[Bits, int, int, int]:
    """Bits behind the size, width, height and the length of the whole file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    whole, size = 8 + struct.unpack("<I", data[4:8])[0], struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[: 20 + size], 8 * 21)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    return bits, width, height, whole


def _transforms(bits: Bits, width: int, height: int) -> tuple[list, int]:
    found, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            found.append((kind, width, block, _pixels(bits, -(-width >> block), -(-height >> block), False)))
        elif kind == 2:
            found.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            colours = _joined(np.cumsum(_channels(_pixels(bits, n, 1, False)), axis=0))
            found.append((kind, width, _bundle(n), colours))
            width = -(-width >> _bundle(n))
    return found, width


def _undo(p: np.ndarray, height: int, transforms: list) -> np.ndarray:
    for kind, width, block, data in reversed(transforms):
        if kind == 0:
            p = _predictor(p, width, height, ((data >> 8) & 15).tolist(), block, True)
        elif kind == 1:
            p = _cross(p, width, height, data, block, True)
        elif kind == 2:
            p = _green(p, 1)
        else:
            index = ((p >> 8) & 255).reshape(height, -1)
            each = 8 >> block
            parts = [(index >> (each * k)) & ((1 << each) - 1) for k in range(1 << block)]
            index = np.stack(parts, -1).reshape(height, -1)[:, :width].reshape(-1)
            p = np.concatenate([data, np.zeros(256, np.uint32)])[index]
    return p


def decode(data: bytes) -> np.ndarray:
    """A file's pixels as alpha, red, green, blue bytes of 32-bit numbers, in rows."""
    bits, width, height, _ = _frame(data)
    transforms, own = _transforms(bits, width, height)
    return _undo(_pixels(bits, own, height, True), height, transforms).reshape(height, width)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of all files; those of one varying channel without cache and groups go in step, a lane each."""
    out: list = [None] * len(files)
    lanes = []
    for k, data in enumerate(files):
        bits, width, height, _ = _frame(data)
        transforms, own = _transforms(bits, width, height)
        cache, block, meta, groups = head = _header(bits, own, height, True)
        green, *others, far = groups[0]
        if not cache and meta is None and all(not c.bits for c in others) and green.bits <= LANE_BITS:
            rest = (others[2].lone << 24) | (others[0].lone << 16) | others[1].lone
            lanes.append((own * height, own, bits, green, far, k, rest, height, width, transforms))
        else:
            out[k] = _undo(_body(bits, own, height, *head), height, transforms).reshape(height, width)
    lanes.sort(key=lambda lane: -lane[0])
    for lo in range(0, len(lanes), 2048):
        for lane, values in zip(lanes[lo : lo + 2048], _in_step(lanes[lo : lo + 2048]), strict=True):
            *_, k, rest, height, width, transforms = lane
            p = values.astype(np.uint32) << 8 | np.uint32(rest)
            out[k] = _undo(p, height, transforms).reshape(height, width)
    return out


def _copied(out: np.ndarray, start: int, pos: int, stop: int, width: int, bits: Bits, symbol: int, far: Code) -> int:
    """Follow a back-reference at ``pos`` of an image that stands in out[start:stop]; returns the position behind it."""
    n, d = _prefixed(bits, symbol - 256), _prefixed(bits, far.read(bits))
    if d > 120:
        d -= 120
    else:
        x, y = NEAR[d - 1]
        d = max(1, x + y * width)
    if d > pos - start or pos + n > stop:
        raise ValueError("a back-reference beyond the image")
    out[pos : pos + n] = out[pos - d : pos - d + n] if d >= n else np.resize(out[pos - d : pos], n)
    return pos + n


def _in_step(lanes: list) -> list[np.ndarray]:
    """Green values of lanes (size, width, bits, green code, distance code, ...) that are sorted by falling size."""
    size = np.array([lane[0] for lane in lanes], np.int64)
    data = b"".join(lane[2].data + bytes(4) for lane in lanes)
    base = np.cumsum([0, *(len(lane[2].data) + 4 for lane in lanes)])[:-1] * 8
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    window = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    tables = np.concatenate([np.tile(lane[3].table, 1 << (LANE_BITS - lane[3].bits)) for lane in lanes]).astype(np.int32)
    out = np.zeros(int(size.sum()), np.uint8)
    start = np.cumsum(size) - size
    stop, mask = start + size, (1 << LANE_BITS) - 1
    end_at = base.copy()

    def copy(lane: int, at: int, pos: int, symbol: int) -> tuple[int, int]:
        _, width, bits, _, far, *_ = lanes[lane]
        bits.at = at - int(base[lane])
        pos = _copied(out, int(start[lane]), pos, int(stop[lane]), width, bits, symbol, far)
        return bits.at + int(base[lane]), pos

    ids, at, pos = np.arange(len(lanes)), base + np.array([lane[2].at for lane in lanes]), start.copy()
    last, shift = stop.copy(), ids << LANE_BITS
    while len(ids) > FEW:
        got = tables[((window[at >> 3] >> (at & 7).astype(np.uint32)) & mask) + shift]
        symbol = got >> 4
        out[pos] = symbol
        at = at + (got & 15)
        pos += 1
        if symbol.max() > 255:
            for j in np.flatnonzero(symbol > 255).tolist():
                at[j], pos[j] = copy(int(ids[j]), int(at[j]), int(pos[j]) - 1, int(symbol[j]))
        going = pos < last
        if not going.all():
            end_at[ids[~going]] = at[~going]
            ids, at, pos, last, shift = ids[going], at[going], pos[going], last[going], shift[going]
    for lane, p, k in zip(ids.tolist(), at.tolist(), pos.tolist(), strict=True):
        code, past = lanes[lane][3], int(stop[lane])
        lookup, low = code.table.tolist(), (1 << code.bits) - 1
        while k < past:
            symbols = []
            for _ in range(past - k):
                got = lookup[(int(window[p >> 3]) >> (p & 7)) & low]
                p += got & 15
                if got >= 256 << 4:
                    break
                symbols.append(got >> 4)
            out[k : k + len(symbols)] = symbols
            k += len(symbols)
            if k < past:
                p, k = copy(lane, p, k, got >> 4)
        end_at[lane] = p
    for k, lane in enumerate(lanes):
        if end_at[k] - base[k] > 8 * len(lane[2].data):
            raise ValueError("the stream ends early")
    return [out[a:z] for a, z in zip(start, stop, strict=True)]


# ---------------------------------------------------------------- encoding


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.n
        self.n += n


def _code_of(lengths: np.ndarray) -> np.ndarray:
    """Bit-reversed canonical codes."""
    used = np.flatnonzero(lengths)
    codes = np.zeros(len(lengths), np.int64)
    if len(used) > 1:
        order = used[np.lexsort((used, lengths[used]))]
        size = lengths[order]
        top = int(size.max())
        first = np.cumsum(np.concatenate([[0], 1 << (top - size)]))[:-1]
        codes[order] = _reversal(top)[first] & ((1 << size) - 1)
    return codes


#: A complete code of the code lengths 0 to 18: 13 symbols of 4 bits, 6 of 5 bits.
_SMALL = np.array([4] * 12 + [5] * 4 + [5] + [4] + [5])
_SMALL_CODE = _code_of(_SMALL)


def _write_code(w: Writer, lengths: np.ndarray) -> np.ndarray:
    """Write lengths; a lone symbol below 256 becomes a simple code that takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        w.put(1, 1)
        w.put(0, 1)
        w.put(1, 1)
        w.put(used[0] if len(used) else 0, 8)
        return np.zeros_like(lengths)
    w.put(0, 1)
    w.put(15, 4)
    for k in LENGTH_ORDER:
        w.put(_SMALL[k], 3)
    w.put(0, 1)
    at, put = 0, lambda s: w.put(_SMALL_CODE[s], int(_SMALL[s]))
    values = lengths.tolist()
    while at < len(values):
        n = 1
        while values[at] == 0 and at + n < len(values) and values[at + n] == 0 and n < 138:
            n += 1
        if values[at] or n < 3:
            put(values[at])
            at += 1
        elif n < 11:
            put(17)
            w.put(n - 3, 3)
            at += n
        else:
            put(18)
            w.put(n - 11, 7)
            at += n
    return lengths if len(used) > 1 else np.zeros_like(lengths)


def _lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    out[used] = limited_lengths(counts[used], limit)
    return out


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance from 1 on."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def _write_image(w: Writer, p: np.ndarray, width: int, main: bool, cache: int = 0, copies: bool = False, blocks: int = 0) -> None:
    """Scalar writer with every feature, for small images; ``blocks`` > 0 writes two groups in a meta image."""
    pixels, tokens, k, saved, seen = p.tolist(), [], 0, {}, {}
    slot = lambda v: (HASH * v & 0xFFFFFFFF) >> (32 - cache)
    while k < len(pixels):
        n, d = 0, 0
        if copies and (start := seen.get(tuple(pixels[k : k + 3]))) is not None:
            d = k - start
            while k + n < len(pixels) and pixels[k + n] == pixels[k + n - d] and n < 4096:
                n += 1
        if n >= 3:
            code = next((c + 1 for c, (x, y) in enumerate(NEAR) if x + y * width == d), d + 120)
            tokens.append((k, "copy", n, code))
        elif cache and saved.get(slot(pixels[k])) == pixels[k]:
            tokens.append((k, "cache", slot(pixels[k]), 0))
            n = 1
        else:
            tokens.append((k, "pixel", pixels[k], 0))
            n = 1
        for j in range(k, k + n):
            seen[tuple(pixels[j : j + 3])] = j
            if cache:
                saved[slot(pixels[j])] = pixels[j]
        k += n
    w.put(1, 1) if cache else w.put(0, 1)
    if cache:
        w.put(cache, 4)
    group = lambda k: 0
    if main:
        w.put(int(blocks > 0), 1)
        if blocks:
            w.put(blocks - 2, 3)
            across, down = -(-width >> blocks), -(-(len(pixels) // width) >> blocks)
            numbers = np.arange(across * down) % 2
            _write_image(w, (numbers << 8).astype(np.uint32), across, False)
            group = lambda k: int(numbers[(k // width >> blocks) * across + (k % width >> blocks)])
    groups = 1 + max((group(t[0]) for t in tokens), default=0)
    sizes = (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
    symbols = []
    for k, kind, a, b in tokens:
        if kind == "pixel":
            symbols.append((group(k), [(0, (a >> 8) & 255), (1, (a >> 16) & 255), (2, a & 255), (3, a >> 24)], []))
        elif kind == "cache":
            symbols.append((group(k), [(0, 280 + a)], []))
        else:
            s, extra, n = _prefix_of(a)
            t, more, m = _prefix_of(b)
            symbols.append((group(k), [(0, 256 + s), (4, t)], [(extra, n), (more, m)]))
        for channel, s in symbols[-1][1]:
            counts[symbols[-1][0]][channel][s] += 1
    codes = []
    for each in counts:
        own = [_write_code(w, _lengths(c, 15)) for c in each]
        codes.append([(_code_of(n), n) for n in own])
    for g, parts, extras in symbols:
        for j, (channel, s) in enumerate(parts):
            code, n = codes[g][channel]
            w.put(code[s], int(n[s]))
            if extras:
                w.put(*extras[j])


def _file(body: bytes, width: int, height: int) -> bytes:
    chunk = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14 | 1 << 28) + body
    padded = chunk + bytes(len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + padded


def encode(pixels: np.ndarray, transforms: tuple[str, ...] = (), cache: int = 0, copies: bool = False, blocks: int = 0, block: int = 2) -> bytes:
    """A small image with the named features: predictor, cross, green, palette in the order given."""
    height, width = pixels.shape
    p, own, w = pixels.reshape(-1).astype(np.uint32), width, Writer()
    for name in transforms:
        w.put(1, 1)
        w.put(["predictor", "cross", "green", "palette"].index(name), 2)
        cells = -(-own >> block) * -(-height >> block)
        if name == "predictor":
            w.put(block - 2, 3)
            modes = np.arange(cells) % 14
            _write_image(w, (modes << 8).astype(np.uint32), -(-own >> block), False)
            p = _predictor(p, own, height, modes.tolist(), block, False)
        elif name == "cross":
            w.put(block - 2, 3)
            e = (np.arange(cells, dtype=np.int64) * 0x9D3F7B + 0x40C0E0).astype(np.uint32) & np.uint32(0xFFFFFF)
            _write_image(w, e, -(-own >> block), False)
            p = _cross(p, own, height, e, block, False)
        elif name == "green":
            p = _green(p, -1)
        else:
            colours, index = np.unique(p, return_inverse=True)
            w.put(len(colours) - 1, 8)
            steps = _channels(colours)
            steps[1:] -= _channels(colours)[:-1]
            _write_image(w, _joined(steps), len(colours), False)
            bundle = _bundle(len(colours))
            wide = -(-own >> bundle)
            padded = np.zeros((height, wide << bundle), np.int64)
            padded[:, :own] = index.reshape(height, own)
            parts = padded.reshape(height, wide, 1 << bundle) << ((8 >> bundle) * np.arange(1 << bundle))
            p, own = (OPAQUE | parts.sum(-1).reshape(-1) << 8).astype(np.uint32), wide
    w.put(0, 1)
    _write_image(w, p, own, True, cache, copies, blocks)
    return _file(w.value.to_bytes((w.n + 7) // 8, "little"), width, height)


@lru_cache(maxsize=64)
def _distance_codes(width: int) -> dict[int, int]:
    """Short codes of the distances that have one in an image of this width."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def copies_of(raw: bytes, lines: bool) -> list[tuple[int, int, int]]:
    """(start, length, distance) of what becomes back-references: repeated long lines and an equal run at the end."""
    found, seen, at = [], {}, 0
    tail = len(raw) - len(raw.rstrip(raw[-1:]))
    end = len(raw) - tail + 1 if tail > LEAST_RUN else len(raw)
    if lines:
        for line in raw[:end].split(b"\n"):
            n = len(line)
            if n >= LEAST_LINE:
                before = seen.get(line)
                if before is not None:
                    found.append((at, n, at - before))
                seen[line] = at
            at += n + 1
    if end < len(raw):
        found.append((end, len(raw) - end, 1))
    return [(s + k, min(LONGEST_COPY, n - k), d) for s, n, d in found for k in range(0, n, LONGEST_COPY)]


def encode_samples(samples: np.ndarray, width: int, height: int) -> bytes:
    """One byte a pixel, in green; the other channels are constant and take no bits."""
    w, own, used = Writer(), width, np.flatnonzero(np.bincount(samples, minlength=256))
    lines = True
    if len(used) <= 16:
        bundle, lines = _bundle(len(used)), False
        own = -(-width >> bundle)
        w.put(1, 1)
        w.put(3, 2)
        w.put(len(used) - 1, 8)
        steps = np.diff(used, prepend=0).astype(np.uint32)
        _write_image(w, (steps << 8) | np.where(np.arange(len(used)) == 0, np.uint32(OPAQUE), np.uint32(0)), len(used), False)
        index = np.zeros((height, own << bundle), np.int64)
        index[:, :width] = np.searchsorted(used, samples).reshape(height, width)
        samples = (index.reshape(height, own, 1 << bundle) << ((8 >> bundle) * np.arange(1 << bundle))).sum(-1).astype(np.uint8).reshape(-1)
    w.put(0, 3)  # no more transforms, no colour cache, one group
    copies, near = copies_of(samples.tobytes(), lines), _distance_codes(own)
    literal = np.ones(len(samples), bool)
    for s, n, _ in copies:
        literal[s : s + n] = False
    place = np.flatnonzero(literal)
    pixels = samples[place]
    lengths, distances = [_prefix_of(n) for _, n, _ in copies], [_prefix_of(near.get(d, d + 120)) for *_, d in copies]
    counts, far = np.zeros(280, np.int64), np.zeros(40, np.int64)
    counts[:256] = np.bincount(pixels, minlength=256)
    np.add.at(counts, [256 + s for s, _, _ in lengths], 1)
    np.add.at(far, [s for s, _, _ in distances], 1)
    size = _write_code(w, _lengths(counts, LANE_BITS))
    for lone in (0, 0, 255):
        w.put(0b101 | lone << 3, 11)
    far_size = _write_code(w, _lengths(far, 15))
    code, far_code = _code_of(size), _code_of(far_size)
    n, value = size[pixels], code[pixels]
    if copies:
        more = [
            part
            for (s, extra, k), (t, rest, m) in zip(lengths, distances, strict=True)
            for part in ((code[256 + s], size[256 + s]), (extra, k), (far_code[t], far_size[t]), (rest, m))
        ]
        at = np.repeat(np.searchsorted(place, [s for s, _, _ in copies]), 4)
        value, n = np.insert(value, at, [int(v) for v, _ in more]), np.insert(n, at, [int(k) for _, k in more])
    end = np.cumsum(n) + w.n
    start = end - n
    word = start >> 5
    placed = value.astype(np.uint64) << (start & 31).astype(np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(word[-1]) + 3, np.uint64)
    words[word[heads]] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), heads)
    words[word[heads] + 1] += np.add.reduceat(placed >> np.uint64(32), heads)
    body = bytearray(words.astype("<u4").tobytes())
    for k, b in enumerate(w.value.to_bytes((w.n + 7) // 8, "little")):
        body[k] |= b
    return _file(bytes(body[: max((w.n + 7) // 8, (int(end[-1]) + 7) // 8)]), width, height)


# ---------------------------------------------------------------- the media column


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def to_media(text: bytes) -> bytes:
    """The payload of a text as one image, or as several files in a row where it is larger than an image can be."""
    payload = payload_of(text)
    files = []
    for lo in range(0, len(payload), IMAGE_BYTES):
        part = np.frombuffer(payload, np.uint8)[lo : lo + IMAGE_BYTES]
        rows = len(part) // UNIT
        wide = -(-rows // SIDE)
        height = -(-rows // wide)
        files.append(encode_samples(np.concatenate([part, np.full(height * wide * UNIT - len(part), 255, np.uint8)]), wide * UNIT, height))
    return b"".join(files)


def _files(media: bytes) -> Iterator[bytes]:
    while media:
        n = 8 + struct.unpack("<I", media[4:8])[0]
        yield media[:n]
        media = media[n:]


def from_media(medias: list[bytes]) -> list[np.ndarray]:
    """Samples of each media value, padding included."""
    files = [list(_files(m)) for m in medias]
    images = iter(decode_many([f for fs in files for f in fs]))
    return [np.concatenate([((next(images) >> 8) & 255).astype(np.uint8).reshape(-1) for _ in fs]) for fs in files]


def media_column(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` (struct of the kept columns), n_bytes and media of every row; null texts count as empty.

    A payload is the text in UTF-8, filled up with bytes 255 to a positive multiple of UNIT.  Equal texts have
    equal media; repeated rows are each stored.
    """
    prepare(docs.sparkSession)

    def build():
        claim("media")

        def work(texts):
            raw = [t or b"" for t in texts]
            return [pa.array([len(t) for t in raw], pa.int64()), pa.array([to_media(t) for t in raw], pa.binary())]

        return work

    return annotate(docs, "text", keep, "n_bytes bigint, media binary", build)


def pixel_arrays(stored: DataFrame) -> DataFrame:
    """row, image, height, width and pixels of every image of a media column: pixels are 32-bit numbers in rows, alpha, red, green, blue
    from the highest byte down.
    """
    added = stored.sparkSession.createDataFrame([], "image int, height int, width int, pixels array<bigint>").schema
    schema = type(added)([stored.schema["row"], *added.fields])

    def run(batches):
        claim("media")
        for b in batches:
            for lo in range(b.num_rows):
                one = b.slice(lo, 1)
                for k, p in enumerate(decode_many(list(_files(one.column(1)[0].as_py())))):
                    arrays = [one.column(0), pa.array([k], pa.int32()), pa.array([p.shape[0]], pa.int32()), pa.array([p.shape[1]], pa.int32()), pa.array([p.reshape(-1).astype(np.int64)], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return stored.select("row", "media").mapInArrow(run, schema)


_FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """row, n_bytes and, from the decoded pixels: size and SHA-256 of the payload, crc32 of its last 32 bytes, size and
    SHA-256 of the media, and the feature: rows, mean and counts of 16 equal bins of samples.
    """
    added = stored.sparkSession.createDataFrame([], _FEATURES).schema
    schema = type(added)([stored.schema["row"], stored.schema["n_bytes"], *added.fields])

    def run(batches):
        claim("media")
        for b in batches:
            n, medias = b.column(1).to_pylist(), b.column(2).to_pylist()
            rows = []
            for size, media, samples in zip(n, medias, from_media(medias), strict=True):
                full = max(1, -(-size // UNIT)) * UNIT
                p = samples[:full]
                bins = np.bincount(p >> 4, minlength=16)
                feature = f"{full // UNIT};{p.mean():.4f};" + ",".join(map(str, bins))
                rows.append((full, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return stored.select("row", "n_bytes", "media").mapInArrow(run, schema)


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of every document, stored, read back and decoded: sizes, digests and a feature.

    Null and empty texts are one unit of bytes 255; equal texts give equal rows but for doc_id; repeated rows stay; texts longer
    than an image continue in further images; an empty table gives an empty result.
    """
    stored, _ = store(media_column(table(spark, sf_dir, "documents"), ["doc_id"]), "media", "none")
    found = features(stored)
    return found.select(F.col("row.doc_id").alias("doc_id"), *[c for c in found.columns if c != "row"])
