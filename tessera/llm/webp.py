"""Lossless WebP (VP8L): a decoder for the whole format, and encoders for ARGB pixels and for 8-bit grey samples.

Written from the public specification of the WebP lossless bitstream. Pixels
are ARGB in 32-bit unsigned numbers.
"""

from __future__ import annotations

import heapq
from functools import cache
from itertools import pairwise

import numpy as np

# Fixed values of the format.
#: Order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Kinds of transforms.
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Symbols of the first alphabet that stand for lengths; colour-cache symbols follow.
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE, MOST_SIDE, MOST_COPY = 0x2F, 1 << 14, 4096

#: The encoder's longest code, and its fixed code for code lengths: how many bits each of the symbols used has.
CODE_BITS = 12
_LENGTH_BITS = {**dict.fromkeys(range(13), 4), 17: 4, 18: 3}
#: Least bytes of a line that is copied from an earlier equal one, and of a run at the end.
LEAST_COPY = 24


@cache
def neighbours() -> tuple[tuple[int, int], ...]:
    """(x, y) of the 120 near distance codes: by distance, then by |x|, right before left; x from -7 to 8, y from 0 to 7."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0])))


# ---- codes


def code_lengths(counts: dict[int, int], most: int = CODE_BITS) -> dict[int, int]:
    """Huffman code lengths of at least two symbols, none longer than ``most``."""
    while True:
        heap = [(n, i, s) for i, (s, n) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        k = len(heap)
        nodes: list[tuple] = []
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            heapq.heapreplace(heap, (a[0] + b[0], k, (a[2], b[2])))
            k += 1
        out: dict[int, int] = {}
        nodes = [(heap[0][2], 0)]
        while nodes:
            node, depth = nodes.pop()
            if type(node) is tuple:
                nodes += ((node[0], depth + 1), (node[1], depth + 1))
            else:
                out[node] = depth
        if max(out.values()) <= most:
            return out
        counts = {s: (n + 1) // 2 for s, n in counts.items()}


@cache
def _reversed(bits: int) -> np.ndarray:
    """All numbers of so many bits with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.r_[out * 2, out * 2 + 1]
    return out


class Code:
    """A canonical prefix code as a table over the next bits, first bit lowest."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.only, self.bits = int(used[0]), 0
            return
        self.only = -1
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order].astype(np.int64)
        self.bits = int(size[-1])
        parts = 1 << (self.bits - size)
        if parts.sum() != 1 << self.bits:
            raise ValueError("an incomplete prefix code")
        flip = _reversed(self.bits)
        self.symbol, self.size = np.repeat(order, parts)[flip], np.repeat(size, parts)[flip].astype(np.uint8)

    @classmethod
    def single(cls, symbol: int) -> Code:
        out = cls.__new__(cls)
        out.only, out.bits = symbol, 0
        return out


def codewords(lengths: dict[int, int]) -> dict[int, int]:
    """Each symbol's canonical codeword with its first bit lowest."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        before = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


def prefixed(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and their value, of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, top - 1, v & ((1 << (top - 1)) - 1)


# ---- decoding


class Bits:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data + b"\0" * 8, at
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        a = self.at
        self.at += n
        return (int.from_bytes(self.data[a >> 3 : (a >> 3) + 8], "little") >> (a & 7)) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        if code.only >= 0:
            return code.only
        a = self.at
        window = (int.from_bytes(self.data[a >> 3 : (a >> 3) + 4], "little") >> (a & 7)) & ((1 << code.bits) - 1)
        self.at += int(code.size[window])
        if self.at > self.end + 7:
            raise ValueError("the stream ends early")
        return int(code.symbol[window])

    def value(self, prefix: int) -> int:
        """A length or distance from its prefix symbol and the extra bits that follow."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1

    def code(self, alphabet: int) -> Code:
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            first = self.read(8 if wide else 1)
            if not two:
                return Code.single(first)
            lengths = np.zeros(max(alphabet, 256), np.int64)
            lengths[[first, self.read(8)]] = 1
            return Code(lengths)
        n = 4 + self.read(4)
        order = np.zeros(19, np.int64)
        for k in LENGTH_ORDER[:n]:
            order[k] = self.read(3)
        code = Code(order)
        left = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else alphabet
        lengths, last, i = np.zeros(alphabet, np.int64), 8, 0
        while i < alphabet and left:
            left -= 1
            s = self.symbol(code)
            if s < 16:
                lengths[i] = s
                last = s or last
                i += 1
            else:
                times = 3 + self.read(2) if s == 16 else 3 + self.read(3) if s == 17 else 11 + self.read(7)
                if i + times > alphabet:
                    raise ValueError("too many code lengths")
                lengths[i : i + times] = last if s == 16 else 0
                i += times
        return Code(lengths)


def _copy(out: np.ndarray, at: int, distance: int, length: int) -> None:
    """Copy from ``distance`` back; a copy may overlap what it writes."""
    if distance > at:
        raise ValueError("a copy from before the image")
    while length:
        n = min(distance, length)
        out[at : at + n] = out[at - distance : at - distance + n]
        at, length, distance = at + n, length - n, distance + n


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = neighbours()[code - 1]
    return max(1, x + y * width)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image of width x height pixels, flat."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache_size = 1 << cache_bits if cache_bits else 0
    groups, block, which, across = 1, 0, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block) if width & ((1 << block) - 1) == 0 else (width >> block) + 1
        down = (height + (1 << block) - 1) >> block
        which = (_image(bits, across, down, False) >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
        groups = int(which.max()) + 1
    codes = [[bits.code(n) for n in (LITERALS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    total = width * height
    out = np.zeros(total, np.uint32)
    if groups == 1 and not cache_size and all(c.only >= 0 for c in codes[0][1:4]):
        _one_channel(bits, codes[0], width, out)
        return out
    stored = np.zeros(max(1, cache_size), np.uint32)
    at = seen = 0  # pixels before ``seen`` are in the cache

    def remember(to: int) -> None:
        colours = out[seen:to]
        stored[(colours * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)] = colours  # the last of equal places stays

    while at < total:
        group = codes[which[(at // width >> block) * across + (at % width >> block)]] if which is not None else codes[0]
        s = bits.symbol(group[0])
        if s < LITERALS:
            red, blue, alpha = (bits.symbol(c) for c in group[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < LITERALS + LENGTHS:
            length = bits.value(s - LITERALS)
            distance = _distance(bits.value(bits.symbol(group[4])), width)
            if at + length > total:
                raise ValueError("a copy beyond the image")
            _copy(out, at, distance, length)
            at += length
        else:
            if seen < at:
                remember(at)
                seen = at
            out[at] = stored[s - LITERALS - LENGTHS]
            at += 1
    return out


def _one_channel(bits: Bits, codes: list[Code], width: int, out: np.ndarray) -> None:
    """An image where only green varies: looks up the symbol at every bit at once, then follows the ones that count."""
    green, rest = codes[0], np.uint32(codes[3].only << 24 | codes[1].only << 16 | codes[2].only)
    total = len(out)
    if green.only >= 0:
        out[:] = rest | np.uint32(green.only << 8)
        return
    first = bits.at >> 3
    b = np.frombuffer(bits.data, np.uint8)[first:].astype(np.uint32)
    words = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16)
    window = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).ravel()
    symbols = green.symbol[window].astype(np.uint16)
    step = np.where(symbols < LITERALS, green.size[window], 0).astype(np.uint8)  # 0 ends a run of literals
    next_ = step[np.minimum(np.arange(len(step), dtype=np.int32) + step, len(step) - 1)]
    steps = np.where((step > 0) & (next_ > 0), step + next_, 0).astype(np.uint8).tobytes()  # two literals at once
    p, at, end = bits.at - 8 * first, 0, bits.end - 8 * first
    while at < total:
        pairs: list[int] = []
        add = pairs.append
        while two := steps[p] if p < end else 0:
            add(p)
            p += two
        places = np.empty(2 * len(pairs) + 1, np.int64)
        places[:-1:2] = pairs
        places[1::2] = places[:-1:2] + step[places[:-1:2]]
        places[-1] = p
        n = min(len(places) - 1 + (p < end and step[p] > 0), total - at)
        if n < len(places):
            p = int(places[n])  # a copy, or what follows the image
        else:
            p += int(step[p])
        if n:
            out[at : at + n] = symbols[places[:n]].astype(np.uint32) << np.uint32(8) | rest
            at += n
        if at < total:
            if p >= end:
                raise ValueError("the stream ends early")
            bits.at = 8 * first + p
            length = bits.value(bits.symbol(green) - LITERALS)
            distance = _distance(bits.value(bits.symbol(codes[4])), width)
            if at + length > total:
                raise ValueError("a copy beyond the image")
            _copy(out, at, distance, length)
            at += length
            p = bits.at - 8 * first
    bits.at = 8 * first + p


def _channels(x: np.ndarray) -> np.ndarray:
    """(..., 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    guess = left + top - corner
    near = np.abs(guess - left).sum(-1, keepdims=True) < np.abs(guess - top).sum(-1, keepdims=True)
    return np.where(near, left, top)


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The predictions of pixels' four channels (as integers, in the last axis) from those before them."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255]), top.shape)
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int64), 0, 255)
    return (
        lambda: left, lambda: top, lambda: right, lambda: corner,
        lambda: _average(_average(left, right), top), lambda: _average(left, corner), lambda: _average(left, top),
        lambda: _average(corner, top), lambda: _average(top, right), lambda: _average(_average(left, corner), _average(top, right)),
    )[mode - 1]()


def _guesses(mode: int, p: np.ndarray) -> np.ndarray:
    """Predictions by one mode of all pixels but the first row and column of whole pictures (height, width, 4)."""
    right = np.concatenate([p[:-1, 2:], p[1:, :1]], 1)  # beyond the row's end is the next row's first pixel
    return predict(mode, p[1:, :-1], p[:-1, 1:], right, p[:-1, :-1])


def _unpredict(pixels: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    """Add predictions to residuals.

    The first row and column come first. A pixel needs those to its left and,
    in the row above, up to one to its right. So all pixels with the same
    x + 2y can be found at once, after those with less.
    """
    p = _channels(pixels.reshape(height, width)).astype(np.int64)
    across = (width + (1 << block) - 1) >> block
    p[0, 0] += [0, 0, 0, 255]
    p[0] = p[0].cumsum(0) & 255
    p[:, 0] = p[:, 0].cumsum(0) & 255
    if height == 1 or width == 1:
        return np.ascontiguousarray(p.astype(np.uint8)).view(np.uint32).ravel()
    used = np.unique(modes)
    if len(used) == 1 and used[0] in (0, 1, 2):  # plain sums along rows or columns
        if used[0] == 0 or used[0] > 13:
            p[1:, 1:] += [0, 0, 0, 255]
        elif used[0] == 1:
            p[1:] = p[1:].cumsum(1)
        else:
            p[:, 1:] = p[:, 1:].cumsum(0)
        return np.ascontiguousarray((p & 255).astype(np.uint8)).view(np.uint32).ravel()
    for t in range(3, width - 1 + 2 * (height - 1) + 1):
        y = np.arange(max(1, -(-(t - width + 1) // 2)), min(height - 1, (t - 1) // 2) + 1)
        x = t - 2 * y
        mode = modes[(y >> block) * across + (x >> block)]
        left, top, corner = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
        right = np.where((x + 1 < width)[:, None], p[y - 1, np.minimum(x + 1, width - 1)], p[y, 0])
        for m in np.unique(mode).tolist():
            of = np.flatnonzero(mode == m)
            p[y[of], x[of]] = (p[y[of], x[of]] + predict(m, left[of], top[of], right[of], corner[of])) & 255
    return np.ascontiguousarray(p.astype(np.uint8)).view(np.uint32).ravel()


def _uncross(pixels: np.ndarray, width: int, height: int, block: int, multipliers: np.ndarray) -> np.ndarray:
    across = (width + (1 << block) - 1) >> block
    y, x = np.divmod(np.arange(width * height), width)
    m = _channels(multipliers)[(y >> block) * across + (x >> block)].view(np.int8).astype(np.int64)
    c = _channels(pixels).copy()
    green = c[:, 1].view(np.int8).astype(np.int64)
    red = (c[:, 2] + ((m[:, 0] * green) >> 5)) & 255
    blue = c[:, 0] + ((m[:, 1] * green) >> 5) + ((m[:, 2] * red.astype(np.uint8).view(np.int8).astype(np.int64)) >> 5)
    c[:, 2], c[:, 0] = red, blue & 255
    return c.view(np.uint32).ravel()


def _add_green(pixels: np.ndarray) -> np.ndarray:
    c = _channels(pixels).copy()
    c[:, 2] += c[:, 1]
    c[:, 0] += c[:, 1]
    return c.view(np.uint32).ravel()


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width) of one file: RIFF container with a VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25:
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(bytes(data[20 : 20 + size]))
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless WebP stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # whether alpha is used: a hint
    if bits.read(3):
        raise ValueError("an unknown version")
    undo = []
    inner = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            part = _image(bits, (inner + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            undo.append((kind, inner, block, part >> np.uint32(8) & np.uint32(255) if kind == PREDICTOR else part))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, inner, 0, None))
        else:
            n = bits.read(8) + 1
            table = (_channels(_image(bits, n, 1, False)).cumsum(0) & 255).astype(np.uint8).view(np.uint32).ravel()
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, inner, bundle, table))
            inner = (inner + (1 << bundle) - 1) >> bundle
    pixels = _image(bits, inner, height, True)
    for kind, wide, block, part in reversed(undo):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, wide, height, block, part)
        elif kind == CROSS_COLOUR:
            pixels = _uncross(pixels, wide, height, block, part)
        elif kind == SUBTRACT_GREEN:
            pixels = _add_green(pixels)
        else:
            index = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
            if block:  # several indexes in a pixel, the first lowest
                each = 8 >> block
                index = (index[:, :, None] >> (np.arange(1 << block, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :wide]
            table = np.zeros(256, np.uint32)
            table[: len(part)] = part
            pixels = table[index].ravel()
    return pixels.reshape(height, width)


# ---- encoding


class Writer:
    def __init__(self) -> None:
        self.value = self.size = 0

    def add(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def simple(self, *symbols: int) -> None:
        """A code of one or two symbols below 256."""
        self.add(1, 1)
        self.add(len(symbols) - 1, 1)
        self.add(int(symbols[0] > 1), 1)
        self.add(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) > 1:
            self.add(symbols[1], 8)

    def normal(self, lengths: dict[int, int], alphabet: int) -> None:
        """A code of at least two symbols by their lengths."""
        value, size = _length_header()
        self.add(value, size)
        words = _length_words()
        self.add(0, 1)  # lengths of the whole alphabet follow
        last = -1
        for s in [*sorted(lengths), alphabet]:
            gap = s - last - 1
            while gap:
                if gap >= 11:
                    n = min(gap, 138)
                    self.add(words[18], 3)
                    self.add(n - 11, 7)
                elif gap >= 3:
                    n = gap
                    self.add(words[17], 4)
                    self.add(n - 3, 3)
                else:
                    n = 1
                    self.add(words[0], 4)
                gap -= n
            if s < alphabet:
                self.add(words[lengths[s]], 4)
            last = s

    def code(self, counts: dict[int, int], alphabet: int) -> dict[int, tuple[int, int]]:
        """Write the best code for these counts; each symbol's codeword and its bits."""
        if len(counts) == 1:
            (s,) = counts
            self.simple(s)
            return {s: (0, 0)}
        lengths = code_lengths(counts)
        self.normal(lengths, alphabet)
        words = codewords(lengths)
        return {s: (words[s], n) for s, n in lengths.items()}


@cache
def _length_words() -> dict[int, int]:
    return codewords(_LENGTH_BITS)


@cache
def _length_header() -> tuple[int, int]:
    w = Writer()
    w.add(0, 1)
    n = max(i for i, k in enumerate(LENGTH_ORDER) if k in _LENGTH_BITS) + 1
    w.add(n - 4, 4)
    for k in LENGTH_ORDER[:n]:
        w.add(_LENGTH_BITS.get(k, 0), 3)
    return w.value, w.size


def _packed(values: np.ndarray, sizes: np.ndarray, head: Writer) -> bytes:
    """The head's bits, then the values of these sizes (at most 16 bits each)."""
    start = head.size % 8
    whole = head.value.to_bytes(-(-head.size // 8), "little")
    ends = np.cumsum(sizes) + start
    begins = ends - sizes
    place = begins >> 5
    shifted = values.astype(np.uint64) << (begins & 31).astype(np.uint64)
    groups = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    at = place[groups]
    words[at] = np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), groups)
    words[at + 1] += np.add.reduceat(shifted >> np.uint64(32), groups)
    if start:
        words[0] |= np.uint64(whole[-1])
        whole = whole[:-1]
    return whole + words.astype("<u4").tobytes()[: -(-int(ends[-1]) // 8)]


def _copies(data: bytes) -> list[tuple[int, int, int]]:
    """(place, distance, length): lines that equal an earlier line, and a run of one byte at the end."""
    out = []
    seen: dict[bytes, int] = {}
    at = 0
    tail = len(data)
    run = len(data) - len(data.rstrip(data[-1:])) if data else 0
    if run > LEAST_COPY:
        tail = len(data) - run + 1
    if data.count(b"\n") > 1:
        for line in data.split(b"\n"):
            end = min(at + len(line) + 1, tail)
            if end - at >= LEAST_COPY:
                before = seen.setdefault(line, at)
                if before < at and before + end - at <= at:
                    out.append((at, at - before, end - at))
            at += len(line) + 1
    if run > LEAST_COPY:
        out.append((tail, 1, run - 1))
    return out


def _entropy(values: np.ndarray, alphabet: int = 256) -> float:
    """Bits that the values need at least, each coded on its own."""
    n = np.bincount(values, minlength=alphabet)
    n = n[n > 0]
    return float(-(n * np.log2(n / n.sum())).sum())


def _cost(channels: np.ndarray) -> float:
    return sum(_entropy(channels[..., k].ravel()) for k in range(4))


def _predicted(p: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, mode of each block) of channels (height, width, 4): in each block the mode with the least residuals."""
    height, width = p.shape[:2]
    whole = p.astype(np.int64)
    out = whole.copy()
    out[0, 1:] -= whole[0, :-1]
    out[1:, 0] -= whole[:-1, 0]
    out[0, 0] -= [0, 0, 0, 255]
    across, down = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
    modes = np.zeros((down, across), np.int64)
    if height > 1 and width > 1:
        rest = np.stack([(whole[1:, 1:] - _guesses(m, whole)) & 255 for m in range(14)])
        size = np.minimum(rest, 256 - rest).sum(-1)
        y, x = np.arange(1, height) >> block, np.arange(1, width) >> block
        total = np.zeros((14, down, across), np.int64)
        for m in range(14):
            np.add.at(total[m], (y[:, None], x[None, :]), size[m])
        modes = total.argmin(0)
        out[1:, 1:] = np.take_along_axis(rest, modes[y[:, None], x[None, :]][None, :, :, None], 0)[0]
    return (out & 255).astype(np.uint8), modes


def _multiplier(to: np.ndarray, by: np.ndarray) -> int:
    """The multiplier (of a thirty-second) by which ``by`` tells most of ``to``, both signed."""
    square = float((by * by).sum())
    return int(np.clip(round(32 * float((to * by).sum()) / square), -128, 127)) if square else 0


def _crossed(p: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(channels, multipliers of each block): red and blue without what green, and blue without what red tells of them."""
    height, width = p.shape[:2]
    out = p.copy()
    down, across = (height + (1 << block) - 1) >> block, (width + (1 << block) - 1) >> block
    factors = np.zeros((down, across, 4), np.uint8)
    factors[..., 3] = 255
    for j in range(down):
        for i in range(across):
            part = (slice(j << block, (j + 1) << block), slice(i << block, (i + 1) << block))
            blue, green, red = (p[part][..., k].view(np.int8).astype(np.int64) for k in range(3))
            to_red, to_blue = _multiplier(red, green), _multiplier(blue, green)
            left = (blue - ((to_blue * green) >> 5)).astype(np.int8).astype(np.int64)
            red_to_blue = _multiplier(left, red)
            out[part + (2,)] = (red - ((to_red * green) >> 5)) & 255
            out[part + (0,)] = (left - ((red_to_blue * red) >> 5)) & 255
            factors[j, i, :3] = [to_red & 255, to_blue & 255, red_to_blue & 255]
    return out, factors


def _hits(pixels: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the colour cache, whether the pixel is there) of each pixel."""
    place = ((pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    sorted_, colour = place[order], pixels[order]
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (sorted_[1:] == sorted_[:-1]) & (colour[1:] == colour[:-1])
    # an empty place holds a pixel of four zeros
    first = order[np.r_[True, sorted_[1:] != sorted_[:-1]]] if len(order) else order
    hit[first] = pixels[first] == 0
    return place, hit


def _best_cache(pixels: np.ndarray) -> int:
    """The size of the colour cache, as a power of two, for which the codes need least; 0 without."""
    c = _channels(pixels)
    costs = {0: _cost(c)}
    for bits in (2, 4, 6, 8, 10):
        place, hit = _hits(pixels, bits)
        first = np.where(hit, LITERALS + LENGTHS + place, c[:, 1])
        costs[bits] = _entropy(first, LITERALS + LENGTHS + (1 << bits)) + sum(_entropy(c[~hit, k]) for k in (0, 2, 3) if (~hit).any()) + 4 * min(1 << bits, hit.sum())
    return min(costs, key=lambda b: (costs[b], b))


def _coded(head: Writer, pixels: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """Write the codes of an entropy-coded image; (values, sizes) of its pixels' bits."""
    c = _channels(pixels)
    cache_bits = _best_cache(pixels) if main else 0
    head.add(1 if cache_bits else 0, 1)
    if cache_bits:
        head.add(cache_bits, 4)
    if main:
        head.add(0, 1)  # one group of codes
    first, hit = c[:, 1].astype(np.int64), np.zeros(len(pixels), bool)
    if cache_bits:
        place, hit = _hits(pixels, cache_bits)
        first = np.where(hit, LITERALS + LENGTHS + place, first)
    alphabet = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    values, sizes = np.zeros((len(pixels), 4), np.int64), np.zeros((len(pixels), 4), np.int64)
    for k, (column, n) in enumerate(((first, alphabet), *((c[~hit, j].astype(np.int64), 256) for j in (2, 0, 3)))):
        tally = np.bincount(column, minlength=n) if len(column) else np.array([1])
        used = {int(s): int(tally[s]) for s in np.flatnonzero(tally)}
        if len(used) == 1 and next(iter(used)) > 255:  # a lone symbol is written in eight bits
            used |= {0: 0}
        words = head.code(used, n)
        value, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for s, (v, m) in words.items():
            value[s], size[s] = v, m
        of = np.ones(len(pixels), bool) if k == 0 else ~hit
        values[of, k], sizes[of, k] = value[column], size[column]
    head.simple(0)  # no distances
    return values.ravel(), sizes.ravel()


def _add(head: Writer, values: np.ndarray, sizes: np.ndarray) -> None:
    for v, n in zip(values.tolist(), sizes.tolist(), strict=True):
        if n:
            head.add(v, n)


def _start(width: int, height: int) -> Writer:
    head = Writer()
    head.add(SIGNATURE, 8)
    head.add(width - 1, 14)
    head.add(height - 1, 14)
    head.add(1, 1)
    head.add(0, 3)
    return head


def _file(head: Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    has = sizes > 0
    body = _packed(values[has], sizes[has], head) if has.any() else head.value.to_bytes(-(-head.size // 8), "little")
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def encode(pixels: np.ndarray, block: int = 4) -> bytes:
    """A WebP file of ARGB pixels (height, width).

    Predictors, cross-colour and subtract-green are used where the channels
    need fewer bits after them, the colour cache where its codes need fewer.
    """
    height, width = pixels.shape
    head = _start(width, height)
    c = _channels(np.ascontiguousarray(pixels, np.uint32))
    rest, modes = _predicted(c, block)
    if _cost(rest) + 4 * modes.size < _cost(c):
        head.add(1 | PREDICTOR << 1, 3)
        head.add(block - 2, 3)
        _add(head, *_coded(head, (modes.ravel() << 8).astype(np.uint32), False))
        c = rest
    crossed, factors = _crossed(c, block)
    if _cost(crossed) + 24 * factors.shape[0] * factors.shape[1] < _cost(c):
        head.add(1 | CROSS_COLOUR << 1, 3)
        head.add(block - 2, 3)
        _add(head, *_coded(head, factors.reshape(-1).view(np.uint32), False))
        c = crossed
    green = c.copy()
    green[..., 0] -= c[..., 1]
    green[..., 2] -= c[..., 1]
    if _cost(green) < _cost(c):
        head.add(1 | SUBTRACT_GREEN << 1, 3)
        c = green
    head.add(0, 1)  # the transforms end
    values, sizes = _coded(head, np.ascontiguousarray(c).view(np.uint32).ravel(), True)
    return _file(head, values, sizes)


def _flat_mode(rows: np.ndarray) -> tuple[int, np.ndarray] | None:
    """(mode, residuals) of grey rows if the pixel to the left or above tells so much of each that it needs less than three quarters of the bits."""
    above = len(rows) > 1 and 3 * np.count_nonzero(rows[1:] == rows[:-1]) > rows[1:].size  # most texts have neither
    if not above and np.abs(np.diff(rows.ravel().view(np.int8))).astype(np.uint8).mean() > 8:
        return None
    best = 0.75 * _entropy(rows.ravel())
    out = None
    for mode, axis in ((1, 1), (2, 0)) if best else ():
        rest = np.diff(rows, axis=axis, prepend=np.uint8(0))
        rest[0], rest[1:, 0] = np.diff(rows[0], prepend=np.uint8(0)), np.diff(rows[:, 0])
        if (bits := _entropy(rest.ravel())) < best:
            best, out = bits, (mode, rest)
    return out


def encode_grey(data: bytes, width: int) -> bytes:
    """A WebP file of grey pixels with these values, a row of ``width`` after the other.

    Green alone is coded, red and blue follow by the subtract-green transform.
    Where the pixel to the left or above tells much of each, residuals to it
    are coded. Else a palette holds the values that occur, indexes to it have a
    prefix code, and repeated lines and the padding are copied.
    """
    samples = np.frombuffer(data, np.uint8)
    height = len(samples) // width
    if (flat := _flat_mode(samples.reshape(height, width))) is not None:
        head = _start(width, height)
        head.add(1 | SUBTRACT_GREEN << 1, 3)
        head.add(1 | PREDICTOR << 1, 3)
        head.add(7, 3)  # blocks of 512 pixels
        _add(head, *_coded(head, np.full(-(-width // 512) * -(-height // 512), flat[0] << 8, np.uint32), False))
        head.add(0, 1)
        first = flat[1].ravel().astype(np.uint32) << np.uint32(8)
        return _file(head, *_coded(head, first, True))
    counts = np.bincount(samples, minlength=256)
    palette = np.flatnonzero(counts)
    place = np.zeros(256, np.int64)
    place[palette] = np.arange(len(palette))

    head = _start(width, height)
    head.add(1 | SUBTRACT_GREEN << 1, 3)
    head.add(1 | PALETTE << 1, 3)
    head.add(len(palette) - 1, 8)
    head.add(0, 1)  # no colour cache
    steps = [int(palette[0]), *(int(b - a) for a, b in pairwise(palette))]
    table: dict[int, int] = {}
    for s in steps:
        table[s] = table.get(s, 0) + 1
    green = head.code(table, LITERALS + LENGTHS)
    head.simple(0)
    head.simple(0)
    if len(steps) > 1:
        head.simple(255, 0)
        opaque, clear = 1, 0  # of two symbols the smaller has codeword 0
    else:
        head.simple(255)
        opaque = clear = 0
    head.simple(0)
    for i, s in enumerate(steps):
        head.add(*green[s])
        if len(steps) > 1:
            head.add(clear if i else opaque, 1)
    head.add(0, 1)  # the transforms end
    head.add(0, 2)  # neither colour cache nor groups of codes

    bundle = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    index = place[samples]
    if bundle:
        index = index.reshape(height, width)
        index = np.pad(index, ((0, 0), (0, -width % (1 << bundle)))).reshape(height, -1, 1 << bundle)
        index = (index << (np.arange(1 << bundle) * (8 >> bundle))).sum(2).ravel()
    copies = [] if bundle else _copies(data)
    literal = np.ones(len(index), bool)
    extra: list[tuple[int, list[tuple[int, ...]]]] = []
    for at, distance, length in copies:
        literal[at : at + length] = False
        near = 2 if distance == 1 else distance + 120
        parts = [MOST_COPY] * (length // MOST_COPY) + [length % MOST_COPY] * (length % MOST_COPY > 0)
        extra.append((at, [(*prefixed(n), *prefixed(near)) for n in parts]))
    kept = index[literal]
    tally = np.bincount(kept, minlength=256)
    used = {int(s): int(tally[s]) for s in np.flatnonzero(tally)}
    far: dict[int, int] = {}
    for _, parts in extra:
        for p in parts:
            used[LITERALS + p[0]] = used.get(LITERALS + p[0], 0) + 1
            far[p[3]] = far.get(p[3], 0) + 1
    words = head.code(used, LITERALS + LENGTHS)
    head.simple(0)
    head.simple(0)
    head.simple(0)
    distances = head.code(far or {0: 1}, DISTANCES)

    value, size = np.zeros(LITERALS, np.uint32), np.zeros(LITERALS, np.int64)
    for s, (v, n) in words.items():
        if s < LITERALS:
            value[s], size[s] = v, n
    values, sizes = value[kept], size[kept]
    if extra:
        before = np.cumsum(literal)
        ats, more = [], []
        for at, parts in extra:
            for n, n_bits, n_value, d, d_bits, d_value in parts:
                for v, k in (words[LITERALS + n], (n_value, n_bits), distances[d], (d_value & 0xFFF, min(d_bits, 12)), (d_value >> 12, max(0, d_bits - 12))):
                    ats.append(int(before[at - 1]) if at else 0)
                    more.append((v, k))
        values, sizes = np.insert(values, ats, [v for v, _ in more]), np.insert(sizes, ats, [k for _, k in more])
    return _file(head, values, sizes)
