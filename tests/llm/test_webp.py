"""The codec: round trips of the encoder, and every other feature by streams that the tests write."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import webp as W
from tessera.llm.media import load, payload, samples, store


@pytest.mark.parametrize("seed", range(12))
def test_round_trip(seed):
    r = random.Random(seed)
    kinds = [b"", b"a", b"ab" * 500, bytes(range(256)) * 3, b"abcd" * 100, b"x" * 9000, b"a line that is long enough to copy\n" * 60, bytes(r.randrange(16) for _ in range(999)), bytes(r.randrange(256) for _ in range(r.randrange(3000))), "é😀 ß ".encode() * 50, b"\n" * 500, b"abc\n" * 90 + b" " * 100]
    data = payload(kinds[seed])
    pixels = W.decode(W.encode_grey(data, 192))
    bgra = pixels.view(np.uint8).reshape(-1, 4)
    assert pixels.shape == (len(data) // 192, 192) and bgra[:, 1].tobytes() == data
    assert (bgra[:, 0] == bgra[:, 1]).all() and (bgra[:, 2] == bgra[:, 1]).all() and (bgra[:, 3] == 255).all()


def test_neighbours_are_those_of_the_format():
    n = W.neighbours()
    assert len(n) == 120 and n[:12] == ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)) and n[-3:] == ((-7, 7), (8, 6), (8, 7))


@pytest.mark.parametrize("value", [1, 2, 3, 4, 5, 6, 7, 9, 24, 25, 120, 121, 4096, 4097, 1 << 20])
def test_prefixed_values(value):
    symbol, n, extra = W.prefixed(value)
    w = W.Writer()
    w.add(extra, n)
    assert W.Bits(w.value.to_bytes(8, "little")).value(symbol) == value


class Stream(W.Writer):
    """A VP8L stream written by hand."""

    def __init__(self, width, height):
        super().__init__()
        for value, n in ((W.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 4)):
            self.add(value, n)

    def plain(self, pixels, main=True, cache=0, groups=None, width=None):
        """An entropy-coded image with 8-bit codes for all channels; a pixel may be ("copy", length, distance code) or ("cache", index)."""
        self.add(1 if cache else 0, 1)
        if cache:
            self.add(cache, 4)
        if main:
            self.add(1 if groups else 0, 1)
            if groups:
                bits, codes, count = groups
                self.add(bits - 2, 3)
                self.plain([c << 8 for c in codes], main=False)
            else:
                count = 1
        else:
            count = 1
        alphabet = 280 + (1 << cache if cache else 0)
        lengths = dict.fromkeys(range(alphabet), 9)
        for s in range(512 - alphabet):  # so many are one bit shorter, which makes the code complete
            lengths[s] = 8
        for _ in range(count):
            self.normal(lengths, alphabet)
            for _ in range(3):
                self.normal(dict.fromkeys(range(256), 8), 256)
            self.normal({**dict.fromkeys(range(24), 5), **dict.fromkeys(range(24, 40), 6)}, 40)
        green, eight = W.codewords(lengths), W.codewords(dict.fromkeys(range(256), 8))
        far = {**dict.fromkeys(range(24), 5), **dict.fromkeys(range(24, 40), 6)}
        for p in pixels:
            if isinstance(p, tuple) and p[0] == "copy":
                for v, words, sizes, base in ((p[1], green, lengths, 256), (p[2], W.codewords(far), far, 0)):
                    s, n, extra = W.prefixed(v)
                    self.add(words[base + s], sizes[base + s])
                    self.add(extra, n)
            elif isinstance(p, tuple):
                self.add(green[280 + p[1]], lengths[280 + p[1]])
            else:
                self.add(green[p >> 8 & 255], lengths[p >> 8 & 255])
                for shift in (16, 0, 24):
                    self.add(eight[p >> shift & 255], 8)

    def file(self):
        body = self.value.to_bytes(-(-self.size // 8), "little")
        body += b"\0" * (len(body) & 1)
        return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def picture(width, height, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 32, width * height, dtype=np.uint32)


def test_plain_copies_and_cache():
    p = [int(x) for x in picture(8, 1)]
    place = (p[2] * W.CACHE_FACTOR & 0xFFFFFFFF) >> 28
    s = Stream(8, 4)
    s.add(0, 1)
    s.plain([*p, ("cache", place), ("copy", 7, 1), ("copy", 5, 120 + 5), p[0], p[1], ("copy", 9, 2)], cache=4)
    got = W.decode(s.file()).ravel().tolist()
    cached = next(x for x in reversed(p) if (x * W.CACHE_FACTOR & 0xFFFFFFFF) >> 28 == place)
    want = [*p, cached]
    want += [want[len(want) - 8 + i] for i in range(7)]  # code 1 is the pixel above
    for _ in range(5):
        want.append(want[-5])
    want += [p[0], p[1]]
    for _ in range(9):
        want.append(want[-1])  # code 2 is the pixel to the left
    assert got == want


def test_groups_of_codes():
    p = [int(x) for x in picture(10, 6)]
    s = Stream(10, 6)
    s.add(0, 1)
    s.plain(p, groups=(2, [0, 1, 1, 1, 0, 1], 2))
    assert W.decode(s.file()).ravel().tolist() == p


def test_predictors():
    for mode in range(14):
        width, height = 5, 4
        want = picture(width, height, mode)
        c = want.view(np.uint8).reshape(height, width, 4).astype(np.int64)
        rest = np.zeros_like(c)
        for y in range(height):
            for x in range(width):
                if y == 0:
                    guess = np.array([0, 0, 0, 255]) if x == 0 else c[0, x - 1]
                elif x == 0:
                    guess = c[y - 1, 0]
                else:
                    guess = brute_guess(mode, c[y, x - 1], c[y - 1, x], c[y - 1, x + 1] if x + 1 < width else c[y, 0], c[y - 1, x - 1])
                rest[y, x] = (c[y, x] - guess) & 255
        s = Stream(width, height)
        s.add(1, 1)
        s.add(W.PREDICTOR, 2)
        s.add(0, 3)
        s.plain([mode << 8] * 2, main=False)
        s.add(0, 1)
        s.plain([int(v) for v in rest.astype(np.uint8).reshape(-1).view(np.uint32)])
        assert (W.decode(s.file()).ravel() == want).all(), mode


def test_predictors_of_several_blocks():
    """Every mode in some block of a larger picture, against pixel after pixel."""
    width, height, block = 23, 19, 2
    across, down = 6, 5
    modes = np.random.default_rng(8).integers(0, 14, across * down)
    want = picture(width, height, 77)
    c = want.view(np.uint8).reshape(height, width, 4).astype(np.int64)
    rest = np.zeros_like(c)
    for y in range(height):
        for x in range(width):
            guess = np.array([0, 0, 0, 255]) if x == y == 0 else c[0, x - 1] if y == 0 else c[y - 1, 0] if x == 0 else None
            if guess is None:
                guess = brute_guess(int(modes[(y >> block) * across + (x >> block)]), c[y, x - 1], c[y - 1, x], c[y - 1, x + 1] if x + 1 < width else c[y, 0], c[y - 1, x - 1])
            rest[y, x] = (c[y, x] - guess) & 255
    flat = rest.astype(np.uint8).reshape(-1).view(np.uint32)
    assert (W._unpredict(flat, width, height, block, modes) == want).all()


def brute_guess(mode, left, top, right, corner):
    half = lambda a, b: [(int(x) + int(y)) // 2 for x, y in zip(a, b, strict=True)]
    clip = lambda v: [min(255, max(0, int(x))) for x in v]
    if mode == 11:
        guess = [int(a) + int(b) - int(d) for a, b, d in zip(left, top, corner, strict=True)]
        near = sum(abs(g - int(a)) for g, a in zip(guess, left, strict=True)) < sum(abs(g - int(b)) for g, b in zip(guess, top, strict=True))
        return left if near else top
    if mode == 13:
        mean = half(left, top)
        return clip(m + int((m - int(d)) / 2) for m, d in zip(mean, corner, strict=True))
    return np.array({
        0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top), 8: half(corner, top), 9: half(top, right),
        10: half(half(left, corner), half(top, right)), 12: clip([int(a) + int(b) - int(d) for a, b, d in zip(left, top, corner, strict=True)]),
    }[mode])


def test_cross_colour_and_green():
    want = picture(6, 5, 3)
    c = want.view(np.uint8).reshape(-1, 4).astype(np.int64)
    sign = lambda v: v - 256 if v > 127 else v
    to_red, to_blue, red_to_blue = 33, 200, 90
    out = []
    for blue, green, red, alpha in c.tolist():
        r = (red - (sign(to_red) * sign(green) >> 5)) & 255
        b = (blue - (sign(to_blue) * sign(green) >> 5) - (sign(red_to_blue) * sign(red) >> 5)) & 255
        out.append(alpha << 24 | (r - green & 255) << 16 | green << 8 | (b - green & 255))
    s = Stream(6, 5)
    s.add(1, 1)
    s.add(W.CROSS_COLOUR, 2)
    s.add(1, 3)
    s.plain([255 << 24 | red_to_blue << 16 | to_blue << 8 | to_red], main=False)
    s.add(1, 1)
    s.add(W.SUBTRACT_GREEN, 2)
    s.add(0, 1)
    s.plain(out)
    assert (W.decode(s.file()).ravel() == want).all()


@pytest.mark.parametrize("colours", [2, 3, 11, 40])
def test_palettes(colours):
    table = picture(colours, 1, colours)
    index = np.random.default_rng(1).integers(0, colours, (5, 13))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each = 8 >> bits
    packed = [sum(int(v) << (each * i) for i, v in enumerate(row[x : x + (1 << bits)])) << 8 for row in index for x in range(0, 13, 1 << bits)]
    steps = (np.diff(table.view(np.uint8).reshape(-1, 4).astype(int), axis=0, prepend=0) & 255).astype(np.uint8).reshape(-1).view(np.uint32)
    s = Stream(13, 5)
    s.add(1, 1)
    s.add(W.PALETTE, 2)
    s.add(colours - 1, 8)
    s.plain([int(x) for x in steps], main=False)
    s.add(0, 1)
    s.plain(packed)
    assert (W.decode(s.file()) == table[index]).all()


def smooth(width, height, seed, noise=3):
    """A picture with gradients, correlated channels and a little noise."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    g = (x * r.uniform(0.2, 3) + y * r.uniform(0.2, 3) + 20 * np.sin(x / 9) + r.integers(0, noise, (height, width))).astype(np.int64)
    c = np.stack([g * 1.4 + 7 + r.integers(0, 2, g.shape), g, g * 0.6 - 30, np.full(g.shape, 255)], -1).astype(np.int64) & 255
    return np.ascontiguousarray(c.astype(np.uint8)).view(np.uint32)[..., 0]


def transforms(data):
    """Which transforms a file has, and the bits of its colour cache."""
    seen, image = [], W._image
    caches = []

    class Spy(W.Bits):
        pass

    bits = Spy(data[20:])
    bits.at = 40
    width, height = (int.from_bytes(data[21:25], "little") & 0x3FFF) + 1, (int.from_bytes(data[21:25], "little") >> 14 & 0x3FFF) + 1
    while bits.read(1):
        kind = bits.read(2)
        seen.append(kind)
        if kind < 2:
            block = bits.read(3) + 2
            image(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
        elif kind == W.PALETTE:
            n = bits.read(8) + 1
            image(bits, n, 1, False)
    caches.append(bits.read(4) if bits.read(1) else 0)
    return seen, caches[0]


@pytest.mark.parametrize(("width", "height"), [(1, 1), (1, 9), (9, 1), (2, 2), (40, 33), (100, 70), (17, 64)])
def test_pictures_round_trip(width, height):
    for p in (smooth(width, height, width), picture(width, height).reshape(height, width), np.zeros((height, width), np.uint32), smooth(width, height, 1, 1) // 7 * 7, np.tile(picture(5, 1), (height, width))[:, :width]):
        assert (W.decode(W.encode(p)) == p).all()


def test_transforms_are_used_where_they_help():
    p = smooth(120, 90, 4)
    data = W.encode(p)
    seen, _ = transforms(data)
    assert W.PREDICTOR in seen and W.CROSS_COLOUR in seen and len(data) < 0.5 * 4 * p.size
    few = picture(12, 1)[np.random.default_rng(2).integers(0, 12, (50, 60))]
    data = W.encode(few)
    seen, cache = transforms(data)
    assert W.PREDICTOR not in seen and cache > 0 and len(data) < 0.75 * few.size and (W.decode(data) == few).all()


def test_grey_rows_that_predict_each_other():
    r = random.Random(7)
    row = bytes(r.randrange(32, 127) for _ in range(192))
    ramp = b"".join(bytes((i + j // 3) % 256 for j in range(192)) for i in range(40))
    for data, mode in ((row * 30, 2), (ramp, None), (row * 600, 2)):
        media = W.encode_grey(data, 192)
        seen, _ = transforms(media)
        assert seen == [W.SUBTRACT_GREEN, W.PREDICTOR] and len(media) < 0.3 * len(data) + 400
        assert (W.decode(media).ravel() >> 8 & 255).astype(np.uint8).tobytes() == data and mode in (2, None)


def test_large_pictures_are_quick():
    import time

    p = smooth(600, 400, 5)
    data = W.encode(p)
    began = time.process_time()
    assert (W.decode(data) == p).all() and time.process_time() - began < 20


@pytest.mark.parametrize("bad", [b"", b"RIFF", b"GIF89a" + b"\0" * 40])
def test_other_files_are_refused(bad):
    with pytest.raises(ValueError):
        W.decode(bad)


def test_cut_streams_are_refused():
    whole = W.encode_grey(payload(bytes(range(97, 123)) * 40), 192)
    short = whole[:16] + (40).to_bytes(4, "little") + whole[20:60]
    with pytest.raises(ValueError):
        W.decode(short)


def test_other_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a", 5, "x", "y")], "doc_id long, text string, width int, pixels string, `odd:name, int` string")
    kept = df.select("doc_id", F.lit(None).cast("binary").alias("media"), "width", "pixels", "`odd:name, int`")
    got = load(kept)
    assert got.columns == ["doc_id", "media", "odd:name, int", "width", "height", "pixels", "feature"] and got.first()["odd:name, int"] == "y"


def test_high_pictures_are_several():
    data = (b"ab c" * 48) * (W.MOST_SIDE + 5)
    from tessera.llm.media import pictures

    assert samples(pictures(data))[0].tobytes() == data


def test_media_column(docs, texts, empty):
    got = {}
    for r in load(store(docs)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in texts:
        data = payload((t or "").encode())
        r = next(x for x in got[i] if bytes(x["pixels"]) == data)
        assert r["n_bytes"] == len((t or "").encode()) and r["width"] * r["height"] == len(data) and r["feature"].startswith("192x")
    assert sum(map(len, got.values())) == len(texts) and load(store(empty)).count() == 0
    null = docs.sparkSession.createDataFrame([(1, None)], "doc_id long, media binary")
    assert load(null).first()["pixels"] is None


def test_query(spark, docs, texts, tmp_path):
    from tessera.llm.queries import op1_webp_media

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op1_webp_media(spark, str(tmp_path)).collect()
    want = sorted((str(i), hashlib.sha256(payload((t or "").encode())).hexdigest(), zlib.crc32(payload((t or "").encode())[-16:])) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
