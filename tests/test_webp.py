"""Lossless WebP: round trips, and files with every feature written bit by bit."""

import random
import struct

import numpy as np
import pytest

from rasterloom.errors import CodecError
from rasterloom.sources.webp import NEAR, decode_webp, encode_webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def file(self):
        body = b"\x2f" + np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
        return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def flat_code(w, size, rng):
    """A code in which symbols have one of two neighbouring lengths; written with repeats. Returns symbol to (reversed code, length)."""
    n = size.bit_length() - 1
    longer = 2 * (size - (1 << n))
    lengths = [n + 1] * longer + [n] * (size - longer)
    rng.shuffle(lengths)
    w.put(0, 1)
    w.put(15, 4)
    own = dict.fromkeys(range(16), 5) | {16: 2, 17: 3, 18: 3}
    for s in ORDER:
        w.put(own[s], 3)
    code = canonical([own[s] for s in range(19)])
    w.put(0, 1)
    i, before = 0, 8
    while i < size:
        run = 1
        while i + run < size and lengths[i + run] == lengths[i] and run < 6:
            run += 1
        if run >= 3 and lengths[i] == before:
            w.put(*code[16])
            w.put(run - 3, 2)
            i += run
        else:
            w.put(*code[lengths[i]])
            before = lengths[i]
            i += 1
    return canonical(lengths)


def canonical(lengths):
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2), n
        code, last = code + 1, n
    return out


def prefixed(value):
    """Symbol, further bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    return 2 * top + (v >> top - 1 & 1), v & (1 << top - 1) - 1, top - 1


def image(w, pixels, width, main, rng, cache_bits=0, blocks=None):
    """Writes an entropy-coded image; pixels, copies near and far, and cached colours are drawn at random where they fit. blocks: (bits, groups)."""
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    height, groups, of = len(pixels) // width, 1, None
    if main:
        w.put(blocks is not None, 1)
        if blocks:
            w.put(blocks[0] - 2, 3)
            across, down, groups = -(-width // (1 << blocks[0])), -(-height // (1 << blocks[0])), blocks[1]
            of = [rng.randrange(groups) for _ in range(across * down)]
            of[0] = groups - 1
            image(w, [g << 8 for g in of], across, False, rng)
    codes = [[flat_code(w, size, rng) for size in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    cache, i = {}, 0
    slot = lambda p: (p * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - cache_bits
    while i < len(pixels):
        y, x = divmod(i, width)
        green, red, blue, alpha, far = codes[of[(y >> blocks[0]) * -(-width // (1 << blocks[0])) + (x >> blocks[0])] if of else 0]
        fits = []
        for _ in range(6):
            back = rng.randrange(1, i + 1) if i else 0
            n = 0
            while back and i + n < len(pixels) and pixels[i + n] == pixels[i + n - back] and n < 300:
                n += 1
            if n:
                fits.append((n, back))
        if fits and rng.random() < 0.7:
            n, back = max(fits)
            near = [k + 1 for k, (dx, dy) in enumerate(NEAR) if max(1, dx + dy * width) == back]
            s, more, bits = prefixed(n)
            w.put(*green[256 + s])
            w.put(more, bits)
            s, more, bits = prefixed(rng.choice(near) if near else back + 120)
            w.put(*far[s])
            w.put(more, bits)
        elif cache_bits and cache.get(slot(pixels[i])) == pixels[i]:
            n = 1
            w.put(*green[280 + slot(pixels[i])])
        else:
            n, p = 1, pixels[i]
            w.put(*green[p >> 8 & 255])
            w.put(*red[p >> 16 & 255])
            w.put(*blue[p & 255])
            w.put(*alpha[p >> 24])
        for p in pixels[i : i + n]:
            if cache_bits:
                cache[slot(p)] = p
        i += n


def head(w, width, height):
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def few(rng, n, colours=9):
    table = [rng.randrange(1 << 32) for _ in range(colours)]
    return [rng.choice(table) for _ in range(n)]


def rgba(pixels, width):
    return np.array([[p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24] for p in pixels], np.uint8).reshape(-1, width, 4)


@pytest.mark.parametrize("seed", range(8))
def test_copies_caches_and_groups(seed):
    rng = random.Random(seed)
    width, height = rng.choice([(1, 9), (7, 5), (13, 11), (30, 20)])
    pixels, w = few(rng, width * height), Writer()
    head(w, width, height)
    w.put(0, 1)
    image(w, pixels, width, True, rng, rng.choice([0, 1, 4, 11]), rng.choice([None, (2, 3), (3, 2)]))
    assert (decode_webp(w.file()) == rgba(pixels, width)).all()


def mean(a, b):
    return [(x + y) // 2 for x, y in zip(a, b)]


def expected(mode, left, up, corner, right):
    """One pixel, by the letter of the format."""
    clamp = lambda v: min(255, max(0, v))
    if mode == 11:
        guess = [x + y - c for x, y, c in zip(left, up, corner)]
        return left if sum(abs(g - x) for g, x in zip(guess, left)) < sum(abs(g - y) for g, y in zip(guess, up)) else up
    if mode == 12:
        return [clamp(x + y - c) for x, y, c in zip(left, up, corner)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(mean(left, up), corner)]
    return [[255, 0, 0, 0], left, up, right, corner, mean(mean(left, right), up), mean(left, corner), mean(left, up), mean(corner, up), mean(up, right), mean(mean(left, corner), mean(up, right))][mode]


@pytest.mark.parametrize("seed", range(6))
def test_transforms(seed):
    """A predictor with all modes, crossed colours and subtracted green, in any order, undone pixel by pixel."""
    rng = random.Random(seed)
    width, height, bits = rng.choice([(2, 30), (21, 17), (9, 40)]) + (2,)
    across, down = -(-width // 4), -(-height // 4)
    modes, crossed = [rng.randrange(14) for _ in range(across * down)], [rng.randrange(1 << 24) | 255 << 24 for _ in range(across * down)]
    pixels, w = [rng.randrange(1 << 32) for _ in range(width * height)], Writer()
    head(w, width, height)
    order = [0, 1, 2]
    rng.shuffle(order)
    for kind in order:
        w.put(1, 1)
        w.put(kind, 2)
        if kind != 2:
            w.put(bits - 2, 3)
            image(w, [m << 8 for m in modes] if kind == 0 else crossed, across, False, rng)
    w.put(0, 1)
    image(w, pixels, width, True, rng)
    now = [[p >> s & 255 for s in (24, 16, 8, 0)] for p in pixels]
    signed = lambda v: (v & 255) - 256 if v & 128 else v & 255
    for kind in reversed(order):
        for i, (a, r, g, b) in enumerate(list(now)):
            y, x = divmod(i, width)
            block = (y // 4) * across + x // 4
            if kind == 2:
                now[i] = [a, r + g & 255, g, b + g & 255]
            elif kind == 1:
                to_blue, green_blue, green_red = (signed(crossed[block] >> s) for s in (16, 8, 0))
                r = r + (green_red * signed(g) >> 5) & 255
                now[i] = [a, r, g, b + (green_blue * signed(g) >> 5) + (to_blue * signed(r) >> 5) & 255]
            else:
                mode = 0 if i == 0 else 1 if y == 0 else 2 if x == 0 else modes[block]
                around = [now[max(0, i - d)] for d in (1, width, width + 1, width - 1)]
                now[i] = [p + q & 255 for p, q in zip([a, r, g, b], expected(mode, *around))]
    assert (decode_webp(w.file()) == np.array(now, np.uint8)[:, [1, 2, 3, 0]].reshape(height, width, 4)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(n):
    rng, w = random.Random(n), Writer()
    width, height = 19, 7
    table = [rng.randrange(1 << 32) for _ in range(n)]
    packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    index = [rng.randrange(n) for _ in range(width * height)]
    head(w, width, height)
    w.put(1, 1)
    w.put(3, 2)
    w.put(n - 1, 8)
    parts = lambda p: [p >> s & 255 for s in (24, 16, 8, 0)]
    deltas = [[a - b & 255 for a, b in zip(parts(p), parts(q))] for p, q in zip(table, [0, *table])]
    image(w, [a << 24 | r << 16 | g << 8 | b for a, r, g, b in deltas], n, False, rng)
    w.put(0, 1)
    per, bits = 1 << packed, 8 >> packed
    rows = [[sum(v << bits * k for k, v in enumerate(index[y * width + x : min(y * width + x + per, (y + 1) * width)])) << 8 for x in range(0, width, per)] for y in range(height)]
    image(w, [p for r in rows for p in r], len(rows[0]), True, rng)
    assert (decode_webp(w.file()) == rgba([table[i] for i in index], width)).all()


def test_round_trips():
    rng = np.random.default_rng(1)
    for width, height in ((1, 1), (5, 3), (40, 30), (600, 20), (3, 700)):
        y, x = np.mgrid[:height, :width]
        ramp = np.dstack([x, y, x + y, np.full_like(x, 255)]).astype(np.uint8)
        for rgba in (rng.integers(0, 256, (height, width, 4)).astype(np.uint8), np.full((height, width, 4), 7, np.uint8), ramp, np.repeat(ramp[:, ::-1][:, : max(1, width // 9)], 9, axis=1)[:, :width]):
            if rgba.shape[1]:
                assert (decode_webp(encode_webp(rgba)) == rgba).all()
    assert len(encode_webp(np.full((300, 300, 4), 9, np.uint8))) < 700


def test_damaged_files():
    whole = encode_webp(np.random.default_rng(2).integers(0, 90, (20, 20, 4)).astype(np.uint8))
    for data in (b"", b"RIFF", whole[:30], whole[:-9], whole.replace(b"VP8L", b"VP8 "), whole.replace(b"WEBP", b"WAVE"), whole.replace(b"\x2f", b"\x2e", 1)):
        with pytest.raises(CodecError):
            decode_webp(data)
    rng = random.Random(3)
    for _ in range(150):
        cut = bytearray(whole)
        for _ in range(3):
            cut[rng.randrange(26, len(cut))] = rng.randrange(256)
        try:
            assert decode_webp(bytes(cut)).shape == (20, 20, 4)
        except CodecError:
            pass
    with pytest.raises(CodecError):
        encode_webp(np.zeros((0, 3, 4), np.uint8))
    with pytest.raises(CodecError):
        encode_webp(np.zeros((1, (1 << 14) + 1, 4), np.uint8))
