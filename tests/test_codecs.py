"""PNG and JPEG files against brute force."""

import random
import struct
import zlib

import numpy as np
import pytest

from rasterloom.errors import CodecError
from rasterloom.sources import jpeg, png
from rasterloom.sources.jpeg import encode_jpeg
from rasterloom.sources.png import CHANNELS, DEPTHS, PASSES, SIGNATURE, chunk, compressed_band, decode_png, encode_png, file_of_bands, joined_sums


def noise(width, height, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    base = np.dstack([x * 5, y * 7, x + y, 255 - x]) + rng.integers(0, 9, (height, width, 4))
    return (base % 256).astype(np.uint8)


def paeth(a, b, c):
    p = a + b - c
    return min((a, b, c), key=lambda v: abs(p - v))


def pack(values, depth):
    """Samples of one line as bytes, the first in the highest bits."""
    if depth == 16:
        return b"".join(struct.pack(">H", v) for v in values)
    bits = "".join(f"{v:0{depth}b}" for v in values)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def write(samples, depth, color, laced=False, palette=None, alpha=None, how=None, seed=1):
    """A PNG file of (height, width, channels) samples, filters drawn at random, by the letter of the standard."""
    rng, raw = random.Random(seed), b""
    height, width, n = samples.shape
    for x0, y0, dx, dy in PASSES if laced else ((0, 0, 1, 1),):
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        step, above = max(1, depth * n // 8), None
        for line in part:
            now = pack(line.ravel().tolist(), depth)
            above = above or bytes(len(now))
            f = rng.randrange(5) if how is None else how
            left = lambda v, i: v[i - step] if i >= step else 0  # noqa: E731, B023
            guess = {0: lambda i: 0, 1: lambda i: left(now, i), 2: lambda i: above[i], 3: lambda i: (left(now, i) + above[i]) // 2, 4: lambda i: paeth(left(now, i), above[i], left(above, i))}[f]  # noqa: B023
            raw += bytes([f]) + bytes((now[i] - guess(i)) & 255 for i in range(len(now)))
            above = now
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, laced)) + chunk(b"tEXt", b"a\0b")
    out += chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    out += chunk(b"tRNS", alpha) if alpha is not None else b""
    z = zlib.compress(raw)
    return out + chunk(b"IDAT", z[:9]) + chunk(b"IDAT", z[9:]) + chunk(b"IEND", b"")


def wanted(samples, depth, color, palette, alpha):
    """Pixel by pixel."""
    height, width, n = samples.shape
    out = np.zeros((height, width, 4), np.uint8)
    key = struct.unpack(f">{n}H", alpha) if alpha is not None and color in (0, 2) else None
    for y in range(height):
        for x in range(width):
            s = [int(v) for v in samples[y, x]]
            eight = [round(v * 255 / (2**depth - 1)) for v in s]
            if color == 3:
                out[y, x] = (*palette[s[0]], alpha[s[0]] if alpha is not None and s[0] < len(alpha) else 255)
            else:
                rgb = [eight[0]] * 3 if n <= 2 else eight[:3]
                out[y, x] = (*rgb, eight[-1] if n in (2, 4) else 0 if key and tuple(s) == key else 255)
    return out


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize(("color", "depth"), [(c, d) for c in CHANNELS for d in DEPTHS[c]])
def test_every_kind_of_png(color, depth, laced):
    rng = np.random.default_rng(depth + 16 * color)
    for width, height in ((1, 1), (3, 5), (9, 8), (21, 13)):
        palette = rng.integers(0, 256, (2**depth, 3)).astype(np.uint8) if color == 3 else None
        samples = rng.integers(0, 2**depth, (height, width, CHANNELS[color])).astype(np.uint16 if depth == 16 else np.uint8)
        key = struct.pack(f">{CHANNELS[color]}H", *map(int, samples[0, 0])) if color in (0, 2) else bytes([7, 200]) if color == 3 else None
        for alpha in {None, key}:
            data = write(samples, depth, color, laced, palette, alpha)
            assert (decode_png(data) == wanted(samples, depth, color, palette, alpha)).all()


@pytest.mark.parametrize("how", range(5))
def test_each_filter_alone(how):
    samples = np.random.default_rng(how).integers(0, 256, (17, 11, 3)).astype(np.uint8)
    assert (decode_png(write(samples, 8, 2, how=how))[..., :3] == samples).all()


def test_damaged_png():
    rgba = noise(12, 9)
    whole = encode_png(rgba)
    paletted = write(np.full((2, 2, 1), 3, np.uint8), 8, 3, palette=np.zeros((2, 3), np.uint8))
    bad = [b"", SIGNATURE, b"GIF89a", whole[:20], whole[:-4], whole[:40] + b"\0" + whole[41:], whole.replace(b"IHDR", b"IHDX"), paletted, write(np.zeros((2, 2, 1), np.uint8), 8, 3)]
    bad += [SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *h)) + chunk(b"IDAT", zlib.compress(bytes(100))) + chunk(b"IEND", b"") for h in ((0, 5, 8, 6, 0, 0, 0), (2, 2, 3, 6, 0, 0, 0), (2, 2, 8, 5, 0, 0, 0), (2, 2, 8, 6, 1, 0, 0), (900, 900, 8, 6, 0, 0, 0), (2**31, 1, 8, 6, 0, 0, 0))]
    bad += [SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes([9, 1, 2, 3, 4]))) + chunk(b"IEND", b"")]
    for data in bad:
        with pytest.raises(CodecError):
            decode_png(data)
    rng = random.Random(4)
    for _ in range(300):  # whatever is changed: a whole image or a CodecError
        cut = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            cut[rng.randrange(len(cut))] = rng.randrange(256)
        try:
            assert decode_png(bytes(cut[: rng.randrange(1, len(cut) + 1)])).shape[2] == 4
        except CodecError:
            pass


def test_png_by_bands():
    rgba = noise(37, 50)
    for lines in (1, 7, 50, 64):
        data = file_of_bands(37, 50, [compressed_band(rgba[y : y + lines]) for y in range(0, 50, lines)])
        assert (decode_png(data) == rgba).all()
        at, body = 8, b""
        while at < len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            body += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
            at += size + 12
        assert len(zlib.decompress(body)) == 50 * (1 + 4 * 37)  # the sum of all bands is checked here
    a, b = bytes(range(200)) * 50, b"xyz" * 4000
    assert joined_sums(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    assert (decode_png(encode_png(rgba)) == rgba).all() and len(encode_png(np.full((300, 300, 4), 9, np.uint8))) < 3000


def jvm_decoded(spark, data):
    """(height, width, 3) bytes by the JVM's decoder."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    w, h = image.getWidth(), image.getHeight()
    flat = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64)
    return np.stack([flat >> s & 255 for s in (16, 8, 0)], -1).reshape(h, w, 3).astype(np.uint8)


def smooth(width, height):
    y, x = np.mgrid[:height, :width]
    return np.dstack([128 + 100 * np.sin(x / 9), 128 + 100 * np.cos(y / 7), 128 + 60 * np.sin((x + y) / 11), np.full_like(x, 255)]).astype(np.uint8)


def test_jpeg(spark):
    for width, height in ((1, 1), (8, 8), (31, 17), (70, 90)):
        rgba = smooth(width, height)
        errors = [np.abs(jvm_decoded(spark, encode_jpeg(rgba, q)).astype(int) - rgba[..., :3]).mean() for q in (20, 60, 95, 100)]
        assert errors[3] <= 1.0 and errors[2] < 2.5 and errors[1] < 8 and errors[0] < 16
        sizes = [len(encode_jpeg(rgba, q)) for q in (20, 60, 95)]
        assert sizes == sorted(sizes)
    rgba = noise(64, 64, 3)  # restless: long codes, many values
    assert np.abs(jvm_decoded(spark, encode_jpeg(rgba, 100)).astype(int) - jpeg.over_white(rgba)).mean() < 1.5
    clear = np.zeros((9, 9, 4), np.uint8)
    assert (jvm_decoded(spark, encode_jpeg(clear, 90)) == 255).all()
    checker = np.where((np.indices((64, 64)).sum(0) % 2)[..., None], [255, 255, 255, 255], [0, 0, 0, 255]).astype(np.uint8)
    assert np.abs(jvm_decoded(spark, encode_jpeg(checker, 100)).astype(int) - checker[..., :3]).max() <= 3


def test_jpeg_limits():
    with pytest.raises(CodecError):
        jpeg.file_of_bands(65536, 1, [b""], 90)
    with pytest.raises(CodecError):
        encode_jpeg(np.zeros((0, 4, 4), np.uint8))
    for kind in ("dc", "ac"):
        table, code, length = jpeg.codes(kind)
        used = [s for s in range(256) if length[s]]
        assert len(table) == 16 + len(used) and max(length) <= 16
        words = sorted(f"{code[s]:0{length[s]}b}" for s in used)
        assert not any(b.startswith(a) for a, b in zip(words, words[1:])) and "1" * max(length) not in words
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag()) == list(range(64))
    assert png.PASSES[0] == (0, 0, 8, 8)
