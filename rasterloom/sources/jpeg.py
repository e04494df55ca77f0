"""Baseline JPEG files, encoded by bands of eight lines.

A restart interval is one row of blocks, so each band is coded without knowing the others, and a file is its header and its bands. Blocks are transformed and
coded many at a time; code tables come from a rule for how likely a symbol is.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

from ..errors import CodecError

#: Lines of a band.
BAND = 8
#: Largest side: the format has 16 bits for it.
MOST = 65535
#: The quantisation tables of the standard's annex K for luminance and chrominance, line by line.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *(99,) * 32,
)


@lru_cache
def zigzag() -> np.ndarray:
    """Places of an 8 x 8 block by diagonals, of which every other runs upwards."""
    return np.array(sorted(range(64), key=lambda p: (sum(divmod(p, 8)), p // 8 if sum(divmod(p, 8)) % 2 else p % 8)))


@lru_cache
def cosines() -> np.ndarray:
    k, x = np.mgrid[:8, :8]
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


def quantisers(quality: int) -> np.ndarray:
    """Both tables at a quality from 1 to 100: 50 as they are, less beyond, more before."""
    quality = min(max(int(quality), 1), 100)
    share = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array([LUMINANCE, CHROMINANCE]) * share + 50) // 100, 1, 255)


def code_lengths(weights: list[float], longest: int = 16) -> list[int]:
    """Lengths of a prefix code for symbols of these weights, `longest` bits at most; no code is all ones."""
    heap = [(w, i, (i,)) for i, w in enumerate([*weights, 0.0])]  # the last takes the code of ones
    lengths = [0] * (len(weights) + 1)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, left), (b, k, right) = heapq.heappop(heap), heapq.heappop(heap)
        for i in left + right:
            lengths[i] += 1
        heapq.heappush(heap, (a + b, k, left + right))
    if max(lengths) > longest:
        return code_lengths([w + 1e-4 * sum(weights) for w in weights], longest)  # flatter
    return lengths[:-1]


@lru_cache
def codes(kind: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table of a file, and code and length by symbol. `dc`: sizes of differences; `ac`: zeros before a value times 16, and its size."""
    if kind == "dc":
        weights = {s: 2.0 ** -abs(s - 2) for s in range(12)}
    else:
        weights = {16 * r + s: np.exp(-0.45 * r - 0.9 * (s - 1)) for r in range(16) for s in range(1, 11)} | {0: 1.5, 0xF0: 0.004}
    symbols = sorted(weights, key=lambda s: (-weights[s], s))
    lengths = dict(zip(symbols, code_lengths([weights[s] for s in symbols])))
    ordered = sorted(symbols, key=lambda s: (lengths[s], s))
    code, length, now, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in ordered:
        now <<= lengths[s] - last
        code[s], length[s], last = now, lengths[s], lengths[s]
        now += 1
    return bytes(sum(lengths[s] == n for s in symbols) for n in range(1, 17)) + bytes(ordered), code, length


def over_white(rgba: np.ndarray) -> np.ndarray:
    """Colours of straight alpha over white, in whole numbers and gamma space."""
    a = rgba[..., 3:].astype(np.int32)
    return (rgba[..., :3] * a + 255 * (255 - a)) // 255


def coefficients(rgb: np.ndarray, quality: int) -> np.ndarray:
    """(blocks, 3, 64) quantised coefficients in zigzag order of some lines (at most BAND), luminance and both chrominances; edges are repeated to whole blocks."""
    rgb = np.pad(rgb, ((0, BAND - rgb.shape[0]), (0, -rgb.shape[1] % 8), (0, 0)), mode="edge").astype(float)
    r, g, b = (rgb[..., c] for c in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402])  # chrominances are centred already
    blocks = planes.reshape(3, 8, -1, 8).transpose(2, 0, 1, 3)
    turned = cosines() @ blocks @ cosines().T
    tables = quantisers(quality)[[0, 1, 1]].reshape(3, 8, 8)
    return np.rint(turned / tables).astype(np.int64).reshape(-1, 3, 64)[..., zigzag()]


def coded_band(rgba: np.ndarray, quality: int) -> bytes:
    """The entropy-coded bytes of some lines (at most BAND)."""
    c = coefficients(over_white(rgba), quality)
    n = len(c)
    c[..., 0] = np.diff(c[..., 0], axis=0, prepend=0)  # luminance and chrominances follow those of the block before
    flat = c.reshape(n * 3, 64)
    size = lambda v: np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)
    extra = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v)
    _, dc_code, dc_length = codes("dc")
    _, ac_code, ac_length = codes("ac")
    row, at = np.nonzero(flat[:, 1:])
    value = np.clip(flat[:, 1:][row, at], -1023, 1023)
    before = np.where(np.diff(row, prepend=-1) != 0, -1, np.concatenate([[-1], at[:-1]]))
    zeros = at - before - 1
    order, code, length = [], [], []

    def put(key, values, lengths) -> None:
        order.append(key)
        code.append(values)
        length.append(lengths)

    s = size(flat[:, 0])
    put(np.arange(3 * n) * 256, dc_code[s] << s | extra(flat[:, 0], s), dc_length[s] + s)
    for more in (1, 2, 3):  # sixteen zeros at a time
        far = zeros >= 16 * more
        put(row[far] * 256 + (at[far] + 1) * 4 - 4 + more, np.full(far.sum(), ac_code[0xF0]), np.full(far.sum(), ac_length[0xF0]))
    s = size(value)
    symbol = (zeros % 16) * 16 + s
    put(row * 256 + (at + 1) * 4, ac_code[symbol] << s | extra(value, s), ac_length[symbol] + s)
    open_ = np.flatnonzero(flat[:, 63] == 0)
    put(open_ * 256 + 255, np.full(len(open_), ac_code[0]), np.full(len(open_), ac_length[0]))
    key = np.argsort(np.concatenate(order), kind="stable")
    code_, length_ = np.concatenate(code)[key], np.concatenate(length)[key]
    ends = np.cumsum(length_)
    place = np.arange(ends[-1]) - np.repeat(ends - length_, length_)
    bits = (np.repeat(code_, length_) >> (np.repeat(length_, length_) - 1 - place)) & 1
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)]).astype(np.uint8)
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def file_of_bands(width: int, height: int, bands: list[bytes], quality: int) -> bytes:
    """A JPEG file from its bands, in order."""
    if not 0 < width <= MOST or not 0 < height <= MOST:
        raise CodecError(f"jpeg: {width}x{height}: width and height are from 1 to {MOST}")
    part = lambda marker, body: struct.pack(">BBH", 255, marker, len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for i, table in enumerate(quantisers(quality)):
        out += part(0xDB, bytes([i]) + bytes(table[zigzag()].tolist()))
    out += part(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([k + 1, 0x11, k > 0]) for k in range(3)))
    out += part(0xC4, b"\0" + codes("dc")[0]) + part(0xC4, b"\x10" + codes("ac")[0])
    out += part(0xDD, struct.pack(">H", -(-width // 8))) + part(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0")
    return out + b"".join(b + (bytes([255, 0xD0 + k % 8]) if k + 1 < len(bands) else b"") for k, b in enumerate(bands)) + b"\xff\xd9"


def encode_jpeg(rgba: np.ndarray, quality: int = 90) -> bytes:
    """(height, width, 4) bytes to a JPEG file; translucent pixels are laid over white."""
    height, width = rgba.shape[:2]
    if not width or not height:
        raise CodecError("jpeg: an image needs at least one pixel")
    return file_of_bands(width, height, [coded_band(rgba[y : y + BAND], quality) for y in range(0, height, BAND)], quality)
