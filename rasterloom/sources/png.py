"""PNG files: all colour types, depths and interlacing in; lines by bands out.

Lines are unfiltered by whole lines where a line's own bytes are enough (running sums) or the line above is, and in diagonal waves where both are needed: a byte
waits for its left, upper and upper-left neighbours, so all bytes of one diagonal are ready at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..errors import CodecError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels and allowed depths of each colour type; where the seven passes of interlacing begin and their steps (x, y, step x, step y).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Pixels a file may have.
MOST_PIXELS = 1 << 30


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _chunks(data: bytes):
    """(kind, body) of a file's chunks up to its end."""
    at = len(SIGNATURE)
    while True:
        if at + 12 > len(data):
            raise CodecError("png: the file ends early")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise CodecError(f"png: damaged chunk {kind!r}")
        if kind == b"IEND":
            return
        yield kind, body
        at += 12 + size


def decode_png(data: bytes) -> np.ndarray:
    """A PNG file as (height, width, 4) bytes of straight alpha. Anything that isn't a whole PNG file raises CodecError."""
    if data[:8] != SIGNATURE:
        raise CodecError("not a png file")
    head = palette = alpha = None
    body = []
    for kind, part in _chunks(data):
        if head is None and kind != b"IHDR":
            raise CodecError("png: the header isn't first")
        if kind == b"IHDR":
            if len(part) != 13 or head is not None:
                raise CodecError("png: damaged header")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            if len(part) % 3 or not 1 <= len(part) // 3 <= 256:
                raise CodecError("png: damaged palette")
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body.append(part)
        elif not kind[0] & 32:
            raise CodecError(f"png: unknown chunk {kind!r}")
    if head is None:
        raise CodecError("png: no header")
    width, height, depth, color, packing, filtering, laced = head
    if color not in CHANNELS or depth not in DEPTHS[color] or packing or filtering or laced > 1 or not 0 < width * height <= MOST_PIXELS or max(width, height) >> 31:
        raise CodecError(f"png: {width}x{height}, depth {depth}, colour type {color}: not possible")
    if color == 3 and palette is None:
        raise CodecError("png: no palette")
    samples = np.zeros((height, width, CHANNELS[color]), np.uint16 if depth == 16 else np.uint8)
    passes = [p for p in (PASSES if laced else ((0, 0, 1, 1),)) if p[0] < width and p[1] < height]
    shapes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for x, y, dx, dy in passes]
    sizes = [h * (1 + _bytes(w, depth, color)) for h, w in shapes]
    raw, start = _inflate(b"".join(body), sum(sizes)), 0
    for (x, y, dx, dy), (h, w), size in zip(passes, shapes, sizes):
        lines = unfilter(raw[start : start + size].reshape(h, -1), max(1, depth * CHANNELS[color] // 8))
        samples[y::dy, x::dx] = _samples(lines, w, depth, color)
        start += size
    return _rgba(samples, depth, color, palette, alpha)


def _bytes(width: int, depth: int, color: int) -> int:
    return -(-width * depth * CHANNELS[color] // 8)


def _inflate(body: bytes, size: int) -> np.ndarray:
    """The bytes of all lines; what follows them is left out."""
    try:
        raw = zlib.decompressobj().decompress(body, size)
    except zlib.error as e:
        raise CodecError(f"png: damaged data: {e}") from e
    if len(raw) < size:
        raise CodecError("png: the data end early")
    return np.frombuffer(raw, np.uint8)


def _samples(lines: np.ndarray, width: int, depth: int, color: int) -> np.ndarray:
    n = CHANNELS[color]
    if depth == 16:
        return lines.view(">u2").reshape(len(lines), width, n)
    if depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, depth)
        lines = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return lines.reshape(len(lines), width, n)


def _rgba(samples: np.ndarray, depth: int, color: int, palette: np.ndarray | None, alpha: bytes | None) -> np.ndarray:
    height, width, n = samples.shape
    out = np.full((height, width, 4), 255, np.uint8)
    if color == 3:
        if samples.max() >= len(palette):
            raise CodecError("png: a colour beyond the palette")
        table = np.full((len(palette), 4), 255, np.uint8)
        table[:, :3] = palette
        if alpha is not None:
            if len(alpha) > len(palette):
                raise CodecError("png: more alphas than colours")
            table[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)
        return table[samples[..., 0]]
    if alpha is not None and color in (0, 2):  # one colour is transparent
        if len(alpha) != 2 * n:
            raise CodecError("png: damaged colour key")
        out[(samples == np.array(struct.unpack(f">{n}H", alpha)) % (1 << depth)).all(2), 3] = 0
    eight = ((samples.astype(np.uint32) + 128) // 257).astype(np.uint8) if depth == 16 else samples * np.uint8(255 // ((1 << depth) - 1))
    out[..., :3] = eight[..., :1] if n <= 2 else eight[..., :3]
    if n in (2, 4):
        out[..., 3] = eight[..., -1]
    return out


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of lines, each with its filter in front; `step`: bytes from a pixel to the next."""
    how = lines[:, 0]
    if how.max() > 4:
        raise CodecError(f"png: no filter {how.max()}")
    height, size = lines.shape[0], lines.shape[1] - 1
    whole = -(-size // step) * step
    out = np.zeros((height + 1, whole + step), np.uint8)  # a line of zeros above, a pixel of zeros to the left
    out[1:, step : step + size] = lines[:, 1:]
    y = 0
    while y < height:
        end = y + 1
        if how[y] > 2:
            while end < height and how[end] > 2:
                end += 1
            _waves(out[y : end + 1].reshape(end + 1 - y, -1, step), how[y:end])
        elif how[y] == 1:
            out[y + 1] = np.cumsum(out[y + 1].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif how[y] == 2:
            out[y + 1] += out[y]
        y = end
    return np.ascontiguousarray(out[1:, step : step + size])


def _waves(block: np.ndarray, how: np.ndarray) -> None:
    """Undoes the average (3) and Paeth (4) filters of lines in place; block: (1 + lines, 1 + pixels, step), the first line and pixel known."""
    n, wide = len(how), block.shape[1] - 1
    paeth = (how == 4)[:, None]
    down, right, _ = block.strides
    for t in range(n + wide - 1):
        first, last = max(0, t - wide + 1), min(n - 1, t)  # lines that this diagonal crosses
        rows = np.arange(first, last + 1)
        diagonal = lambda dy, dx: np.lib.stride_tricks.as_strided(block[1 + first - dy, 1 + t - first - dx :], (len(rows), block.shape[2]), (down - right, 1), writeable=True)  # noqa: E731, B023
        left, above, corner = (diagonal(*d).astype(np.int16) for d in ((0, 1), (1, 0), (1, 1)))
        by_left, by_above, by_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((by_left <= by_above) & (by_left <= by_corner), left, np.where(by_above <= by_corner, above, corner))
        now = diagonal(0, 0)
        now += np.where(paeth[first : last + 1], nearest, (left + above) >> 1).astype(np.uint8)


def filtered(rgba: np.ndarray) -> np.ndarray:
    """Lines of (height, width, 4) bytes, each with the filter in front that leaves the smallest numbers: by the left pixel, or by the line above (not for the first)."""
    height, width, n = rgba.shape
    flat = rgba.reshape(height, width * n)
    sub, up = flat.copy(), flat.copy()
    sub[:, n:] -= flat[:, :-n]
    up[1:] -= flat[:-1]
    cost = lambda v: np.abs(v.view(np.int8).astype(np.int32)).sum(1)
    use_up = cost(up) < cost(sub)
    use_up[0] = False
    return np.hstack([np.where(use_up, 2, 1).astype(np.uint8)[:, None], np.where(use_up[:, None], up, sub)])


def compressed_band(rgba: np.ndarray) -> tuple[bytes, int, int]:
    """Some lines as a piece of a deflate stream that needs nothing before it, the Adler-32 sum of its bytes and their number."""
    raw = filtered(rgba).tobytes()
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(raw) + z.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)


def joined_sums(first: int, second: int, size: int) -> int:
    """The Adler-32 sum of two runs of bytes, the second of `size` bytes, from theirs."""
    low, high = first & 0xFFFF, first >> 16
    a = (low + (second & 0xFFFF) - 1) % 65521
    b = (high + (second >> 16) + size * (low - 1)) % 65521
    return b << 16 | a


def file_of_bands(width: int, height: int, bands: list[tuple[bytes, int, int]]) -> bytes:
    """A PNG file of 8-bit RGBA from its bands, in order."""
    if not 0 < width < 1 << 31 or not 0 < height < 1 << 31:
        raise CodecError(f"png: an image of {width}x{height} isn't possible")
    total = 1
    for _, one, size in bands:
        total = joined_sums(total, one, size)
    parts = [b"\x78\x9c", *(b for b, _, _ in bands), b"\x03\x00" + struct.pack(">I", total)]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + b"".join(chunk(b"IDAT", p) for p in parts) + chunk(b"IEND", b"")


def encode_png(rgba: np.ndarray) -> bytes:
    """(height, width, 4) bytes to a PNG file, lossless with alpha."""
    height, width = rgba.shape[:2]
    if not width or not height:
        raise CodecError("png: an image needs at least one pixel")
    return file_of_bands(width, height, [compressed_band(rgba)])
