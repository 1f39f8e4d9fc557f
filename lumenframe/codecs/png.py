"""PNG of 8 bits: gray, gray with alpha, RGB, RGBA and palettes; alpha is dropped and pixels are RGB. Interlaced files are refused."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes):
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a damaged PNG")
        yield kind, body
        at += 12 + n


def read_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bands), always three bands."""
    kind, body = next(chunks(data))
    if kind != b"IHDR":
        raise ValueError("a PNG without a header")
    return (*struct.unpack_from(">II", body), 3)


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Pixels of lines of any filters. A pixel needs those to its left, above and above left, so all on one antidiagonal are made at once."""
    h, w, c = lines.shape
    out = np.zeros((h + 1, w + 1, c), np.int16)
    for s in range(h + w - 1):
        y = np.arange(max(0, s - w + 1), min(h, s + 1))
        x = s - y
        a, b, d = out[y + 1, x], out[y, x + 1], out[y, x]
        pa, pb, pd = abs(b - d), abs(a - d), abs(a + b - 2 * d)
        paeth = np.where((pa <= pb) & (pa <= pd), a, np.where(pb <= pd, b, d))
        kind = kinds[y, None]
        guess = np.select([kind == 0, kind == 1, kind == 2, kind == 3], [np.zeros_like(a), a, b, (a + b) // 2], paeth)
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, w * c)


def decode(data: bytes) -> np.ndarray:
    found: dict[bytes, bytes] = {}
    for kind, body in chunks(data):
        found[kind] = found.get(kind, b"") + body
    w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if depth != 8 or interlaced or color not in _CHANNELS:
        raise ValueError("an unsupported kind of PNG")
    c = _CHANNELS[color]
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above, diagonal = np.zeros(w * c, np.uint8), False
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(w, c), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = line + above
        else:
            diagonal = True
            break
        above = out[y]
    if diagonal:
        out = _unfiltered(rows[:, 0], rows[:, 1:].reshape(h, w, c))
    pixels = out.reshape(h, w, c)
    if color == 3:
        return np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if c < 3 else pixels[:, :, :3]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = pixels.reshape(h, 3 * w)
    return _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + _chunk(b"IEND", b"")
