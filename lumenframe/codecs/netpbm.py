"""Binary PPM (P6, 255 levels)."""

from __future__ import annotations

import re

import numpy as np

_HEAD = re.compile(rb"P6\s+(\d+)\s+(\d+)\s+(\d+)\s")


def read_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bands)."""
    m = _HEAD.match(data)
    if not m or int(m[3]) != 255:
        raise ValueError("not a binary PPM of 255 levels")
    return int(m[1]), int(m[2]), 3


def decode(data: bytes) -> np.ndarray:
    w, h, b = read_header(data)
    start = _HEAD.match(data).end()
    return np.frombuffer(data, np.uint8, w * h * b, start).reshape(h, w, b)


def encode(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    return b"P6\r%d %d\r255\r" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()
