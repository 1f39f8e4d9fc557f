"""Matrices as files: type, rows and columns, then the elements; all with the high byte first."""

from __future__ import annotations

import struct

import numpy as np

#: Element kinds by depth (the type without its channels).
KINDS = {0: "u1", 1: "i1", 2: ">u2", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def encode(m: np.ndarray, depth: int = 5) -> bytes:
    """A matrix of two dimensions, or three with up to 4 channels."""
    if m.ndim not in (2, 3) or (channels := m.shape[2] if m.ndim == 3 else 1) > 4:
        raise ValueError("a matrix has two dimensions and at most 4 channels")
    return struct.pack(">iii", depth + 8 * (channels - 1), *m.shape[:2]) + m.astype(KINDS[depth]).tobytes()


def decode(data: bytes) -> np.ndarray:
    kind, rows, cols = struct.unpack_from(">iii", data)
    channels = kind // 8 + 1
    m = np.frombuffer(data, KINDS[kind % 8], rows * cols * channels, 12)
    return m.reshape((rows, cols, channels) if channels > 1 else (rows, cols)).astype(m.dtype.newbyteorder("="))
