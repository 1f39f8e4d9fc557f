"""JPEG of 8 bits: headers, pixels of baseline and progressive files by Huffman coding, and a baseline encoder."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in ((s - i if s % 2 == 0 else i, i if s % 2 == 0 else s - i) for i in range(s + 1)) if y < 8 and x < 8])
_k = np.arange(8)
#: Rows are the cosines of one frequency; D @ block @ D.T transforms, D.T @ block @ D turns back.
DCT = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)
#: Quality at which ``encode`` writes, from 0 to 1.
QUALITY = 0.95


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start of its body, end) of all segments; a scan's entropy-coded bytes follow its body and are passed over."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a damaged JPEG")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return
        if kind == 1 or 0xD0 <= kind <= 0xD7:
            at += 2
            continue
        end = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
        yield kind, at + 4, end
        at = end
        if kind == 0xDA:
            while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return


def read_header(data: bytes) -> tuple[int, int, int] | None:
    """(width, height, bands) from the first frame of 8 bits, always three bands; None where there is none."""
    try:
        for kind, at, _ in segments(data):
            if kind in (0xC0, 0xC2):
                depth, h, w = struct.unpack_from(">BHH", data, at)
                return (w, h, 3) if depth == 8 else None
    except (ValueError, struct.error):
        pass
    return None


class _Bits:
    """Bits of a stretch of entropy-coded bytes."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(8), np.uint8).astype(np.int64)
        self.window, self.at, self.end = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]).tolist(), 0, 8 * (len(b) - 8)

    def peek(self) -> int:
        """The next 16 bits; beyond the end they are 0."""
        i = self.at >> 3
        if i >= len(self.window):
            raise ValueError("a JPEG that ends too soon")
        return (self.window[i] >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek() >> (16 - n)
        self.at += n
        return v

    def symbol(self, table: list[int]) -> int:
        found = table[self.peek()]
        if not found:
            raise ValueError("a JPEG with an unknown code")
        self.at += found >> 8
        return found & 255

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _table(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the length of the code that they begin with, times 256, plus its symbol; bits that begin alike share one number."""
    found, k = [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            found += [length << 8 | symbols[k]] * min(1 << (16 - length), (1 << 16) - len(found))
            k += 1
    return found + [0] * ((1 << 16) - len(found))


class _Scan:
    """The coefficients that one scan adds, block by block."""

    def __init__(self, bits: _Bits, first: int, last: int, high: int, low: int, progressive: bool):
        self.bits, self.first, self.last, self.high, self.low, self.progressive, self.run = bits, first, last, high, low, progressive, 0

    def block(self, out: list[int], dc: list[int], ac: list[int], before: int) -> int:
        """Fills ``out`` (64 coefficients, in zigzag order) and gives the block's mean, which the next one is told against."""
        bits, k = self.bits, self.first
        if self.progressive and self.high:
            return self._refine(out, ac)
        if not k:
            if dc is None:
                raise ValueError("a JPEG without a table")
            before += bits.signed(bits.symbol(dc))
            out[0], k = before << self.low, 1
        if self.run:
            self.run -= 1
            return before
        while k <= self.last:
            s = bits.symbol(ac)
            n, size = s >> 4, s & 15
            if size:
                k += n
                if k > 63:
                    raise ValueError("a JPEG with too long a run")
                out[k] = bits.signed(size) << self.low
                k += 1
            elif n == 15:
                k += 16
            else:
                if self.progressive:
                    self.run = (1 << n) + bits.take(n) - 1
                break
        return before

    def _refine(self, out: list[int], ac: list[int]) -> int:
        bits, k, one = self.bits, self.first, 1 << self.low
        if not k:
            out[0] |= bits.take(1) << self.low
            return 0

        def more(k: int) -> None:
            if bits.take(1) and not abs(out[k]) & one:
                out[k] += one if out[k] > 0 else -one

        if not self.run:
            while k <= self.last:
                s = bits.symbol(ac)
                n, size = s >> 4, s & 15
                value = 0
                if size:
                    value = one if bits.take(1) else -one
                elif n < 15:
                    self.run = (1 << n) + bits.take(n)
                    break
                while k <= self.last:
                    if out[k]:
                        more(k)
                    elif not n:
                        break
                    else:
                        n -= 1
                    k += 1
                if value and k <= 63:
                    out[k] = value
                k += 1
        if self.run:
            while k <= self.last:
                if out[k]:
                    more(k)
                k += 1
            self.run -= 1
        return 0


def _planes(data: bytes) -> tuple[list[np.ndarray], int, int, int | None]:
    """Each component at full size (0 to 255, as floats), width, height, and the transform that an Adobe segment names."""
    quant, huffman, parts, restart, adobe, found, progressive, width, height = {}, {}, {}, 0, None, False, False, 0, 0
    for kind, at, end in segments(data):
        if kind == 0xDB:
            while at < end:
                wide, k = data[at] >> 4, data[at] & 15
                quant[k] = np.frombuffer(data, ">u2" if wide else "u1", 64, at + 1).astype(np.float64)
                at += 129 if wide else 65
        elif kind == 0xC4:
            while at < end:
                n = sum(data[at + 1 : at + 17])
                huffman[data[at]] = _table(data[at + 1 : at + 17], data[at + 17 : at + 17 + n])
                at += 17 + n
        elif kind == 0xDD:
            restart = struct.unpack_from(">H", data, at)[0]
        elif kind == 0xEE and data[at : at + 5] == b"Adobe":
            adobe = data[at + 11]
        elif kind in (0xC0, 0xC1, 0xC2):
            depth, height, width, n = struct.unpack_from(">BHHB", data, at)
            if depth != 8 or not width or not height:
                raise ValueError("an unsupported kind of JPEG")
            progressive = kind == 0xC2
            for i in range(n):
                c, hv, q = data[at + 6 + 3 * i : at + 9 + 3 * i]
                parts[c] = {"h": hv >> 4, "v": hv & 15, "q": q}
            most_h, most_v = max(p["h"] for p in parts.values()), max(p["v"] for p in parts.values())
            across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for p in parts.values():
                p["wide"], p["high"] = across * p["h"], down * p["v"]
                p["own"] = -(-(-(-width * p["h"] // most_h)) // 8), -(-(-(-height * p["v"] // most_v)) // 8)
                p["c"] = [[0] * 64 for _ in range(p["wide"] * p["high"])]
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("an unsupported kind of JPEG")
        elif kind == 0xDA:
            n = data[at]
            asked = [(parts[data[at + 1 + 2 * i]], data[at + 2 + 2 * i]) for i in range(n)]
            first, last, approx = data[at + 1 + 2 * n : at + 4 + 2 * n]
            found = True
            stop = end
            while (stop := data.find(b"\xff", stop)) >= 0 and stop + 1 < len(data) and (data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7):
                stop += 2
            coded = data[end : stop if stop >= 0 else len(data)]
            if n == 1:
                p = asked[0][0]
                units = [[(0, y * p["wide"] + x)] for y in range(p["own"][1]) for x in range(p["own"][0])]
            else:
                units = [[(i, (y * p["v"] + v) * p["wide"] + x * p["h"] + h) for i, (p, _) in enumerate(asked) for v in range(p["v"]) for h in range(p["h"])] for y in range(down) for x in range(across)]
            pieces = _restarts(coded) if restart else [coded]
            step = restart or len(units)
            for piece, begin in zip(pieces, range(0, len(units), step)):
                scan = _Scan(_Bits(piece), first, last if progressive else 63, approx >> 4, approx & 15, progressive)
                before = [0] * n
                for unit in units[begin : begin + step]:
                    for i, b in unit:
                        p, t = asked[i]
                        before[i] = scan.block(p["c"][b], huffman.get(t >> 4), huffman.get(16 | t & 15), before[i])
    if not parts or not found:
        raise ValueError("a JPEG without an image")
    planes = []
    for p in parts.values():
        block = np.zeros((len(p["c"]), 64))
        block[:, ZIGZAG] = np.array(p["c"], np.float64) * quant[p["q"]]
        block = DCT.T @ block.reshape(-1, 8, 8) @ DCT + 128
        plane = block.reshape(p["high"], p["wide"], 8, 8).swapaxes(1, 2).reshape(8 * p["high"], 8 * p["wide"])
        own_h, own_w = -(-height * p["v"] // most_v), -(-width * p["h"] // most_h)
        planes.append(_grown(_grown(np.clip(plane[:own_h, :own_w], 0, 255), most_v // p["v"], 0), most_h // p["h"], 1)[:height, :width])
    return planes, width, height, adobe


def _restarts(coded: bytes) -> list[bytes]:
    pieces, begin, at = [], 0, 0
    while (at := coded.find(b"\xff", at)) >= 0 and at + 1 < len(coded):
        if coded[at + 1]:
            pieces.append(coded[begin:at])
            begin = at + 2
        at += 2
    return [*pieces, coded[begin:]]


def _grown(plane: np.ndarray, times: int, axis: int) -> np.ndarray:
    """``plane`` with ``times`` as many samples along ``axis``, in between by linear interpolation of sample centres."""
    n = plane.shape[axis]
    if times == 1:
        return plane
    at = np.clip((np.arange(n * times) + 0.5) / times - 0.5, 0, n - 1)
    lo = at.astype(int)
    part = (at - lo).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.take(plane, lo, axis) * (1 - part) + np.take(plane, np.minimum(lo + 1, n - 1), axis) * part


def decode(data: bytes) -> np.ndarray:
    """Pixels (y, x, band) as RGB bytes; gray is repeated, and CMYK is multiplied out."""
    planes, _, _, adobe = _planes(data)
    if len(planes) == 1:
        rgb = [planes[0]] * 3
    elif len(planes) in (3, 4):
        rgb = planes[:3]
        if adobe != 0 if len(planes) == 3 else adobe == 2:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        if len(planes) == 4:  # Adobe stores the complements of ink
            ink = [np.clip(c, 0, 255) for c in (*rgb, planes[3])]
            if adobe is None:
                ink = [255 - c for c in ink]
            rgb = [c * ink[3] / 255 for c in ink[:3]]
    else:
        raise ValueError("a JPEG of an unsupported number of components")
    return np.clip(np.rint(np.stack(rgb, axis=2)), 0, 255).astype(np.uint8)


#: Quantisation tables in rows and the Huffman tables (codes of each length, symbols) of the standard's annex K, for luminance and chrominance.
_QUANT = [
    bytes(map(int, (
        "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 "
        "18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
    ).split())),
    bytes(map(int, ("17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99" + " 99" * 32).split())),
]
_DC = [(bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))), (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))]


def _lengths(weights: np.ndarray) -> tuple[bytes, bytes]:
    """A Huffman table for ``weights`` of 256 symbols, with codes of 16 bits at most and none of ones alone."""
    import heapq

    w = [(int(n), 1, [s]) for s, n in enumerate(weights) if n] + [(0, 0, [256])]
    depth, order = dict.fromkeys([s for x in w for s in x[2]], 0), 0
    heap = [(n, i, s) for i, (n, _, s) in enumerate(w)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, order, x + y))
        order += 1
    counts = [0] * 300
    for d in depth.values():
        counts[max(d, 1)] += 1
    for d in range(299, 16, -1):  # codes that are too long are made shorter in pairs, as the standard's annex K.3 does
        while counts[d]:
            j = d - 2
            while not counts[j]:
                j -= 1
            counts[d] -= 2
            counts[d - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    last = max(d for d in range(1, 17) if counts[d])
    counts[last] -= 1  # the code of ones
    symbols = [s for s in sorted(depth, key=lambda s: (depth[s], s == 256, s)) if s < 256]
    return bytes(counts[1:17]), bytes(symbols)


def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's code and its length."""
    code, length, c, k = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            code[symbols[k]], length[symbols[k]] = c, bits
            c, k = c + 1, k + 1
        c <<= 1
    return code, length


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of each number's absolute value."""
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def encode(pixels: np.ndarray, quality: float = QUALITY) -> bytes:
    """A baseline file with full chrominance; only three bands, and no image of no pixels."""
    if pixels.ndim != 3 or pixels.shape[2] != 3 or not pixels.shape[0] or not pixels.shape[1]:
        raise ValueError("only images of three bands are encoded as JPEG")
    h, w, _ = pixels.shape
    scale = (50 / max(quality, 0.01) if quality < 0.5 else 200 - 200 * quality) / 100
    quant = [np.clip(np.rint(np.frombuffer(q, np.uint8) * scale), 1, 255) for q in _QUANT]
    r, g, b = (np.pad(pixels, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")[:, :, i].astype(np.float64) for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    blocks = []
    for i, plane in enumerate(planes):
        cells = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        blocks.append(np.rint((DCT @ cells @ DCT.T).reshape(-1, 64) / quant[i > 0]).astype(np.int64)[:, ZIGZAG])
    n = len(blocks[0])
    coef = np.stack(blocks, axis=1).reshape(3 * n, 64)  # blocks in the order in which they are written
    chroma = np.tile([0, 1, 1], n)
    mean = coef[:, 0].reshape(n, 3)
    change = np.diff(mean, axis=0, prepend=np.zeros((1, 3), np.int64)).ravel()
    at, k = np.nonzero(coef[:, 1:])
    k, value = k + 1, coef[at, k + 1]
    gap = k - np.where(np.append(-1, at[:-1]) == at, np.append(0, k[:-1]), 0) - 1
    # (block, place in it, kind of table, symbol, extra bits, their number): means at 0, runs of 16 and coefficients at 1 and up, ends at 65
    long = gap // 16
    fill = np.repeat(np.arange(len(at)), long)
    lasts = np.zeros(3 * n, np.int64)
    np.maximum.at(lasts, at, k)
    ends = np.flatnonzero(lasts < 63)
    size = _size(value)
    block = np.concatenate([np.arange(3 * n), at[fill], at, ends])
    place = np.concatenate([np.zeros(3 * n), k[fill] - 0.5, k, np.full(len(ends), 65.0)])
    symbol = np.concatenate([_size(change), np.full(len(fill), 0xF0), gap % 16 * 16 + size, np.zeros(len(ends), np.int64)])
    extra = np.concatenate([np.where(change < 0, change + (1 << _size(change)) - 1, change), np.zeros(len(fill), np.int64), np.where(value < 0, value + (1 << size) - 1, value), np.zeros(len(ends), np.int64)])
    extra_n = np.concatenate([_size(change), np.zeros(len(fill), np.int64), size, np.zeros(len(ends), np.int64)])
    order = np.lexsort((place, block))
    block, mean_, symbol, extra, extra_n = block[order], (place == 0)[order], symbol[order], extra[order], extra_n[order]
    table = np.where(mean_, 0, 2) + chroma[block]
    tables = [_DC[0], _DC[1], *(_lengths(np.bincount(symbol[table == t], minlength=256)) for t in (2, 3))]
    code, length = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    for t in range(4):
        own = table == t
        c, m = _codes(*tables[t])
        code[own], length[own] = c[symbol[own]], m[symbol[own]]
    word, bits = code << extra_n | extra, length + extra_n
    past = np.cumsum(bits)
    flat = np.ones(-(-int(past[-1]) // 8) * 8, np.uint8)
    owner = np.repeat(np.arange(len(bits)), bits)
    flat[: past[-1]] = word[owner] >> (past[owner] - 1 - np.arange(past[-1])) & 1
    coded = np.packbits(flat).tobytes().replace(b"\xff", b"\xff\x00")
    part = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += b"".join(part(0xDB, bytes([i]) + q.astype(np.uint8)[ZIGZAG].tobytes()) for i, q in enumerate(quant))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    out += b"".join(part(0xC4, bytes([i]) + counts + symbols) for i, (counts, symbols) in zip((0, 1, 16, 17), tables))
    return out + part(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + coded + b"\xff\xd9"
