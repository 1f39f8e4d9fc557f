"""Telephony audio as columns: mu-law and A-law by lookup tables, IMA ADPCM across blocks, resampled PCM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._common import int_id

#: Samples a second of the calls and of what is stored; bytes of an ADPCM block (a header of 4, then two samples a byte).
RATE, STORED_RATE, BLOCK = 8000, 16000, 256
#: Input samples that the resampling filter spans at either side; bytes of payload decoded at a time.
REACH, AT_ONCE = 8, 1 << 20
CODECS = ("mulaw", "alaw", "adpcm")

_SCHEMA = "doc_id long, codec string, sample_rate int, n_samples long, pcm binary"


def _mulaw() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    t = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -t, t).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exponent, t = (a >> 4) & 7, (a & 15) << 4
    t = np.where(exponent == 0, t + 8, (t + 264) << np.maximum(exponent - 1, 0))
    return np.where(a & 128, t, -t).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253,
        279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026,
        4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_CODE = np.arange(16)
#: By step and code: what is added to the predictor, and the next step.
_CHANGE = (STEPS[:, None] >> 3) + np.where(_CODE & 4, STEPS[:, None], 0) + np.where(_CODE & 2, STEPS[:, None] >> 1, 0) + np.where(_CODE & 1, STEPS[:, None] >> 2, 0)
_CHANGE = np.where(_CODE & 8, -_CHANGE, _CHANGE).astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(89)[:, None] + MOVES, 0, 88) * 16).astype(np.int32).ravel()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (block, sample) of IMA ADPCM ``blocks`` (block, byte): one step of all blocks at a time.

    A header is the first sample (16 bits, low byte first), the step's index (above 88 counts as 88) and a spare byte; codes follow, low half first.
    """
    data = np.ascontiguousarray(blocks[:, 4:].T)
    predictor = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    at = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out = np.empty((2 * len(data) + 1, len(blocks)), np.int16)
    out[0] = predictor
    for i, byte in enumerate(data):
        for half, code in enumerate((byte & 15, byte >> 4)):
            step = at + code
            predictor += _CHANGE[step]
            np.clip(predictor, -32768, 32767, out=predictor)
            at = _NEXT[step]
            out[2 * i + half + 1] = predictor
    return out.T


def _filters(up: int, down: int) -> np.ndarray:
    """(phase, tap): a low-pass filter, sinc under a Hann window, that leaves a constant as it is."""
    scale = min(1.0, up / down)
    reach = int(np.ceil(REACH / scale))
    t = np.arange(-reach + 1, reach + 1)[None, :] - (np.arange(up) / up)[:, None]
    h = np.sinc(t * scale) * np.where(abs(t) < reach, 0.5 + 0.5 * np.cos(np.pi * t / reach), 0)
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, at: np.ndarray, rate: int = RATE, to: int = STORED_RATE) -> tuple[np.ndarray, np.ndarray]:
    """Each signal of ``pcm`` (int16; ``at`` has where each begins, with the end) at the rate ``to``, and where these begin; silence lies around each.

    n samples become ceil(n * to / rate). A sample is a weighted sum of those around it, all signals at once: each is laid between zeros.
    """
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    n = np.diff(at)
    made = -(-n * up // down)
    begin = np.append(0, np.cumsum(made))
    if up == down:
        return pcm, at
    h = _filters(up, down)
    reach = h.shape[1] // 2
    first = at[:-1] + reach * (2 * np.arange(len(n)) + 1)
    laid = np.zeros(len(pcm) + 2 * reach * len(n), np.float32)
    laid[np.arange(len(pcm)) + np.repeat(first - at[:-1], n)] = pcm
    out = np.empty(int(begin[-1]), np.int16)
    if down == 1:
        place = np.arange(len(pcm)) + np.repeat(first - at[:-1], n)
        wide = np.empty((len(pcm), up), np.int16)
        for phase in range(up):
            taps = np.flatnonzero(h[phase])
            if len(taps) == 1 and h[phase, taps[0]] == 1:
                wide[:, phase] = pcm
                continue
            whole = np.convolve(laid, h[phase][::-1], "full")[2 * reach - 1 :]  # whole[i] = sum of h[k] * laid[i + k]
            wide[:, phase] = np.clip(np.rint(whole[place - reach + 1]), -32768, 32767)
        out[:] = wide.ravel()
        return out, begin
    turn = np.arange(int(begin[-1])) - np.repeat(begin[:-1], made)
    place, phase = np.repeat(first, made) + turn * down // up, turn * down % up
    for lo in range(0, len(out), 1 << 18):
        hi = lo + (1 << 18)
        window = laid[place[lo:hi, None] + np.arange(-reach + 1, reach + 1)]
        out[lo:hi] = np.clip(np.rint((window * h[phase[lo:hi]]).sum(axis=1)), -32768, 32767)
    return out, begin


def decode(codec: str, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int16 samples of all payloads of one codec (``at``: where each begins, with the end), and where each one's samples begin, with the end.

    A last ADPCM block may be short: with no whole header it has no sample, else what its bytes give.
    """
    if codec != "adpcm":
        return (MULAW if codec == "mulaw" else ALAW)[data], at
    n = np.diff(at)
    blocks = -(-n // BLOCK)
    last = n - (blocks - 1) * BLOCK
    each = 2 * (BLOCK - 4) + 1
    samples = np.where(n > 0, (blocks - 1) * each + np.where(last >= 4, 2 * (last - 4) + 1, 0), 0)
    begin = np.append(0, np.cumsum(blocks)) * BLOCK
    laid = np.zeros(int(begin[-1]), np.uint8)
    laid[np.arange(len(data)) + np.repeat(begin[:-1] - at[:-1], n)] = data
    out, ends = adpcm(laid.reshape(-1, BLOCK)).ravel(), np.append(0, np.cumsum(samples))
    return out[np.arange(int(ends[-1])) + np.repeat(begin[:-1] // BLOCK * each - ends[:-1], samples)], ends


def _pcm(batches: Iterator[pa.RecordBatch], rate: int, to: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, payloads in _tokens.slices(b["payload"], AT_ONCE):
            n = len(payloads)
            codecs = b["codec"].slice(row, n)
            kinds = codecs.to_numpy(zero_copy_only=False)
            null = payloads.is_null().to_numpy(zero_copy_only=False) | ~np.isin(kinds.astype(str), CODECS)
            made: list = [None] * n
            count = np.zeros(n, np.int64)
            for codec in CODECS:
                own = np.flatnonzero((kinds == codec) & ~null)
                if not len(own):
                    continue
                data, at = _tokens.raw(payloads.take(pa.array(own)))
                out, at = resample(*decode(codec, data, at), rate, to)
                count[own] = np.diff(at)
                stored = memoryview(out.astype("<i2", copy=False)).cast("B")
                for i, x, y in zip(own, at, at[1:]):
                    made[i] = stored[2 * x : 2 * y]
            length = np.append(0, np.cumsum(2 * count)).astype(np.int64)
            values = np.frombuffer(b"".join(x for x in made if x is not None), np.uint8)
            pcm = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(length), pa.py_buffer(values)])
            if null.any():
                pcm = pc.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), pcm)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].slice(row, n), codecs, pa.array(np.full(n, to, np.int32), mask=null), pa.array(count, mask=null), pcm.cast(pa.binary())],
                ["doc_id", "codec", "sample_rate", "n_samples", "pcm"],
            )


def store_pcm(calls: DataFrame, payload: Column, codec: Column, id_col: str = "doc_id", rate: int = RATE, to: int = STORED_RATE) -> DataFrame:
    """One row for each row of ``calls``: ``doc_id``, ``codec``, ``sample_rate``, ``n_samples``, ``pcm`` (16 bits, low byte first).

    ``payload`` is the call's bytes (a string counts as its UTF-8), ``codec`` one of CODECS. Laws are expanded by a table of 256 samples; ADPCM by one
    numpy step over all blocks of a batch at a time; the samples are resampled from ``rate`` to ``to`` by a polyphase filter.

    A null payload, or another codec, gives null sample rate, number and pcm; an empty one gives no samples. An id that isn't an integer counts as null. A row doesn't depend on any
    other, so equal rows give equal rows; nothing is shuffled. An empty table gives no rows. Other columns aren't read.
    """
    rows = calls.select(int_id(id_col).alias("doc_id"), codec.alias("codec"), payload.alias("payload"))
    return rows.mapInArrow(lambda b: _pcm(b, rate, to), _SCHEMA)


def as_calls(id_col: str = "doc_id") -> Column:
    """A codec for each document, where documents' bytes stand for calls: by turns of the id; a null id counts as 0."""
    turn = F.pmod(F.coalesce(int_id(id_col), F.lit(0)), F.lit(len(CODECS))).cast("int")
    return F.element_at(F.array(*map(F.lit, CODECS)), turn + 1)
