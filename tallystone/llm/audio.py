"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM.

mu-law and A-law bytes are expanded by tables of 256 samples. An ADPCM block (the usual mono layout: predictor, step index, a
spare byte, then nibbles, the low one first) depends on its own header alone, so step i is taken in all blocks of a batch at once.
Resampling is polyphase: a windowed sinc at the ratio's phases, over all recordings of a batch, which silence keeps apart.

Edge cases: a null payload, codec or rate, an unknown codec and a rate under LEAST or over MOST give a null pcm and null n_samples; an
empty payload gives an empty pcm. A very long recording is decoded whole, by itself: its samples are in memory at once. Other columns are left out, whatever their names. A last ADPCM block may be short; less than a header is left out, and a step index over 88
counts as 88. Repeated rows are each decoded. An empty table gives none.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

TARGET, BLOCK, TAPS, BATCH = 16_000, 256, 16, 2 << 20
#: Rates that recordings have, of 1,000 to 768,000 samples a second; the least and the most bound what a byte grows to and the filters' taps.
LEAST, MOST = 1_000, 768_000

STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mu_law() -> np.ndarray:
    u = ~np.arange(256) & 255
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    part, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mu_law(), "alaw": _a_law()}
#: What a nibble adds, by step index and nibble; and the step index after it.
_STEP = STEPS[:, None]
_CODE = np.arange(16)[None, :]
_SIZE = (_STEP >> 3) + np.where(_CODE & 4, _STEP, 0) + np.where(_CODE & 2, _STEP >> 1, 0) + np.where(_CODE & 1, _STEP >> 2, 0)
DELTA = np.where(_CODE & 8, -_SIZE, _SIZE).astype(np.int32).ravel()
AFTER = np.clip(np.arange(89)[:, None] + MOVES[np.arange(16) & 7][None, :], 0, 88).astype(np.int32).ravel()


def adpcm(data: np.ndarray, offs: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Samples of recordings data[offs[i]:offs[i + 1]], and offsets into them."""
    size = np.diff(offs)
    n = -(-size // block)
    rec = np.repeat(np.arange(len(size)), n)
    at = offs[rec] + (np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)) * block
    got = np.minimum(offs[rec + 1] - at, block)
    use = got >= 4
    rec, at, got = rec[use], at[use], got[use]
    samples = 1 + 2 * (got - 4)
    off = np.concatenate([[0], np.cumsum(np.bincount(rec, samples, len(size)).astype(np.int64))])
    if not len(at):
        return np.zeros(0, np.int16), off
    head = data[at[:, None] + np.arange(4)].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.int16).astype(np.int32)
    step = np.minimum(head[:, 2], 88)
    width = 2 * (block - 4) + 1
    out = np.empty((width, len(at)), np.int16)
    out[0] = value
    bytes_ = np.zeros((block - 4, len(at)), np.int32)
    last = len(data) - 1
    for i in range(int(got.max()) - 4):
        bytes_[i] = data[np.minimum(at + 4 + i, last)]
    for i in range(int(samples.max()) - 1):
        code = bytes_[i >> 1] >> 4 if i & 1 else bytes_[i >> 1] & 15
        k = step * 16 + code
        value = np.clip(value + DELTA[k], -32768, 32767)
        step = AFTER[k]
        out[i + 1] = value
    return out.T[np.arange(width) < samples[:, None]], off


@lru_cache(32)
def _filters(up: int, down: int, taps: int) -> np.ndarray:
    """Coefficients by phase: a Hann-windowed sinc, cut at the lower of the two rates, each phase summing to 1."""
    cut = min(1.0, up / down)
    reach = np.arange(taps) - (taps // 2 - 1)
    x = reach[None, :] - (np.arange(up) / up)[:, None]
    h = cut * np.sinc(cut * x) * np.where(np.abs(x) < taps / 2, 0.5 + 0.5 * np.cos(2 * np.pi * x / taps), 0)
    return (h / h.sum(1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, off: np.ndarray, rate: int, target: int, taps: int = TAPS) -> tuple[np.ndarray, np.ndarray]:
    """Recordings at another rate; each has ceil(samples * target / rate) samples."""
    if rate == target:
        return pcm, off
    g = gcd(rate, target)
    up, down = target // g, rate // g
    taps = max(taps, 2 * (-(-taps * down // (2 * up)))) if down > up else taps
    h = _filters(up, down, taps)  # rates without a common divisor have as many phases as the target has samples a second
    n = np.diff(off)
    room = -(-(n + 2 * taps) // down) * down  # silence between, and phases that start with each recording
    place = np.concatenate([[0], np.cumsum(room)])
    x = np.zeros(place[-1] + taps, np.float32)
    where = np.repeat(place[:-1] + taps - off[:-1], n) + np.arange(off[-1])
    x[where] = pcm
    # a recording starts `taps` in, so outputs are counted from there
    steps = place[-1] // down
    out = np.empty((steps, up), np.float32)
    for p in range(up):
        first, phase = divmod(p * down, up)
        acc = np.zeros(steps, np.float32)
        for j in range(taps):
            s = x[first + j + taps - (taps // 2 - 1) :: down][:steps]
            acc[: len(s)] += h[phase, j] * s
        out[:, p] = acc
    m = -(-n * up // down)
    to = np.concatenate([[0], np.cumsum(m)])
    flat = np.clip(np.rint(out), -32768, 32767).astype(np.int16).ravel()
    take = np.repeat(place[:-1] // down * up - to[:-1], m) + np.arange(to[-1])
    return flat[take], to


def decode_batch(payloads: pa.Array, codec: list, rate: list, target: int, block: int) -> pa.Array:
    """PCM of each payload, little-endian; null for what can't be decoded."""
    payloads = payloads.cast(pa.large_binary())
    at = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1] if len(payloads) else np.zeros(1, np.int64)
    body = payloads.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    valid = payloads.is_valid().to_pylist()
    out: list = [None] * len(payloads)
    kinds: dict[tuple, list[int]] = {}
    for i, (c, r, ok) in enumerate(zip(codec, rate, valid)):
        if ok and r is not None and LEAST <= r <= MOST and c in (*TABLES, "adpcm"):
            kinds.setdefault((c, int(r)), []).append(i)
    for (c, r), rows in kinds.items():
        size = (at[1:] - at[:-1])[rows]
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), BATCH, "right")) + lo)
            some = rows[lo:hi]
            off = np.concatenate([[0], np.cumsum(size[lo:hi])])
            raw = np.concatenate([data[at[i] : at[i + 1]] for i in some]) if len(some) else data[:0]
            pcm, off = adpcm(raw, off, block) if c == "adpcm" else (TABLES[c][raw], off)
            pcm, off = resample(pcm, off, r, target)
            whole = pcm.astype("<i2").tobytes()
            for i, a, b in zip(some, off[:-1].tolist(), off[1:].tolist()):
                out[i] = whole[2 * a : 2 * b]
            lo = hi
    return pa.array(out, pa.binary())


def decode_audio(media: DataFrame, id: str, payload: str = "payload", codec: str = "codec", rate: str = "rate", target: int = TARGET, block: int = BLOCK) -> DataFrame:
    """(id, codec, sample_rate, n_samples, pcm) of each row of media: 16-bit little-endian PCM at `target` samples a second."""

    def run(batches):
        for b in batches:
            sizes = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(b.column("payload")), 0)))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + BATCH, "right")))
                s = b.slice(i, j - i)
                i = j
                pcm = decode_batch(s.column("payload"), s.column("codec").to_pylist(), s.column("rate").to_pylist(), target, block)
                n = pa.compute.cast(pa.compute.divide(pa.compute.binary_length(pcm), 2), pa.int64())
                yield pa.RecordBatch.from_arrays([s.column("id"), s.column("codec"), pa.array([target] * s.num_rows, pa.int32()), n, pcm], ["id", "codec", "sample_rate", "n_samples", "pcm"])

    rows = media.select(F.col(id).cast("long").alias("id"), F.col(payload).cast("binary").alias("payload"), F.col(codec).alias("codec"), F.col(rate).cast("int").alias("rate"))
    return rows.mapInArrow(run, "id long, codec string, sample_rate int, n_samples long, pcm binary").withColumnRenamed("id", id)
