"""Media columns: texts stored as 8-bit WAV samples, and spectral-peak pair fingerprints of them.

Python's wave module writes and reads the container. Windows of 256 samples, half overlapping, the last filled up
with silence, go through a short-time Fourier transform; the strongest bin of each of four bands is a peak. Each
window's loudest peak, and no other of its peaks, is paired with the loudest ones of the three following windows.
A fingerprint is the time-coded pair of arrays (window, code).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
WINDOW, HOP, AHEAD, RATE, SILENCE = 256, 128, 3, 8000, 128
#: Bins at which the four bands begin and end.
BANDS = (2, 12, 28, 60, 129)
TAPER = np.hanning(WINDOW).astype(np.float32)
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fp_times array<int>, fp_codes array<int>"


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """(windows, 5): the loudest band's strongest bin, then that of each band. Windows are transformed in chunks."""
    samples = np.pad(samples, (0, -(len(samples) - WINDOW) % HOP), constant_values=SILENCE)
    wave_ = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    out = np.empty((len(wave_), 5), dtype=np.int64)
    for at in range(0, len(wave_), chunk):
        part = wave_[at : at + chunk].astype(np.float32)
        part -= SILENCE
        part *= TAPER
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        bins = np.stack([power[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:])], axis=1)
        out[at : at + chunk, 1:] = bins
        out[at : at + chunk, 0] = bins[np.arange(len(bins)), np.take_along_axis(power, bins, 1).argmax(axis=1)]
    return out


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and codes: anchor bin, later bin, distance. As many pairs as windows allow, in time order."""
    p = peaks(np.frombuffer(payload, dtype=np.uint8))
    times, codes = [], []
    for d in range(1, AHEAD + 1):
        anchor, later = p[:-d, 0], p[d:, 0]
        times.append(np.arange(len(anchor)))
        codes.append((anchor << 16) | (later << 4) | d)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def media_row(text: bytes) -> tuple:
    payload = text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))
    media = to_wav(payload)
    back = from_wav(media)
    times, codes = fingerprint(back)
    feature = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(codes)}:{feature}", times, codes


def _run(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 256):  # results are sent in small batches: fingerprints are large
            rows = [media_row(x or b"") for x in texts.slice(at, 256).to_pylist()]
            cols = list(zip(*rows))
            plain = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c))) for c in cols[7:]]
            yield pa.RecordBatch.from_arrays([ids.slice(at, 256), *plain, *lists], [f.split()[0] for f in SCHEMA.split(", ")])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, in the columns of SCHEMA; feature digests the fingerprint, its length first.

    A null text is empty and is stored as 576 bytes 255. Equal texts get equal values. Null and repeated ids
    pass through. Each text is handled whole, a text at a time. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_run, SCHEMA)
