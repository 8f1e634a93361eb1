import hashlib
import io
import wave
import zlib

import numpy as np

from quillstone.llm.media import fingerprint, media_columns, media_row, peaks

from .data import by_id, docs


def test_round_trip_and_contract(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "word " * 40_000, "a"]
    got = by_id(media_columns(docs(spark, texts)))
    assert sorted(got) == list(range(8))
    for i, r in got.items():
        b = (texts[i] or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(p)
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert len(r.fp_times) == len(r.fp_codes) == int(r.feature.split(":")[0]) and r.fp_times == sorted(r.fp_times)
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[7][1:] and got[2].feature != got[5].feature
    assert media_columns(docs(spark, ["a"]).limit(0)).count() == 0


def test_peaks_find_tones_and_chunks_agree():
    t = np.arange(256 * 300)
    tone = (128 + 60 * np.sin(2 * np.pi * t * 40 / 256) + 20 * np.sin(2 * np.pi * t * 7 / 256)).astype(np.uint8)
    p = peaks(tone)
    assert (p[:, 0] == 40).all() and (p[:, 1] == 7).all() and (p[:, 3] == 40).all()
    assert (peaks(tone, chunk=7) == p).all()


def test_direct_transform_gives_the_same_peaks():
    x = np.random.default_rng(2).integers(0, 256, 1152).astype(np.uint8)
    n = np.arange(256)
    for i, row in enumerate(peaks(x)):
        s = (x[i * 128 : i * 128 + 256].astype(float) - 128) * np.hanning(256)
        power = [abs((s * np.exp(-2j * np.pi * k * n / 256)).sum()) ** 2 for k in range(129)]
        best = [a + int(np.argmax(power[a:b])) for a, b in ((2, 12), (12, 28), (28, 60), (60, 129))]
        assert list(row[1:]) == best and row[0] == max(best, key=lambda k: power[k])
    times, codes = fingerprint(x.tobytes())
    assert len(times) == 7 + 6 + 5 and (np.diff(times) >= 0).all()


def test_the_last_bytes_are_in_a_window():
    for units in (1, 3):
        start = "a" * (576 * units - 64)
        one, other = (media_row((start + end).encode()) for end in ("a" * 64, "az" * 32))
        assert one[6] != other[6]
    assert len(peaks(np.zeros(576, np.uint8))) == 4 and len(peaks(np.zeros(1152, np.uint8))) == 8
