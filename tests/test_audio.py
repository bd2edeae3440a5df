"""Recordings in blocks against whole recordings."""

import io
import struct
import wave

import numpy as np
import pandas as pd
import pytest

from colloquy.functions import signal
from colloquy.operators import audio


def wav(x, rate, bits=16, kind=1, before=b""):
    """x (frames, channels) from -1 to 1."""
    if kind == 3:
        data = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = (x * 127 + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        data = b"".join(struct.pack("<i", int(v))[:3] for v in (x * (2**23 - 1)).ravel())
    else:
        data = (x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    channels = x.shape[1]
    head = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def tone(seconds, rate, channels, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    return np.stack([0.5 * np.sin(2 * np.pi * (300 + 200 * c) * t) for c in range(channels)], axis=1) + 0.1 * rng.uniform(-1, 1, (len(t), channels))


def whole(x, rate):
    mono, ratio = x.mean(axis=1), rate / 16_000
    at = np.arange(int(len(mono) / ratio)) * ratio
    return np.interp(at, np.arange(len(mono)), mono)


def joined(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.audio_id, r.block)):
        assert r["first"] == sum(map(len, out.get(r.audio_id, [])))
        out.setdefault(r.audio_id, []).append(np.asarray(r.samples))
    return {k: np.concatenate(v) for k, v in out.items()}


def test_blocks_equal_whole_decoding(spark):
    cases = [(44_100, 2, 16, 1), (8_000, 1, 16, 1), (16_000, 3, 8, 1), (22_050, 1, 24, 1), (48_000, 2, 32, 3), (96_000, 1, 32, 1), (11_025, 2, 64, 3)]
    rows = [(i, wav(tone(3.3, rate, ch, i), rate, bits, kind, b"LIST\x05\x00\x00\x00abcde\x00" * (i % 2))) for i, (rate, ch, bits, kind) in enumerate(cases)]
    files = spark.createDataFrame(rows, "audio_id int, content binary")
    one, many = joined(audio.decode_blocks(files, 60)), joined(audio.decode_blocks(files, 1))
    assert set(one) == set(many) == set(range(len(cases)))
    for i, (rate, ch, bits, _) in enumerate(cases):
        assert np.array_equal(one[i], many[i])
        assert np.allclose(many[i], whole(tone(3.3, rate, ch, i), rate), atol=0.02 if bits == 8 else 1e-3)
    assert np.array_equal(one[1], signal.decode_wav(rows[1][1]).astype(np.float32))


def test_what_is_no_recording_has_no_blocks(spark):
    good = wav(tone(1.5, 16_000, 1), 16_000)
    rows = [("null", None), ("empty", b""), ("text", b"no recording at all"), ("mp3", b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 85, 1, 8000, 8000, 1, 8) + b"data\0\0\0\0"), ("none", wav(np.zeros((0, 1)), 16_000)), ("head", good[:30]), ("short", good[:10_045]), ("good", good)]
    done = joined(audio.decode_blocks(spark.createDataFrame(rows, "audio_id string, content binary"), 1))
    assert {k: len(v) for k, v in done.items()} == {"good": 24_000, "short": (10_045 - 44) // 2}


@pytest.mark.parametrize("seconds", [1, 3, 60])
def test_filterbanks_of_blocks_equal_one_pass(spark, seconds):
    rows = [("a", wav(tone(13.7, 16_000, 1), 16_000)), ("b", wav(tone(2.01, 44_100, 2), 44_100)), ("c", wav(tone(0.02, 16_000, 1), 16_000)), ("d", wav(tone(1.0, 16_000, 1), 16_000))]
    files = spark.createDataFrame(rows, "audio_id string, content binary")
    bank = audio.filterbank_seconds(audio.decode_blocks(files, seconds, overlap=audio.FRAME - audio.HOP))
    got = {}
    for r in sorted(bank.collect(), key=lambda r: (r.audio_id, r.second)):
        got.setdefault(r.audio_id, []).extend(r.mels)
    whole_bank = {k: signal.log_mel(v) for k, v in joined(audio.decode_blocks(files)).items()}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in whole_bank.items() if len(v)}
    for k, v in got.items():
        assert np.allclose(v, whole_bank[k])
    chunks = audio.normalised_chunks(bank).collect()
    assert {k: max(r.chunk for r in chunks if r.audio_id == k) for k in got} == {"a": 13, "b": 1, "d": 0}
    for r in chunks:
        assert np.allclose(r.mels, signal.normalised_window(whole_bank[r.audio_id], r.chunk * 100)) and r.frames == min(998, len(whole_bank[r.audio_id]) - 100 * r.chunk)


def test_headers_are_those_of_the_standard_library(spark):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(12_345), f.writeframes(b"\1\2\3\4" * 9)
    assert audio.read_header(raw.getvalue()) == (1, 2, 12_345, 16, 44, 36)


def test_a_large_batch_is_handed_on_in_pieces(spark, monkeypatch):
    """A batch of many short rows makes far more than it is, so its rows go out a few at a time."""
    made = []
    files = spark.createDataFrame([("a", b"")], "audio_id string, content binary")
    seconds = spark.createDataFrame([], "audio_id string, second long, mels array<array<double>>")
    monkeypatch.setattr(type(files), "mapInPandas", lambda self, f, schema: made.append(f) or self)
    audio.decode_blocks(files, 1)
    audio.normalised_chunks(seconds)
    decode, normalised = made
    one = {"audio_id": "a", "block": 0, "first": 0, "total": 16_000, "count": 16_000, "begin": 0, "n": 16_000, "ratio": 1.0, "format": 1, "bits": 16, "channels": 1, "data": bytes(32_000)}
    parts = list(decode(iter([pd.DataFrame([one] * 1_000)])))
    assert sum(map(len, parts)) == 1_000 and max(sum(map(len, p["samples"])) for p in parts) <= audio.PIECE + 16_000
    short = pd.DataFrame({"audio_id": "a", "chunk": range(100), "mels": [[np.ones(80)]] * 100})
    parts = list(normalised(iter([short])))
    assert sum(map(len, parts)) == 100 and max(len(p) * 998 * 80 for p in parts) <= audio.PIECE + 998 * 80
