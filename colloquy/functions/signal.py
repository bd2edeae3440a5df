"""Audio features: WAV decoding and log-mel filterbanks, per recording in Arrow batches."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE, FRAME, HOP, FFT, MELS = 16_000, 400, 160, 512, 80
LOW_HZ, HIGH_HZ = 20.0, 8000.0
FLOOR = 1.1920929e-7


def mel_filters() -> np.ndarray:
    """(MELS, FFT / 2 + 1) triangles whose corners are evenly spaced in mel."""
    mel = lambda hz: 1127.0 * np.log(1 + np.asarray(hz) / 700.0)
    corners = 700.0 * (np.exp(np.linspace(mel(LOW_HZ), mel(HIGH_HZ), MELS + 2) / 1127.0) - 1)
    hz = np.arange(FFT // 2 + 1) * RATE / FFT
    left, centre, right = corners[:-2, None], corners[1:-1, None], corners[2:, None]
    return np.maximum(0, np.minimum((hz - left) / (centre - left), (right - hz) / (right - centre)))


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(frames, MELS) of a 16 kHz signal; none for less than a frame."""
    n = (len(samples) - FRAME) // HOP + 1 if len(samples) >= FRAME else 0
    if not n:
        return np.zeros((0, MELS))
    at = np.arange(n)[:, None] * HOP + np.arange(FRAME)
    power = np.abs(np.fft.rfft(np.asarray(samples, float)[at] * 32768.0 * np.hamming(FRAME), FFT)) ** 2
    return np.log(np.maximum(power @ mel_filters().T, FLOOR))


def normalised_window(spectrogram: np.ndarray, start: int, frames: int = 998) -> np.ndarray:
    """``frames`` rows from ``start``; the mean of the rows there is taken off all, also of the zeros past the end."""
    part = spectrogram[start : start + frames]
    mean = part.mean(axis=0) if len(part) else 0.0
    return np.concatenate((part, np.zeros((frames - len(part), spectrogram.shape[1])))) - mean


def decode_wav(data: bytes) -> np.ndarray:
    """A 16-bit WAV file as mono 16 kHz samples: the channels' mean, linearly resampled."""
    with wave.open(io.BytesIO(data)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        mono = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()).mean(axis=1) / 32768.0
        ratio = f.getframerate() / RATE
    at = np.arange(int(len(mono) / ratio)) * ratio
    return np.interp(at, np.arange(len(mono)), mono) if len(mono) else mono


def _filterbanks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for many in batches:
        rows = [log_mel(np.asarray(s, float)) for s in many]
        yield pd.Series([list(m - m.mean(axis=0)) if len(m) else [] for m in rows])


def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for files in batches:
        yield pd.Series([decode_wav(bytes(f)).astype(np.float32) if f is not None else None for f in files])


def filterbank(samples: str) -> Column:
    """Log-mel rows of a column of samples, each mel's mean over the recording taken off."""
    return F.pandas_udf(_filterbanks, "array<array<double>>")(samples)


def wav_samples(content: str) -> Column:
    """Samples of a column of 16-bit WAV files; null for null."""
    return F.pandas_udf(_decoded, "array<float>")(content)
