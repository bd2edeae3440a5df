"""Windows of models put together again: overlap-add of activations, and windows of words bounded by their subtokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 16_000
#: Fixed values of the segmentation model: seconds a frame.
FRAME_SECONDS = 0.016875


def first_frame(start_sample: Column) -> Column:
    """The frame of the whole recording at which a window begins, halves to even."""
    return F.bround(start_sample / RATE / FRAME_SECONDS).cast("long")


def placed_windows(windows: DataFrame, recordings: DataFrame) -> DataFrame:
    """(audio_id, window, frame, acts): windows (audio_id, window, start_sample, frames array<array<double>>) on the recording's frames.

    ``frames`` has the local speakers' activations frame by frame; what lies beyond
    the recording (audio_id, samples) is left out.
    """
    total = F.ceil(F.col("samples") / RATE / FRAME_SECONDS) + 1
    rows = windows.join(recordings.select("audio_id", total.alias("total")), "audio_id")
    rows = rows.select("audio_id", "window", "total", first_frame(F.col("start_sample")).alias("first"), F.posexplode("frames").alias("at", "acts"))
    return rows.select("audio_id", "window", (F.col("first") + F.col("at")).alias("frame"), "acts", "total").filter("frame < total").drop("total")


def overlap_add(placed: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activations (audio_id, frame, speaker, activation) and speakers at once (audio_id, frame, speakers).

    placed (audio_id, window, frame, acts), assigned (audio_id, window, speakers
    array): the global speaker of each local one, null or below 0 for none. Sums
    are divided by how many windows cover a frame, and numbers of speakers rounded,
    halves to even. A local speaker without a global one counts for the number only.
    Sums are made before anything is dealt out, so a long recording is many tasks' work.
    """
    own = F.aggregate("acts", F.lit(0.0), lambda s, a: s + a)
    covered = placed.groupBy("audio_id", "frame").agg(F.count("*").alias("weight"), F.sum(own).alias("acts"))
    counts = covered.select("audio_id", "frame", F.bround(F.round(F.col("acts") / F.col("weight"), 9)).cast("long").alias("speakers"))
    named = placed.join(assigned, ["audio_id", "window"]).select("audio_id", "frame", F.explode(F.arrays_zip("speakers", "acts")).alias("s"))
    summed = named.filter("s.speakers >= 0").groupBy("audio_id", "frame", F.col("s.speakers").alias("speaker")).agg(F.sum("s.acts").alias("sum"))
    share = summed.join(covered.select("audio_id", "frame", "weight"), ["audio_id", "frame"])
    return share.select("audio_id", "frame", "speaker", (F.col("sum") / F.col("weight")).alias("activation")), counts


def subtoken_windows(counts: Column, size: int = 200, overlap: int = 30, most: int = 500, fewer: int = 20, around: int = 2) -> Column:
    """array<struct<start,take>>: windows of words that a model of ``most`` subtokens takes, from the subtokens of each word.

    A window has ``size`` words; while it has more than ``most`` subtokens (with
    ``around`` at its ends) and more than ``fewer`` words it loses ``fewer`` words. The next one begins
    ``overlap`` words before its end, or at its end where all words fit into one;
    the last one ends with the text. Null and empty arrays have no windows.
    """

    @F.pandas_udf("array<struct<start:int,take:int>>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_windows(c, size, overlap, most, fewer, around) for c in batch], dtype="object")

    return made(counts)


def _windows(counts, size: int, overlap: int, most: int, fewer: int, around: int) -> list[dict]:
    if counts is None or not len(counts):
        return []
    before = np.concatenate(([0], np.cumsum(counts)))
    n, start, out = len(counts), 0, []
    back = overlap if n > size else 0
    while True:
        take = min(size, n - start)
        while before[start + take] - before[start] + around > most and take > fewer:
            take -= fewer
        out.append({"start": start, "take": take})
        if start + take >= n:
            return out
        start += max(1, take - back)


def word_labels(windows: Column, labels: Column, counts: Column) -> Column:
    """One label a word from the labels of each window's subtokens (array<array<string>>), later windows over earlier ones.

    Of a word's subtokens the first ``.`` or ``?`` counts, else the last label that is not ``0``, else ``0``.
    """

    @F.pandas_udf("array<string>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ws, ls, cs in batches:
            yield pd.Series([_labels(w, label, c) for w, label, c in zip(ws, ls, cs)], dtype="object")

    return made(windows, labels, counts)


def _labels(windows, labels, counts) -> list[str]:
    out = ["0"] * (0 if counts is None else len(counts))
    for w, own in zip(windows if windows is not None else [], labels if labels is not None else []):
        at = 0
        for word in range(w["start"], w["start"] + w["take"]):
            mine, at = own[at : at + counts[word]], at + counts[word]
            out[word] = next((x for x in mine if x in (".", "?")), next((x for x in mine[::-1] if x != "0"), "0"))
    return out
