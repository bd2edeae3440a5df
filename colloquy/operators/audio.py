"""Recordings in blocks: WAV files decoded to 16 kHz mono, and filterbanks, without a whole recording in one row.

A file's header is read once; its frames are dealt out in blocks of bytes, cut in
the JVM, each with the frame behind it that interpolation needs. What a sample is
depends on its place in the recording alone, so blocks equal one pass, whatever
their size. Blocks for filterbanks overlap by what a frame of features reaches
beyond its block. Blocks are whole seconds, so that chunks of features begin with one.

Defined results: PCM of 8, 16, 24 and 32 bits and floats of 32 and 64 bits are read; a file
that is none of these, or whose data do not begin within the first ``HEAD`` bytes, has
no blocks, like a null or an empty one; a file that ends early has the frames that are there.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.signal import FRAME, HOP, MELS, RATE, log_mel

#: A header is looked for in so many bytes.
HEAD = 1 << 16
SECOND = RATE // HOP
#: Features of a chunk: ten seconds, as many frames as lie wholly in them.
CHUNK = 998
#: About so many samples or features are handed on by a task at a time, however many rows a batch has.
PIECE = 1 << 21
HEADER = "format int, channels int, rate int, bits int, data_at long, data_size long"


def read_header(head: bytes | None) -> tuple | None:
    """(format, channels, rate, bits, data_at, data_size) of a WAV file's beginning; None if it is none that is read."""
    if head is None or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, found = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(head):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, at + 8)
            if kind == 0xFFFE and size >= 40 and at + 34 <= len(head):
                kind = struct.unpack_from("<H", head, at + 32)[0]
            found = (kind, channels, rate, bits)
        elif name == b"data" and found:
            known = found[:1] == (1,) and found[3] in (8, 16, 24, 32) or found[:1] == (3,) and found[3] in (32, 64)
            return (*found, at + 8, size) if known and found[1] and found[2] else None
        at += 8 + size + size % 2
    return None


def frames_of(data: bytes, kind: int, bits: int, channels: int) -> np.ndarray:
    """The mean of the channels, frame by frame, from -1 to 1."""
    if kind == 3:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(float)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return x.reshape(-1, channels).mean(axis=1)


def _header(head: Column) -> Column:
    @F.pandas_udf(HEADER)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HEADER.split(", ")]
        for heads in batches:
            rows = [read_header(None if h is None else bytes(h)) or (None,) * len(names) for h in heads]
            yield pd.DataFrame(rows, columns=names).astype("Int64")

    return made(head)


def _pieces(batch: pd.DataFrame, sizes: pd.Series) -> Iterator[pd.DataFrame]:
    """The batch's rows in turn, about ``PIECE`` of what they make at a time."""
    for _, part in batch.groupby((sizes.cumsum() - sizes) // PIECE, sort=False):
        yield part


def decode_blocks(files: DataFrame, seconds: int = 60, overlap: int = 0) -> DataFrame:
    """(audio_id, block, first, total, samples): files (audio_id, content) as 16 kHz mono in blocks of so many seconds.

    ``first`` is a block's first sample, ``total`` the recording's number of
    samples; a block has ``overlap`` samples of the next one behind its own.
    """
    h = files.select("audio_id", "content", _header(F.substring("content", 1, HEAD)).alias("h")).select("audio_id", "content", "h.*").filter("format IS NOT NULL")
    width = F.col("channels") * F.floor(F.col("bits") / 8)
    there = F.least(F.col("data_size"), F.octet_length("content") - F.col("data_at"))
    h = h.withColumns({"width": width, "n": F.floor(there / width)}).withColumn("ratio", F.col("rate") / F.lit(float(RATE)))
    h = h.withColumn("total", F.floor(F.col("n") / F.col("ratio"))).filter("total > 0")
    size = seconds * RATE
    rows = h.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / size))).alias("block"))
    rows = rows.withColumns({"first": F.col("block") * size, "count": F.least(F.col("total") - F.col("block") * size, F.lit(size + overlap))})
    begin = F.floor(F.col("first") * F.col("ratio"))
    end = F.least(F.floor((F.col("first") + F.col("count") - 1) * F.col("ratio")) + 2, F.col("n"))
    rows = rows.withColumns({"begin": begin, "end": end})
    data = F.substring(F.col("content"), (F.col("data_at") + F.col("begin") * F.col("width") + 1).cast("int"), ((F.col("end") - F.col("begin")) * F.col("width")).cast("int"))
    cut = rows.select("audio_id", "block", "first", "count", "total", "begin", "n", "ratio", "format", "bits", "channels", data.alias("data"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _pieces(batch, batch["count"]):
                made = []
                for r in part.itertuples():
                    mono = frames_of(bytes(r.data), r.format, r.bits, r.channels)
                    at = (r.first + np.arange(r.count)) * r.ratio
                    low = np.floor(at).astype(np.int64)
                    a, b = mono[low - r.begin], mono[np.minimum(low + 1, r.n - 1) - r.begin]
                    made.append((a + (b - a) * (at - low)).astype(np.float32))
                yield part[["audio_id", "block", "first", "total"]].assign(samples=made)

    kind = files.schema["audio_id"].dataType.simpleString()
    # from here on a block is a row of its own, wherever its file was read
    return cut.repartition("audio_id", "block").mapInPandas(decode, f"audio_id {kind}, block long, first long, total long, samples array<float>")


def filterbank_seconds(blocks: DataFrame) -> DataFrame:
    """(audio_id, second, mels): log-mel rows of each second's frames, from blocks with an ``overlap`` of at least a frame less a hop."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                frames = max((r.total - FRAME) // HOP + 1, 0)
                first = r.first // HOP
                x = np.asarray(r.samples, float)
                rows = [(first + at, x[at * HOP : (at + SECOND - 1) * HOP + FRAME]) for at in range(0, -(-len(x) // HOP), SECOND)]
                # of the samples behind a block only those count that its own frames reach
                rows = [(f, s) for f, s in rows if f < min(frames, first + r.own)]
                if rows:
                    mels = [list(log_mel(s)[: frames - f]) for f, s in rows]
                    yield pd.DataFrame({"audio_id": [r.audio_id] * len(rows), "second": [f // SECOND for f, _ in rows], "mels": mels})

    kind = blocks.schema["audio_id"].dataType.simpleString()
    after = F.lead("first").over(W.partitionBy("audio_id").orderBy("first"))
    own = blocks.select("audio_id", "first", F.coalesce((after - F.col("first")) / HOP, F.lit(1 << 40)).cast("long").alias("own"))
    return blocks.join(own, ["audio_id", "first"]).mapInPandas(made, f"audio_id {kind}, second long, mels array<array<double>>")


def normalised_chunks(seconds: DataFrame) -> DataFrame:
    """(audio_id, chunk, frames, mels): ``CHUNK`` rows from each second on; the mean of the rows there is taken off all, also of the zeros past the end."""
    ten = W.partitionBy("audio_id").orderBy("second").rowsBetween(0, 9)
    held = seconds.select("audio_id", F.col("second").alias("chunk"), F.slice(F.flatten(F.collect_list("mels").over(ten)), 1, CHUNK).alias("mels"))

    def normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a chunk goes out at its full size, however short it came in
            for part in _pieces(batch, pd.Series(CHUNK * MELS, batch.index)):
                made, frames = [], []
                for mels in part["mels"]:
                    x = np.stack([np.asarray(m, float) for m in mels])
                    frames.append(len(x))
                    made.append(list(np.concatenate((x, np.zeros((CHUNK - len(x), MELS)))) - x.mean(axis=0)))
                yield pd.DataFrame({"audio_id": part["audio_id"], "chunk": part["chunk"], "frames": frames, "mels": made})

    kind = seconds.schema["audio_id"].dataType.simpleString()
    return held.mapInPandas(normalised, f"audio_id {kind}, chunk long, frames int, mels array<array<double>>")
