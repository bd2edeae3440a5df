"""Overlap-add and windows of subtokens against plain versions."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colloquy.operators import windows

STEP = windows.FRAME_SECONDS


def test_overlap_add_equals_adding_up_matrices(spark):
    rng = random.Random(2)
    recordings, placed, assigned, want_acts, want_counts = [("a", 16_000 * 3), ("b", 40_000), ("c", 0)], [], [], {}, {}
    for audio, samples in recordings:
        total = -(-samples // 270) + 1
        weight, acts, counts = {}, {}, {}
        for w in range(samples // 16_000 + 1):
            frames = [[rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(3)] for _ in range(100)]
            who = [rng.choice([None, -1, 0, 1, 2]) for _ in range(3)]
            placed.append((audio, w, w * 16_000, frames))
            assigned.append((audio, w, who))
            first = round(w / STEP)
            for f, row in enumerate(frames):
                if first + f < total:
                    weight[first + f] = weight.get(first + f, 0) + 1
                    counts[first + f] = counts.get(first + f, 0) + sum(row)
                    for k, a in zip(who, row):
                        if k is not None and k >= 0:
                            acts[first + f, k] = acts.get((first + f, k), 0) + a
        want_counts |= {(audio, f): round(c / weight[f]) for f, c in counts.items()}
        want_acts |= {(audio, f, k): a / weight[f] for (f, k), a in acts.items()}
    rows = windows.placed_windows(spark.createDataFrame(placed, "audio_id string, window int, start_sample long, frames array<array<double>>"), spark.createDataFrame(recordings, "audio_id string, samples long"))
    acts, counts = windows.overlap_add(rows, spark.createDataFrame(assigned, "audio_id string, window int, speakers array<int>"))
    assert {(r.audio_id, r.frame, r.speaker): r.activation for r in acts.collect()} == pytest.approx(want_acts)
    assert {(r.audio_id, r.frame): r.speakers for r in counts.collect()} == want_counts


def plainly(counts, size=200, overlap=30, most=500):
    out, start = [], 0
    while start < len(counts):
        take = min(size, len(counts) - start)
        while sum(counts[start : start + take]) + 2 > most and take > 20:
            take -= 20
        out.append((start, take))
        if start + take >= len(counts):
            break
        start += max(1, take - (overlap if len(counts) > size else 0))
    return out


def test_windows_bounded_by_real_subtokens(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    texts = ["", "una", "palabra " * 200, "palabra " * 201, "otorrinolaringólogo " * 190, " ".join(rng.choice(["a", "de", "Hexakosioihexekontahexaphobie", "reunión", "🎉🎉🎉"]) for _ in range(900)), "ﷺ漢字かな" * 40 + " x"]
    counts = [[len(model.encode(w)) for w in t.split()] for t in texts]
    done = spark.createDataFrame(list(enumerate(counts)), "i int, counts array<int>").select("i", windows.subtoken_windows(F.col("counts")).alias("w")).collect()
    got = {r.i: [(w.start, w["take"]) for w in r.w] for r in done}
    assert got == {i: plainly(c) for i, c in enumerate(counts)}
    assert len({take for ws in got.values() for _, take in ws}) > 4
    assert spark.sql("SELECT CAST(NULL AS array<int>) AS c").select(windows.subtoken_windows(F.col("c"))).first()[0] == []


def test_labels_of_subtokens_become_labels_of_words(spark):
    rows = [([{"start": 0, "take": 3}, {"start": 2, "take": 2}], [["0", ",", "0", ".", ",", "?"], ["0", ":", ","]], [1, 2, 3, 0]), ([], [], []), (None, None, None)]
    df = spark.createDataFrame(rows, "w array<struct<start:int,take:int>>, l array<array<string>>, c array<int>")
    # the third word is in both windows: the later one has the say
    assert [r[0] for r in df.select(windows.word_labels(F.col("w"), F.col("l"), F.col("c"))).collect()] == [["0", ",", ",", "0"], [], []]
