"""Text quality, clean-up of generated texts, and signals."""

import io
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import minutes, quality, signal, text


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()[0]


@pytest.mark.parametrize(
    "said, seconds, terms, kind",
    [
        ("Buenos días a todos, empezamos la reunión de seguimiento.", 3.0, [], None),
        ("uno dos tres cuatro", 0.2, [], "SpeechRateExceeded"),
        ("Bass Guitar, Electric Guitar, Guitar, " * 6, 10.0, [], "NgramRepetitionLoop"),
        ("Sí, sí, sí, totalmente de acuerdo.", 2.0, [], None),
        ("No, no, eso no lo veo claro.", 1.8, [], None),
        ("Docker Kubernetes Redis Kafka Spark Flink Hadoop Hive", 4.0, "Docker Kubernetes Redis Kafka Spark Flink Hadoop Hive".split(), "VocabularyEchoing"),
        ("", 1.0, [], None),
    ],
)
def test_anomalies(spark, said, seconds, terms, kind):
    words = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    fault = one(spark, said, quality.detect_anomaly(F.col("x"), F.lit(seconds), words))
    assert (fault and fault.type) == kind


@pytest.mark.parametrize("raw, want", [("[Música]", ""), ("(risas)", ""), ("...", ""), ("----", ""), ("a", ""), ("Gracias por ver el video", ""), ("Hola mundo [Música] hoy revisamos el plan", "Hola mundo hoy revisamos el plan"), ("Seguimos mañana.", "Seguimos mañana."), (None, "")])
def test_recognised_text(spark, raw, want):
    assert one(spark, raw, text.sanitize_asr(F.col("x"))) == want


def test_aliases(spark):
    swap = lambda x, v: one(spark, x, text.replace_aliases(F.col("x"), v))
    assert swap("Hola arich y ariz, bienvenidos.", [("ariz", "Aritz"), ("arich", "Aritz")]) == "Hola Aritz y Aritz, bienvenidos."
    assert swap("blitz", [("itz", "X")]) == "blitz"
    made = one(spark, "Aritz", text.phonetic_aliases(F.col("x")))
    assert {"Arich", "Ariz"} <= set(made) and "Aritz" not in made and len(made) <= 6
    assert one(spark, " ", text.phonetic_aliases(F.col("x"))) == []


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Se acordó el plan de trabajo para mañana. Luego se", "Se acordó el plan de trabajo para mañana."),
        ("Se acordó el plan debido a la", "Se acordó el plan."),
        ("Todo bien, pero.", "Todo bien."),
        ("Cuesta 5.5 y el dr. Ruiz lo sabe", "Cuesta 5.5 y el dr. Ruiz lo sabe."),
        (" ", " "),
    ],
)
def test_sentences_are_completed(spark, raw, want):
    assert one(spark, raw, minutes.complete_sentences(F.col("x"))) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Resumen: Se revisó el calendario.", "Se revisó el calendario."),
        ("```\nSe revisó el calendario.\n```", "Se revisó el calendario."),
        ('"Ninguno. Se revisó todo ayer."<|im_end|>', "Se revisó todo ayer."),
        ("En esta reunión, se comenta que avanza.\n- Sigue el plan.", "avanza. Sigue el plan."),
        ("Se habló de Acme.", "Se habló ."),
        ("Nada", "antes"),
        (None, "antes"),
    ],
)
def test_summaries(spark, raw, want):
    assert one(spark, raw, minutes.sanitize_summary(F.col("x"), F.lit("antes"), "Acme")) == want


def test_minutes_lose_technical_speakers(spark):
    raw = "# Acta\n## Participantes\n- SPEAKER_00\n## Temas\nSPEAKER_01 propuso algo y luego SPEAKER_00 indicó más.\n| SPEAKER_00 | tarea |\nSegún speaker 1, vale. Speaker-2 sigue."
    got = one(spark, raw, minutes.sanitize_minutes(F.col("x"), F.array(F.lit("Ana")), F.lit(False)))
    assert "- Ana" in got and "Se propuso algo y luego se indicó más." in got and "| Equipo | tarea |" in got and "según se comentó, vale." in got and "un participante sigue" in got
    assert "speaker" not in got.lower()


def test_punctuation(spark):
    df = spark.createDataFrame([(["¿hola", "que", "tal", "bien..", "RAM"], ["0", "0", "?", ".", "."])], "w array<string>, l array<string>")
    assert df.select(minutes.restore_punctuation(F.col("w"), F.col("l"))).first()[0] == "¿Hola que tal? Bien. RAM."
    assert one(spark, "Son 3.14, vale? 1.000.", minutes.clean_punctuation(F.col("x"))) == "Son 3.14, vale 1.000."
    assert spark.range(1).select(minutes.word_windows(F.lit(371)), minutes.word_windows(F.lit(200)), minutes.word_windows(F.lit(0))).first()[:] == ([0, 170, 340], [0], [])


def test_filterbank():
    t = np.arange(16_000) / 16_000
    mel = signal.log_mel(0.3 * np.sin(2 * np.pi * 1000 * t))
    assert mel.shape == (98, 80)
    centre = 700 * (np.exp(np.linspace(*(1127 * np.log(1 + np.array([20.0, 8000.0]) / 700)), 82) / 1127) - 1)[1:-1]
    assert abs(centre[int(np.argmax(mel.mean(axis=0)))] - 1000) < 60
    part = signal.normalised_window(mel, 90, 20)
    assert part.shape == (20, 80) and np.allclose(part[:8].mean(axis=0), 0) and np.allclose(part[8:], -mel[90:].mean(axis=0))
    assert signal.log_mel(np.zeros(399)).shape == (0, 80)


def test_wav():
    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(32_000)
        f.writeframes(np.array([[0, 3276], [3276, 3276]] * 100, "<i2").tobytes())
    assert np.allclose(signal.decode_wav(raw.getvalue()), 1638 / 32768)


def test_a_glossary_is_lowered_once_a_text(spark):
    said, known = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2_000)), lambda i: F.concat(F.lit("no"), i.cast("string"))), " "), F.transform(F.sequence(F.lit(1), F.lit(4_000)), lambda i: F.concat(F.lit("Sí"), i.cast("string")))
    rows = spark.range(3, numPartitions=1).select(said.alias("text"), known.alias("known")).persist()
    rows.count()
    began = time.perf_counter()
    assert [r[0] for r in rows.select(quality.live_anomaly(F.col("text"), F.lit(1e9), F.col("known"))).collect()] == [False] * 3
    # for each of 2,000 words the 4,000 others were lowered anew
    assert time.perf_counter() - began < 2


def test_strip_is_that_of_the_pattern_without_one(spark):
    marks = [chr(i) for i in range(1, 0x3100)] + [" ", "", "﻿", "　\n"]
    rows = spark.createDataFrame([(f"{c}{c}a{c}b{c} ",) for c in marks] + [(c,) for c in marks] + [(None,)], "x string")
    assert rows.filter(~text.strip(F.col("x")).eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp" not in str(text.strip(F.col("x")))


def test_whole_sentences_of_long_pieces_and_mentions_in_any_case(spark):
    long = "palabra " * 500
    assert one(spark, f"{long}fin. Y luego etc.", minutes.whole_sentences(F.col("x"))) == f"{long}fin."
    assert one(spark, f"{long}prof. resto", minutes.whole_sentences(F.col("x"))) == ""
    assert one(spark, "Se presenta el nuevo plan de trabajo para ACME.", minutes.sanitize_summary(F.col("x"), F.lit("antes"), "Acme")) == "Se presenta el nuevo plan de trabajo ."
