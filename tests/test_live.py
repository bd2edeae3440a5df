"""Live operators: over tables, and the same on a stream in several micro-batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.functions import quality
from colloquy.functions.cards import card_fault
from colloquy.streaming import live

S = 1_000_000


def segment(seq, said, start, end, speaker="A", name="", seg_id=None, meeting="m"):
    return (meeting, seq, seg_id or f"s{seq}", speaker, name, said, int(start * S), int(end * S))


SCHEMA = "meeting_id string, seq long, seg_id string, speaker_id string, speaker_name string, text string, start_us long, end_us long"


def test_transcript_merges_and_resolves(spark):
    rows = [segment(0, "Hola a todos,", 0, 4, "SPEAKER_00", "Ana"), segment(1, "vamos a empezar.", 4.4, 8, "X9", "ana"), segment(2, "Sí.", 8.1, 9, "SPEAKER_01"), segment(3, "Bien.", 20, 21, "x9", "")]
    done = live.run(spark.createDataFrame(rows[::-1], SCHEMA), "meeting_id", live.Transcript()).collect()
    assert [(r.change, r.seg_id, r.speaker_id, r.speaker_name) for r in done] == [("appended", "s0", "SPEAKER_00", "Ana"), ("updated", "s0", "SPEAKER_00", "Ana"), ("appended", "s2", "SPEAKER_01", "SPEAKER_01"), ("appended", "s3", "SPEAKER_00", "Ana")]
    assert done[1].text == "Hola a todos, vamos a empezar."


WORDS = "alfa beta gamma delta epsilon zeta eta theta iota kappa lambda mi ni xi omicron"


def test_cards_wait_for_time_and_words(spark):
    rows = [segment(0, WORDS, 0, 20), segment(1, WORDS, 20, 44), segment(2, "uno", 44, 46), segment(3, WORDS, 46, 80), segment(4, "tarde", 1, 30), segment(5, "otra vez dos tres cuatro cinco seis siete ocho nueve", 80, 95)]
    stop = ("m", 6, "stop", None, None, None, None, None)
    done = live.run(spark.createDataFrame([*rows, stop], SCHEMA), "meeting_id", live.Cards()).collect()
    assert [(r.card, r.start_us // S, r.end_us // S) for r in done] == [(0, 0, 46), (1, 46, 95)]


def test_card_with_a_loop_is_asked_for_again(spark):
    rows = [segment(0, WORDS + " " + WORDS, 0, 50)]
    check = lambda card, *_: "DegenerativeLoop" if card == "bad" else None
    done = live.run(spark.createDataFrame(rows, SCHEMA), "meeting_id", live.Cards(lambda window, again: "good" if again else "bad", check)).collect()
    assert [r.text for r in done] == ["good"]
    never = live.Cards(lambda window, again: "bad", lambda card, *_: "SemanticDisconnect")
    assert live.run(spark.createDataFrame(rows, SCHEMA), "meeting_id", never).collect() == []


def test_cards_are_checked_as_the_columns_are(spark):
    good = "El equipo acuerda revisar el presupuesto del proyecto durante la próxima semana."
    cards = [
        (good, "Se habla del presupuesto del proyecto y de quién lo va a revisar la semana que viene.", None, 0, 9, 0),
        (good, "otra cosa distinta totalmente sobre viajes familiares vacaciones montañas playas", None, 0, 9, 0),
        (good, good, None, 9, 9, 0), (good, good, None, 0, 5, 7), (good, good, good, 0, 9, 0), ("  ", good, None, 0, 9, 0), ("corto", good, None, 0, 9, 0), (None, good, None, 0, 9, 0),
        ("Revisar el presupuesto ya. Revisar el presupuesto ya.", good, None, 0, 9, 0),
        ("se dice que se dice que se dice que nada", good, None, 0, 9, 0),
        ("uno dos tres cuatro uno dos tres cuatro x uno dos tres cuatro", good, None, 0, 9, 0),
        ("El equipo revisa el presupuesto anual del proyecto nuevo. El equipo también revisa el presupuesto anual del proyecto nuevo. Nada más se comenta hoy aquí por ahora en la sala.", good, None, 0, 9, 0),
        (" ".join(f"palabra{i}" for i in range(97)) + ".", good, None, 0, 9, 0),
    ]
    schema = "card string, heard string, previous string, start_us long, end_us long, upto long"
    reason = quality.validate_card(*map(F.col, ("card", "heard", "previous", "start_us", "end_us", "upto")))
    want = [r.reason for r in spark.createDataFrame(cards, schema).select(reason.alias("reason")).collect()]
    assert [card_fault(*c) for c in cards] == want
    assert {None, "SemanticDisconnect", "InvalidTimeRange", "DuplicateOfPreviousCard", "EmptyOrTooShort", "RepeatedSentence", "DegenerativeLoop", "SentenceDominance", "ExcessiveLength"} == set(want)


def test_speech_sessions(spark):
    probs = [0.9] * 3 + [0.4] * 50 + [0.1] * 41 + [0.9] + [0.1] * 60
    rows = [("m", i, p) for i, p in enumerate(probs)]
    done = live.run(spark.createDataFrame(rows, "meeting_id string, seq long, prob double"), "meeting_id", live.SpeechSessions()).collect()
    # the first silence is one frame too short; speech then starts it anew
    assert [(r.event, r.sample // 512) for r in done] == [("start", 1), ("end", 3 + 50 + 41 + 1 + 1 + 41)]


def test_utterances(spark):
    chunk = lambda i, loud, event="": ("m", i, 1600, loud, loud, 0.0, event)
    rows = [chunk(i, 0.1) for i in range(5)] + [chunk(5, 0.1, "start")] + [chunk(i, 0.1) for i in range(6, 15)] + [chunk(15, 0.1, "end")]
    schema = "meeting_id string, seq long, n_samples long, rms double, mic_rms double, sys_rms double, event string"
    done = live.run(spark.createDataFrame(rows, schema), "meeting_id", live.Utterances()).collect()
    assert [(r.start_us, r.end_us, r.n_samples, r.mic_only) for r in done] == [(300_000, 1_600_000, 12 * 1600, True)]
    long = [chunk(0, 0.1, "start")] + [chunk(i, 0.1) for i in range(1, 160)]
    assert [(r.start_us, r.end_us) for r in live.run(spark.createDataFrame(long, schema), "meeting_id", live.Utterances()).collect()] == [(0, 15_000_000)]


def test_mixer(spark):
    schema = "meeting_id string, seq long, source string, samples array<double>"
    rows = [("m", 0, "mic", [0.5] * 2000), ("m", 1, "sys", [0.6] * 1600), ("m", 2, "mic", [0.1] * 4700), ("m", 3, "flush", [])]
    done = live.run(spark.createDataFrame(rows, schema), "meeting_id", live.Mixer()).collect()
    assert [(r.chunk, r.dominant) for r in done] == [(0, "sys"), (1, "mic"), (2, "mic")]
    assert max(done[0].samples) < 1 and done[0].samples[0] > 0.99 and done[1].samples[0] == 0.5 and done[1].samples[400] == pytest.approx(0.1)


def test_stream_keeps_its_state_between_batches(spark, tmp_path):
    batches = [[segment(0, "Hola a todos,", 0, 4)], [segment(1, "vamos a empezar.", 4.4, 8)], [segment(2, "Fin.", 20, 21)]]
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).to_json(tmp_path / f"{i}.json", orient="records", lines=True)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    name = "live_changes"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = live.run(stream, "meeting_id", live.Transcript()).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.change, r.text) for r in spark.table(name).collect()) == [("appended", "Fin."), ("appended", "Hola a todos,"), ("updated", "Hola a todos, vamos a empezar.")]


def test_live_segments_are_cleaned(spark):
    rows = [segment(0, "Hola arich", 0, 4), segment(1, "[Música]", 4, 5), segment(2, "a b c d e f g h", 5, 5.5)]
    done = live.clean_live(spark.createDataFrame(rows, SCHEMA), [("arich", "Aritz")]).collect()
    assert [(r.text, r.speaker_id) for r in done] == [("Hola Aritz", "")]


def test_timed_cards_come_at_ticks_between_segments(spark):
    rows = [segment(0, WORDS, 0, 20), segment(1, WORDS, 20, 32), segment(2, "uno", 100, 101), segment(3, WORDS + " dos tres", 101, 118), segment(4, "cuatro cinco seis siete ocho nueve diez once doce trece", 118, 121)]
    done = live.run(spark.createDataFrame(rows, SCHEMA), "meeting_id", live.TimedCards()).collect()
    # asked for at the tick of 45 s, before the next segment; the second at 118 + what is new
    assert [(r.card, r.start_us // S, r.end_us // S) for r in done] == [(0, 0, 32), (1, 32, 121)]
    assert done[0].text.startswith("alfa beta")


def test_nothing_is_tried_while_a_card_is_made(spark):
    def model(window, again):
        return " ".join(window.split()[:12]) + "."

    rows = [segment(0, WORDS + " " + " ".join(f"w{i}" for i in range(20)), 0, 46), segment(1, "tarde " + " ".join(f"x{i}" for i in range(40)), 46, 60), segment(2, "fin", 60, 63), segment(3, "fin", 63, 130)]
    slow = live.TimedCards(model, lambda *_: None, latency_us=16 * S)
    done = live.run(spark.createDataFrame(rows, SCHEMA), "meeting_id", slow).collect()
    assert [(r.start_us // S, r.end_us // S) for r in done] == [(0, 46), (46, 63)]


def test_a_card_of_an_old_session_never_comes(spark):
    start = ("m", 1, "start", None, None, None, None, None)
    rows = [segment(0, WORDS + " " + WORDS, 0, 50), start, segment(2, "hola", 0, 70)]
    slow = live.TimedCards(latency_us=10 * S)
    assert live.run(spark.createDataFrame(rows, SCHEMA), "meeting_id", slow).collect() == []
    kept = live.run(spark.createDataFrame([rows[0], segment(2, "hola", 50, 70)], SCHEMA), "meeting_id", slow).collect()
    assert [(r.card, r.end_us // S) for r in kept] == [(0, 50)]


def _rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _files(path, batches, names):
    path.mkdir()
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=names).to_json(path / f"{i}.json", orient="records", lines=True, date_format="iso")


def test_cards_and_the_end_come_by_timers_without_new_rows(spark, tmp_path):
    import time

    _rocks(spark)
    _files(tmp_path / "in", [[segment(0, WORDS + " " + WORDS, 0, 3), segment(1, "uno dos tres cuatro cinco seis siete ocho nueve diez", 3, 5, meeting="short")]], [c.split()[0] for c in SCHEMA.split(", ")])
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    by_clock = live.TimedCards(check=lambda *_: None, first_us=2 * S, tick_us=S, wall=True, idle_us=5 * S)
    query = live.run(stream, "meeting_id", by_clock, time="ProcessingTime").writeStream.format("memory").queryName("timed_cards").outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("timed_cards").count() < 2:
            time.sleep(1)
        done = {r.meeting_id: (r.card, r.end_us // S) for r in spark.table("timed_cards").collect()}
        ticks = [p for p in query.recentProgress if p["numInputRows"] > 0]
    finally:
        query.stop()
    # the first came by a tick; the other one has too few words for that and came when its meeting had been silent
    assert done == {"m": (0, 3), "short": (0, 5)} and len(ticks) == 1


def test_segments_are_updated_by_id_within_and_across_batches(spark, tmp_path):
    _rocks(spark)
    row = lambda seq, seg, said: ("m", seq, seg, said, seq * S, (seq + 1) * S)
    names = ["meeting_id", "seq", "seg_id", "text", "start_us", "end_us"]
    _files(tmp_path / "in", [[row(0, "a", "hola"), row(1, "b", "uno"), row(2, "a", "hola a todos")], [row(3, "b", "dos"), row(4, "c", "tres")]], names)
    schema = "meeting_id string, seq long, seg_id string, text string, start_us long, end_us long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    live.run(stream, "meeting_id", live.Segments()).writeStream.format("memory").queryName("upserts").outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination(120)
    want = [(0, "a", "appended", 0, "hola"), (1, "b", "appended", 0, "uno"), (2, "a", "updated", 1, "hola a todos"), (3, "b", "updated", 1, "dos"), (4, "c", "appended", 0, "tres")]
    assert sorted((r.seq, r.seg_id, r.change, r.version, r.text) for r in spark.table("upserts").collect()) == want


def test_a_batch_reads_and_writes_each_segment_once():
    calls, kept = [], {}

    class Held:
        exists = lambda self: bool(kept)
        containsKey = lambda self, k: calls.append("contains") or k in kept
        getValue = lambda self, k: calls.append("get") or kept[k]
        updateValue = lambda self, k, v: calls.append("update") or kept.update({k: v})

    work = live.Segments()
    work.segments = Held()
    rows = lambda ids: pd.DataFrame({"seq": range(len(ids)), "seg_id": ids, "text": [f"t{i}" for i in range(len(ids))], "start_us": 0, "end_us": 1})
    first = pd.concat(work.handleInputRows(("m",), iter([rows(["a", "b"] * 50)]), None))
    assert calls == ["update"] * 2 and first["version"].tolist() == [i // 2 for i in range(100)] and kept[("a",)] == (49, "t98", 0, 1)
    then = pd.concat(work.handleInputRows(("m",), iter([rows(["b", "c", "b"])]), None))
    assert then["version"].tolist() == [50, 0, 51] and then["change"].tolist() == ["updated", "appended", "updated"] and len(calls) == 7


def test_late_segments_go_to_the_side_and_state_is_forgotten(spark, tmp_path):
    _rocks(spark)
    at = lambda seq, seg, end, meeting="m": (meeting, seq, seg, end * S, pd.Timestamp(end, unit="s").isoformat())
    names = ["meeting_id", "seq", "seg_id", "end_us", "at"]
    batches = [[at(0, "a", 100), at(1, "b", 95), at(2, "c", 80)], [at(3, "d", 85), at(4, "e", 130)], [at(9, "x", 4000, "other")], [at(10, "y", 4001, "other")], [at(5, "f", 3990), at(11, "z", 1, "other")]]
    _files(tmp_path / "in", batches, names)
    stream = spark.readStream.schema("meeting_id string, seq long, seg_id string, end_us long, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withWatermark("at", "60 seconds")
    out = live.run(stream, "meeting_id", live.Arrivals(10 * S, 60 * S), time="EventTime")
    query = out.writeStream.format("memory").queryName("arrivals").outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    timely, late = live.on_time(spark.table("arrivals"))
    assert sorted(r.seg_id for r in late.collect()) == ["c", "d"]
    # the first meeting's state is gone by the time of f, and z is older than the watermark
    assert sorted(r.seg_id for r in timely.collect()) == ["a", "b", "e", "f", "x", "y"]
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 1


def test_mixer_equals_lists_of_samples_in_any_batches():
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [("flush" if i % 17 == 16 else str(rng.choice(["mic", "sys"])), rng.uniform(-0.9, 0.9, int(rng.integers(0, 2500)))) for i in range(80)]
    mic, sys, want = [], [], []

    def send():
        a, b = (np.array((q[:1600] + [0.0] * 1600)[:1600]) for q in (mic, sys))
        del mic[:1600], sys[:1600]
        both = a + b
        both = np.where(np.abs(both) > 0.9, np.sign(both) * (0.9 + 0.1 * np.tanh((np.abs(both) - 0.9) / 0.1)), both)
        want.append((len(want), np.clip(both, -1, 1), (a * a).mean() ** 0.5, (b * b).mean() ** 0.5))

    for source, samples in rows:
        if source != "flush":
            (mic if source == "mic" else sys).extend(samples.tolist())
        while min(len(mic), len(sys)) >= 1600 or max(len(mic), len(sys)) >= 4800:
            send()
        if source == "flush" and (mic or sys):
            send()
    for size in (1, 7, 80):
        mixer, state, got = live.Mixer(), live.Mixer().first(), []
        for i in range(0, len(rows), size):
            part = pd.DataFrame(rows[i : i + size], columns=["source", "samples"])
            state, made = mixer.step(state, part)
            got += made
        assert len(got) == len(want) > 20
        for g, w in zip(got, want):
            assert g[0] == w[0] and np.allclose(g[1], w[1]) and g[2] == ("mic" if w[2] >= w[3] else "sys") and np.isclose(g[3], w[2]) and np.isclose(g[4], w[3])


def test_mixed_levels_are_those_of_the_mixer():
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"source": rng.choice(["mic", "sys"], 40), "samples": [np.full(800, v) for v in rng.uniform(-1, 1, 40)]})
    whole, short = live.Mixer(), live.MixedLevels()
    (state, made), (same, levels) = whole.step(whole.first(), rows), short.step(short.first(), rows)
    assert made and same == state and levels == [(n, *rest) for n, _, *rest in made]


def test_mixed_events_are_dealt_out_before_they_get_samples(spark, tmp_path, capsys):
    from colloquy.plans.ordered import st_two_stream_mix

    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, id % 3 AS user_id, 100.0D AS value FROM range(12)").write.parquet(f"{tmp_path}/events.parquet")
    done = st_two_stream_mix(spark, str(tmp_path))
    done.explain(mode="formatted")
    shown = capsys.readouterr().out.split("\n\n")
    dealt = [s for s in shown if ") Exchange\n" in s]
    assert len(dealt) == 1 and "samples" not in dealt[0]
    assert sorted(tuple(r) for r in done.collect()) == [(str(u), 0, "mic", 0.1, 0.1) for u in range(3)]


def test_mixed_events_are_flushed_and_handed_on_with_their_samples(spark, tmp_path, monkeypatch):
    from colloquy.plans.ordered import st_two_stream_mix

    handed, run = [], live.run
    monkeypatch.setattr(live, "run", lambda *a, **k: handed.append(run(*a, **k)) or handed[-1])
    # of the first user three events, of the second one, of the third seven of the microphone; a flush sends one last chunk
    rows = [(0, 0), (1, 0), (2, 0), (5, 1)] + [(i, 2) for i in range(6, 20, 2)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long").selectExpr("event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "user_id", "600.0D AS value")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    done = sorted(tuple(r) for r in st_two_stream_mix(spark, str(tmp_path)).collect())
    half = round(0.6 / 2**0.5, 6)
    assert done == [("0", 0, "mic", 0.6, half), ("1", 0, "sys", 0.0, half), ("2", 0, "mic", 0.6, 0.0), ("2", 1, "mic", 0.6, 0.0)]
    mixed = {(r.meeting_id, r.chunk): r.samples for r in handed[0].collect()}
    assert len(mixed) == 4 and {len(x) for x in mixed.values()} == {1600}
    assert 0.9 < mixed["0", 0][0] < 1 and mixed["0", 0][-1] == mixed["2", 0][0] == 0.6
