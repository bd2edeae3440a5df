"""Folds, joins over time, clustering and speakers, on the literal cases they must give."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.operators import catalog, clustering, folds, speakers, timeline

S = 1_000_000
SEGMENTS = "meeting_id long, ord long, speaker_id string, speaker_name string, text string, start_us long, end_us long"
SPANS = "meeting_id long, ord long, speaker_id string, start_us long, end_us long"


def segments(spark, rows):
    return spark.createDataFrame([(1, i, spk, name, text, int(a * S), int(b * S)) for i, (spk, name, text, a, b) in enumerate(rows)], SEGMENTS)


def spans(spark, rows):
    return spark.createDataFrame([(1, i, spk, int(a * S), int(b * S)) for i, (spk, a, b) in enumerate(rows)], SPANS)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("A", "A", "Hola a todos,", 0, 4), ("A", "A", "vamos a empezar la reunión.", 4.4, 8)], [("Hola a todos, vamos a empezar la reunión.", 8)]),
        ([("A", "A", "Frase completa.", 0, 4), ("A", "A", "Otra frase.", 8, 9)], [("Frase completa.", 4), ("Otra frase.", 9)]),
        ([("A", "A", "Hola.", 0, 4), ("B", "B", "Adiós.", 4.1, 5)], [("Hola.", 4), ("Adiós.", 5)]),
        ([("", "", "Vino de.", 0, 4), (None, "", "la casa", 3, 3.5)], [("Vino de la casa", 4)]),
        ([("A", "A", "w " * 89 + "w.", 0, 4), ("A", "A", "Otra.", 4, 5)], [(("w " * 89 + "w."), 4), ("Otra.", 5)]),
        ([("A", "A", " ", 0, 1), ("A", "A", "Hola.", 1, 2)], [(" ", 1), ("Hola.", 2)]),
    ],
)
def test_consolidate(spark, rows, want):
    done = folds.consolidate(segments(spark, rows)).orderBy("ord").collect()
    assert [(r.text, r.end_us / S) for r in done] == want


def test_chunks_cover_long_meetings_with_overlap(spark):
    rows = [("A", "A", f"Tema {i}. " * 6, i * 144, i * 144 + 140) for i in range(50)]
    done = folds.chunk(segments(spark, rows), target_tokens=500).collect()
    by = {}
    for r in done:
        by.setdefault(r.chunk, []).append(r.ord)
    assert len(by) >= 3 and set(itertools.chain(*by.values())) == set(range(50)) and min(by[0]) == 0
    assert all(min(by[c + 1]) == max(by[c]) - 1 for c in range(len(by) - 1))
    assert {r.chunk for r in folds.chunk(segments(spark, rows[:3])).collect()} == {0}


def test_speech_regions(spark):
    probs = [0.1] * 20 + [0.9] * 30 + [0.4] * 60 + [0.1] * 30 + [0.9] * 4 + [0.1] * 40
    frames = spark.createDataFrame([(1, i, p) for i, p in enumerate(probs)], "audio_id long, frame long, prob double")
    done = folds.speech_regions(frames).collect()
    # the middle band does not end speech; four frames are too short for a region
    assert [(r.start_sample, r.end_sample) for r in done] == [(20 * 512 - 800, 110 * 512 + 800)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.1, 0.4, 0.6, 0.9]), st.integers(1, 60)), min_size=1, max_size=40))
def test_speech_regions_do_not_overlap_nor_last_too_long(spark, runs):
    probs = [p for p, n in runs for _ in range(n)]
    frames = spark.createDataFrame([(1, i, p) for i, p in enumerate(probs)], "audio_id long, frame long, prob double").coalesce(1)
    done = folds.speech_regions(frames).orderBy("start_sample").collect()
    assert all(0 <= r.start_sample < r.end_sample <= len(probs) * 512 and r.end_sample - r.start_sample <= 20.2 * 16000 for r in done)
    assert all(a.end_sample <= b.start_sample for a, b in zip(done, done[1:]))


def test_alignment(spark):
    s = segments(spark, [("", "", "uno", 0, 4), ("", "", "dos", 5, 9), ("", "", "tres", 9.5, 10), ("", "", "cuatro", 30, 31)])
    done = folds.align(s, spans(spark, [("S0", 0, 4.5), ("S1", 4.8, 9.2)])).orderBy("ord").collect()
    assert [r.speaker for r in done] == ["S0", "S1", "S1", "S1"]


def test_dialogue_is_split(spark):
    s = segments(spark, [("", "", "-Yo no puedo con tres. -¿Un tres? Yo le voy a poner un cinco.", 0, 10)])
    done = folds.align(s, spans(spark, [("S0", 0, 4), ("S1", 4, 10)])).orderBy("part").collect()
    assert [(r.speaker, r.text) for r in done] == [("S0", "Yo no puedo con tres."), ("S1", "¿Un tres? Yo le voy a poner un cinco.")]
    assert done[0].end_us == done[1].start_us and done[1].end_us == 10 * S
    assert folds.align(s, spans(spark, []), split=False).first().speaker == "SPEAKER_00"


def people(spark, rows):
    return spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(rows)], "meeting_id long, ord long, speaker_id string, display_name string")


def centroids(spark, rows):
    return spark.createDataFrame([(1, a, v) for a, v in rows], "meeting_id long, speaker_id string, vector array<double>")


def test_names_follow_the_voice(spark):
    s = segments(spark, [("SPEAKER_00", "Ana", "a", 0, 5), ("SPEAKER_01", "Luis", "b", 5, 10)])
    p = people(spark, [("SPEAKER_00", "Ana"), ("SPEAKER_01", "Luis"), ("SPEAKER_02", "SPEAKER_02")])
    old = centroids(spark, [("SPEAKER_00", [1.0, 0.0, 0.0, 0.0]), ("SPEAKER_01", [0.0, 1.0, 0.0, 0.0])])
    new = centroids(spark, [("SPEAKER_00", [0.0, 0.98, 0.0, 0.0]), ("SPEAKER_01", [0.99, 0.0, 0.0, 0.0])])
    x = spans(spark, [("SPEAKER_01", 0, 5), ("SPEAKER_00", 5, 10)])
    scores = catalog.identity_scores(s, x, p, old, new)
    assert {(r.new_speaker, r.name) for r in folds.transfer_identities(scores).collect()} == {("SPEAKER_01", "Ana"), ("SPEAKER_00", "Luis")}
    far = catalog.identity_scores(s, spans(spark, [("SPEAKER_00", 20, 25)]), p, old, centroids(spark, [("SPEAKER_00", [0.0, 0.0, 0.0, 1.0])]))
    assert folds.transfer_identities(far).collect() == []


def test_active_segment(spark):
    s = segments(spark, [("", "", "", 0, 5), ("", "", "", 10, 15), ("", "", "", 20, 20)])
    pos = spark.createDataFrame([(1, p * S) for p in (2, 7, 12, 22, 23)], "meeting_id long, pos_us long")
    assert [(r.pos_us // S, r.ord) for r in timeline.as_of(pos, s).orderBy("pos_us").collect()] == [(2, 0), (7, None), (12, 1), (22, 2), (23, None)]


def test_smoothing(spark):
    done = timeline.smooth_merge(spans(spark, [("S0", 0, 2), ("S1", 2.05, 2.15), ("S0", 2.35, 5), ("S1", 6, 9)]), 300_000, 500_000)
    assert [(r.speaker_id, r.start_us / S, r.end_us / S) for r in done.orderBy("start_us").collect()] == [("S0", 0, 5), ("S1", 6, 9)]


def test_overlaps_find_every_pair_once(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [("S", a, a + d) for a, d in zip(rng.uniform(0, 60, n).round(2), rng.uniform(0.1, 30, n).round(2))]
    a, b = make(40), make(30)
    done = timeline.overlaps(spans(spark, a), spans(spark, b)).select("ord", "b_ord").collect()
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if min(x[2], y[2]) > max(x[1], y[1])}
    assert len(done) == len(want) and {tuple(r) for r in done} == want


def test_linkage():
    x = clustering.unit_rows(np.array([(1, 0, 0), (0.99, 0.01, 0), (0, 1, 0), (0.01, 0.99, 0)]))
    assert clustering.agglomerate(x, 0.6).tolist() == [0, 0, 1, 1]
    assert clustering.agglomerate(x, 0.0).tolist() == [0, 1, 2, 3] and clustering.agglomerate(x[:0]).tolist() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_the_best_of_all(rows, columns, seed):
    m = np.random.default_rng(seed).integers(-9, 20, (rows, columns)).astype(float)
    got = clustering.assign_best(m)
    used = [c for c in got if c >= 0]
    assert len(used) == len(set(used)) == min(rows, columns)
    if rows <= columns:
        best = max(sum(m[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(columns), rows))
    else:
        best = max(sum(m[r, i] for i, r in enumerate(p)) for p in itertools.permutations(range(rows), columns))
    assert sum(m[i, c] for i, c in enumerate(got) if c >= 0) == pytest.approx(best)


def test_assignment_cases():
    assert clustering.assign_best(np.array([[10.0, 2, 3], [5, 15, 2], [1, 4, 20]])).tolist() == [0, 1, 2]
    assert clustering.assign_local(np.eye(3), np.array([1.0, 1.0, 0.0]), np.eye(3)[[1, 0]]).tolist() == [1, 0, -1]


def test_speakers_are_told_apart():
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.05 * rng.normal(size=(20, 8)) for c in np.eye(8)[:3]])
    labels = clustering.speakers(x)
    assert len(set(labels)) == 3 and all(len(set(labels[i * 20 : i * 20 + 20])) == 1 for i in range(3))
    assert len(set(clustering.speakers(x, wanted=2))) == 2
    assert clustering.k_means(x[:2], 5).shape == (2, 8)


def test_plda_file():
    parts = [np.zeros(256), np.zeros(128, "<f4"), np.eye(256, 128, dtype="<f4"), np.zeros(128), np.eye(128), np.ones(128)]
    plda = clustering.Plda.read(b"PLDA2.0\0" + b"".join(p.tobytes() for p in parts))
    y = plda.project(np.random.default_rng(0).normal(size=(4, 256)))
    assert np.allclose((y**2).sum(axis=1), 128)
    with pytest.raises(ValueError):
        clustering.Plda.read(b"nothing!")


def test_rename_merges_speakers(spark):
    s = segments(spark, [("SPEAKER_00", "Aritz", "a", 0, 1), ("SPEAKER_01", "SPEAKER_01", "b", 1, 2)])
    p = people(spark, [("SPEAKER_00", "Aritz"), ("SPEAKER_01", "SPEAKER_01")])
    wish = lambda name: spark.createDataFrame([(1, "speaker_01", name)], "meeting_id long, speaker_id string, new_name string")
    out, left = speakers.rename(s, p, wish(" ARITZ "))
    assert {(r.speaker_id, r.speaker_name) for r in out.collect()} == {("SPEAKER_00", "Aritz")} and left.count() == 1
    out, left = speakers.rename(s, p, wish("Luis"))
    assert [r.speaker_name for r in out.orderBy("ord").collect()] == ["Aritz", "Luis"] and {r.display_name for r in left.collect()} == {"Aritz", "Luis"}


def test_vocabularies_unite(spark):
    make = lambda rows: spark.createDataFrame([(i, w, a) for i, (w, a) in enumerate(rows)], "ord int, word string, aliases array<string>")
    mine, theirs = make([("Aritz", ["Arich"])]), make([("ARITZ", ["ariz", "arich"]), ("Docker", None), (" ", [])])
    assert [(r.word, r.aliases) for r in catalog.merge_vocabulary(mine, theirs).orderBy("ord").collect()] == [("Aritz", ["Arich", "ariz"]), ("Docker", [])]
    assert [(r.word, r.aliases) for r in catalog.upsert_vocabulary(mine, theirs).orderBy("ord").collect()] == [("ARITZ", ["ariz", "arich"]), ("Docker", [])]


def test_edits_of_minutes(spark):
    v = spark.createDataFrame([(1, "a", "uno", None, None), (1, "b", "dos", None, None)], "meeting_id long, version_id string, markdown string, original string, modified long")
    edit = lambda text, at: spark.createDataFrame([(1, "a", text, at)], "meeting_id long, version_id string, markdown string, at long")
    once = catalog.edit_minutes(v, edit("otro", 5))
    assert {(r.version_id, r.markdown, r.can_restore) for r in once.collect()} == {("a", "otro", True), ("b", "dos", False)}
    back = catalog.edit_minutes(once.drop("can_restore"), edit(None, 6))
    assert {(r.version_id, r.markdown, r.can_restore) for r in back.collect()} == {("a", "uno", False), ("b", "dos", False)}
