"""What holds of every row of the queries that SQL cannot express, on the small tables."""

from collections import defaultdict
from pathlib import Path

import pytest

import __spark_entry__ as entry
from colloquy.functions.cards import card_fault
from colloquy.plans.derived import frames, segments

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def made(spark):
    held = {}

    def rows(name):
        if name not in held:
            held[name] = entry.queries()[name](spark, SF).collect()
        return held[name]

    return rows


@pytest.fixture(scope="module")
def said(spark):
    out = defaultdict(dict)
    for r in segments(spark, SF).collect():
        out[r.meeting_id][r.ord] = r
    return out


def by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def letters(texts):
    return "".join(c for t in texts for c in t or "" if c.isalnum())


def test_consolidated_segments_hold_all_that_was_said(made, said):
    done = by(made("fold_consolidate"), "meeting_id")
    assert done.keys() == said.keys()
    for m, rows in done.items():
        rows.sort(key=lambda r: r.ord)
        whole = [said[m][o] for o in sorted(said[m])]
        assert letters(r.text for r in rows) == letters(r.text for r in whole)
        assert {r.ord for r in rows} <= set(said[m]) and rows[0].ord == whole[0].ord
        assert all(r.speaker_id == said[m][r.ord].speaker_id and r.start_us == said[m][r.ord].start_us for r in rows)
        assert max(r.end_us for r in rows) == max(r.end_us for r in whole)


def test_chunks_cover_all_segments_and_overlap(made, said):
    for m, rows in by(made("fold_chunk"), "meeting_id").items():
        chunks = by(rows, "chunk")
        assert {r.ord for r in rows} == set(said[m])
        assert sorted(chunks) == list(range(len(chunks)))
        for c in range(1, len(chunks)):
            before, own = {r.ord for r in chunks[c - 1]}, {r.ord for r in chunks[c]}
            assert len(before & own) <= 2 and min(own) > min(before) and max(own) >= max(before)


def test_speech_regions_are_apart_and_in_the_audio(spark, made):
    n = {r.audio_id: r["count"] for r in frames(spark, SF).groupBy("audio_id").count().collect()}
    assert made("fold_vad_regions")
    for audio, rows in by(made("fold_vad_regions"), "audio_id").items():
        rows.sort(key=lambda r: r.start_sample)
        assert all(0 <= r.start_sample < r.end_sample <= n[audio] * 512 and 0 <= r.mean_prob <= 1 for r in rows)
        assert all(a.end_sample <= b.start_sample for a, b in zip(rows, rows[1:]))


def test_split_dialogue_keeps_words_and_times(made, said):
    for m, rows in by(made("jn_split_dialogue"), "meeting_id").items():
        for ord_, parts in by(rows, "ord").items():
            parts.sort(key=lambda r: r.part)
            whole = said[m][ord_]
            assert letters(p.text for p in parts) == letters([whole.text])
            assert parts[0].start_us == whole.start_us and parts[-1].end_us == whole.end_us
            assert all(a.end_us == b.start_us for a, b in zip(parts, parts[1:]))
            assert all(p.speaker in ("SPEAKER_00", "SPEAKER_01") for p in parts)


def test_identities_go_to_one_speaker_each(made):
    rows = made("jn_identity_transfer")
    assert rows and len({(r.meeting_id, r.new_speaker) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["ml_ahc", "ml_vbx", "ml_kmeans", "ml_plda"])
def test_every_vector_has_one_cluster(spark, made, name):
    rows = made(name)
    assert len({r.vec_id for r in rows}) == len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    for own in by(rows, "meeting_id").values():
        assert all(0 <= r.cluster < len(own) for r in own)


def test_assigned_dimensions_differ_within_a_meeting(made):
    for own in by(made("ml_hungarian"), "meeting_id").values():
        assert len({r.cluster for r in own}) == len(own)


def test_mixed_chunks_are_numbered_and_bounded(spark, made):
    users = {str(r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().collect()}
    done = by(made("st_two_stream_mix"), "meeting_id")
    assert done.keys() <= users and done
    for rows in done.values():
        assert sorted(r.chunk for r in rows) == list(range(len(rows)))
        assert all((r.dominant == "mic") == (r.mic_rms >= r.sys_rms) for r in rows)


@pytest.mark.parametrize("name", ["st_card_emit", "st_finalize"])
def test_cards_follow_one_another_and_pass_their_checks(made, said, name):
    assert made(name)
    for m, cards in by(made(name), "meeting_id").items():
        cards.sort(key=lambda r: r.card)
        own, previous, end = [said[int(m)][o] for o in sorted(said[int(m)])], None, 0
        for i, c in enumerate(cards):
            assert c.card == i and c.start_us == end < c.end_us
            window = " ".join(s.text for s in own if s.text and s.text.strip() and end < s.end_us <= c.end_us)
            assert card_fault(c.text, window, previous, end, c.end_us, end) is None
            previous, end = c.text, c.end_us


def test_card_counts_are_those_of_the_cards(made):
    cards = by(made("st_card_emit"), "meeting_id")
    assert {r.meeting_id: (r.cards, r.upto) for r in made("st_card_trigger")} == {m: (len(c), max(x.end_us for x in c)) for m, c in cards.items()}


def test_whole_texts_reach_sentences_and_minutes(spark, made):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in made("str_complete_sentence"):
        if texts[r.doc_id] and texts[r.doc_id].strip():
            assert letters([texts[r.doc_id]]).startswith(letters([r.text])) and (not r.text or r.text[-1] in '.!?"»)')
    assert all("SPEAKER" not in r.text for r in made("str_sanitize_minutes"))
    assert max(len(r.text or "") for r in made("str_sanitize_summary")) > 1000
