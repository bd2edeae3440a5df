"""Minutes in stages against the same steps one by one; aliases in cycles; placeholders and ends of lines."""

import math

import pytest
from pyspark.sql import functions as F

from colloquy.functions import minutes
from colloquy.operators import speakers, stages
from colloquy.operators.folds import chunk

MINUTE = 60_000_000


def transcript(meeting, n):
    return [(meeting, i, "S0", "Ana" if i % 2 else None, f"frase número {i} de la reunión " * (1 + i % 4), i * MINUTE, i * MINUTE + 40_000_000) for i in range(n)]


SCHEMA = "meeting_id string, ord long, speaker_id string, speaker_name string, text string, start_us long, end_us long"


def tokens(text):
    return math.ceil(len(text) / 3.8)


@pytest.mark.parametrize("most", [10, 60, 100_000])
def test_stages_equal_one_step_after_the_other(spark, most):
    sizes = {"short": 2, "long": 31, "longer": 70}
    segments = spark.createDataFrame([r for m, n in sizes.items() for r in transcript(m, n)], SCHEMA)
    meetings = spark.createDataFrame([(m, f"Sobre {m}") for m in [*sizes, "empty"]], "meeting_id string, title string")
    how = {"target_tokens": 120, "target_us": 10 * MINUTE}
    done = stages.minutes_in_stages(meetings, segments, lambda p: F.right(p, F.lit(25)), synthesis_tokens=most, **how).collect()
    got = {(r.meeting_id, r.stage, r.level, r.ord): r for r in done}
    assert len(got) == len(done)
    held = {}
    for r in chunk(segments, **how).orderBy("meeting_id", "chunk", "ord").collect():
        held.setdefault((r.meeting_id, r.chunk), []).append(r.ord)
    want = {}
    for meeting, n in sizes.items():
        chunks = [ords for (m, _), ords in sorted(held.items()) if m == meeting]
        assert (len(chunks) == 1) == (meeting == "short")
        if len(chunks) == 1:
            want[meeting, "full", 0, 0] = None
            continue
        notes = []
        for i, ords in enumerate(chunks):
            row = got[meeting, "chunk", 0, i]
            body = row.prompt.split("Transcripción:\n")[1].split("\n")
            assert len(body) == len(ords) and f"Sobre {meeting} (" in row.prompt and f"fragmento {i + 1}" in row.prompt
            want[meeting, "chunk", 0, i] = None
            notes.append(row.prompt[-25:])
        level = 0
        while len(notes) > 1 or level == 0:
            level += 1
            groups = []
            for note in notes:
                if not groups or (len(groups[-1]) >= 2 and sum(map(tokens, groups[-1])) + tokens(note) > most):
                    groups.append([])
                groups[-1].append(note)
            notes = []
            for i, group in enumerate(groups):
                prompt = f"Reúne las notas.\n\nReunión: Sobre {meeting}\n\nNotas:\n" + "\n".join(group)
                want[meeting, "synthesis", level, i] = prompt
                notes.append(prompt[-25:])
        want[meeting, "draft", level + 1, 0] = f"Redacta el acta con la síntesis.\n\nReunión: Sobre {meeting}\n\nSíntesis:\n{notes[0]}"
    assert set(got) == set(want)
    for key, prompt in want.items():
        assert prompt is None or got[key].prompt == prompt
        assert got[key].prompt_tokens == tokens(got[key].prompt) and got[key].completion_tokens == tokens(got[key].answer)


def test_token_totals_count_stages_without_reasoning(spark):
    used = spark.createDataFrame([("m", 3, 4, None), ("m", 1, None, None), ("n", 5, 5, 2)], "meeting_id string, prompt long, completion long, reasoning long")
    assert sorted(map(tuple, stages.token_totals(used, "meeting_id").collect())) == [("m", 4, 4, 0, 2), ("n", 5, 5, 2, 1)]


def test_aliases_in_a_cycle_become_its_least_id(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("0", "b"), ("x", "y"), ("y", "z"), ("s", "s"), ("q", "s")] + [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(100)]
    done = dict(map(tuple, speakers.resolve_aliases(spark.createDataFrame(links, "id string, target string")).collect()))
    assert {k: done[k] for k in "abc0xysq"} == {"a": "a", "b": "a", "c": "a", "0": "a", "x": "z", "y": "z", "s": "s", "q": "s"}
    assert {done[f"k{i:03d}"] for i in range(100)} == {"k100"}
    assert speakers.resolve_aliases(spark.createDataFrame([], "id string, target string")).count() == 0


@pytest.mark.parametrize(
    ("names", "impersonal", "want"),
    [(["Ana"], False, "- Ana"), ([], False, "- (Sin participantes registrados)"), ([], True, "- (Asistentes a la reunión - identidades individuales no especificadas por modalidad impersonal)")],
)
def test_a_placeholder_is_no_participant(names, impersonal, want):
    for bullet in ("- (Sin participantes registrados)", "- (Asistentes - identidades no especificadas)", "- SPEAKER_00"):
        text = f"# Acta\n## Participantes\n{bullet}\n## Temas\nNada."
        assert want in minutes._clean_minutes(text, names, False, impersonal).split("\n")
    assert "- Eva" in minutes._clean_minutes("## Participantes\n- Eva\n- (Sin participantes registrados)\n## Temas\n", names, False, impersonal)


def test_tail_lines_end_in_any_way(spark):
    text = "\r\n".join(map(str, range(10))) + "\r" + "\n".join(map(str, range(10, 20)))
    assert spark.createDataFrame([(text,)], "t string").select(minutes.tail_lines(F.col("t"), 12)).first()[0] == "\n".join(map(str, range(8, 20)))
