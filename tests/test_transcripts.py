"""Parsers, exports and their round trips."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.sinks import exports
from colloquy.sources import meetings, transcripts

SRT = "1\n00:00:01,000 --> 00:00:04,000\nHola a todos.\n\n2\n00:00:05,000 --> 00:00:08,500\n[SPEAKER_00] Buenos días.\nSeguimos.\n\n3\n00:00:09,000 --> 00:00:10,000\n\n"
VTT = "WEBVTT\n\n00:01.000 --> 00:04.000\n<v Ana>Hola\n\n01:00:05.000 --> 01:00:08.000\n[Luis] Adiós\n"
LINES = "[00:01:02] Ana: Hola\n[00:01:05] SPEAKER_01: Sí,\nclaro\n[00:02:00] Luis:\nya"
MARKDOWN = "# Acta\n\n### 00:01:23 — Aritz\n\nHola.\nSeguimos.\n\n### 00:01:25 — Nadie\n\n### 00:01:27 — María\n# nota\nVale.\n"
PLAIN = "Uno\ndos\n\n\nTres\n"
S = 1_000_000


def rows(spark, parse, content):
    df = spark.createDataFrame([(content,)], "content string")
    return [(r.start_us / S, r.end_us / S, r.speaker, r.text) for r in transcripts.exploded(df, parse(F.col("content"))).orderBy("ord").collect()]


CASES = {
    "srt": (SRT, [(1, 4, "", "Hola a todos."), (5, 8.5, "SPEAKER_00", "Buenos días. Seguimos.")]),
    "vtt": (VTT, [(1, 4, "", "Hola"), (3605, 3608, "Luis", "Adiós")]),
    "lines": (LINES, [(62, 65, "Ana", "Hola"), (65, 120, "SPEAKER_01", "Sí,"), (120, 125, "Luis", "ya")]),
    "markdown": (MARKDOWN, [(83, 85, "Aritz", "Hola. Seguimos."), (87, 92, "María", "Vale.")]),
    "plain": (PLAIN, [(0, 5, "", "Uno\ndos"), (5, 10, "", "Tres")]),
}


@pytest.mark.parametrize("name", CASES)
def test_each_format_is_found_by_its_content(spark, name):
    content, want = CASES[name]
    assert rows(spark, transcripts.parse_any, content) == want
    assert rows(spark, transcripts.parse_any, content.replace("\n", "\r\n")) == [(a, b, c, t.replace("\n", "\r\n")) for a, b, c, t in want]


def test_blank_contents_have_no_segments(spark):
    for content in (None, "", " \n\t"):
        assert rows(spark, transcripts.parse_any, content) == []


def test_files_are_read_by_their_content(spark, tmp_path):
    for name, (content, _) in CASES.items():
        (tmp_path / f"{name}.txt").write_text(content)
    found = {r.path.rsplit("/", 1)[1]: r.n for r in transcripts.read_transcripts(spark, str(tmp_path)).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert found == {f"{name}.txt": len(want) for name, (_, want) in CASES.items()}


@pytest.mark.parametrize("name, audio, text", [(".MP3", True, False), ("wav", True, False), ("a.b/c.srt", False, True), ("VTT", False, True), ("x.exe", False, False), ("", False, False), (None, False, False)])
def test_supported_formats(spark, name, audio, text):
    r = spark.createDataFrame([(name,)], "n string").select(transcripts.supported(F.col("n"), transcripts.AUDIO_FORMATS), transcripts.supported(F.col("n"), transcripts.TEXT_FORMATS)).first()
    assert tuple(r) == (audio, text)


@pytest.fixture(scope="module")
def meeting(spark):
    m = spark.createDataFrame([(1, "Plan: hoy", "2024-05-06", None, 3_725 * S, "Ana", None, None, None), (2, "Vacía", "2024-05-07", None, 0, None, None, "Texto", "Resumen")], "meeting_id long, title string, date string, start_ts timestamp, duration_us long, organizer string, company string, acta string, summary string").withColumn("date", F.to_date("date"))
    p = spark.createDataFrame([(1, 0, "SPEAKER_00", "Ana"), (1, 1, "SPEAKER_01", "speaker_01")], "meeting_id long, ord int, speaker_id string, display_name string")
    s = spark.createDataFrame([(1, 1, 65 * S, 70 * S, "SPEAKER_01", "", "Adiós."), (1, 0, 0, 5 * S, "SPEAKER_00", "Ana", "Hola.")], "meeting_id long, ord int, start_us long, end_us long, speaker_id string, speaker_name string, text string")
    return m, p, s


def test_markdown_and_its_way_back(spark, meeting):
    docs = {r.meeting_id: r.document for r in exports.markdown(*meeting).collect()}
    assert docs[1].startswith("# Plan: hoy\n\n**Fecha:** 06/05/2024\n**Duración:** 01:02:05\n**Organizador:** Ana\n\n## Participantes\n\n- Ana\n\n## Transcripción\n\n### 00:00:00 — Ana\n\nHola.\n\n")
    assert "_Sin participantes registrados._" in docs[2] and "_Transcripción vacía._" in docs[2] and docs[2].endswith("---\n\nTexto\n")
    assert rows(spark, transcripts.parse_any, docs[1]) == [(0, 65, "Ana", "Hola."), (65, 70, "SPEAKER_01", "Adiós.")]


def test_text_documents(meeting):
    docs = {r.meeting_id: r.document for r in exports.plain_text(*meeting).collect()}
    assert "PARTICIPANTES:\n- Ana\n" in docs[1] and docs[1].endswith("[00:01:05] SPEAKER_01:\nAdiós.\n\n") and docs[1].split("\n")[1] == "=" * 9
    cards = meeting[0].sparkSession.createDataFrame([(1, 0, 0, 90 * S, None, " Todo bien. ")], "meeting_id long, ord int, start_us long, end_us long, range string, text string")
    short = {r.meeting_id: r.document for r in exports.summary_text(meeting[0], cards).collect()}
    assert short[1].endswith("[00:00 - 01:30]\nTodo bien.\n\n") and short[2].endswith("Resumen\n\n")


def test_interval_strings(spark):
    values = [0, 1_500_000, 86_400 * S + 1, 3_600 * S]
    df = spark.createDataFrame([(v,) for v in values], "us long").withColumn("t", exports.interval_string(F.col("us")))
    assert [(r.t, r.back) for r in df.withColumn("back", exports.parse_interval(F.col("t"))).collect()] == [("00:00:00", 0), ("00:00:01.5000000", 1_500_000), ("1.00:00:00.0000010", 86_400 * S + 1), ("01:00:00", 3_600 * S)]


def test_meeting_folders(spark, meeting, tmp_path):
    docs = {r.meeting_id: r.document for r in exports.meeting_json(*meeting).collect()}
    for folder, file, body in (("2024_a_1", "x_meeting.json", docs[1]), ("2024_a_1", "meeting.json", '{"id": "old"}'), ("2024_b_2", "meeting.json", docs[2]), (".deleting_c", "meeting.json", '{"id": "c"}'), ("d", "only_params.json", '{"id": "d"}'), ("e", "meeting.json", "{ broken")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / file).write_text(body)
    (tmp_path / "2024_a_1" / "actas").mkdir()
    (tmp_path / "2024_a_1" / "actas" / "index.json").write_text(json.dumps({"versions": [{"id": "v1", "fileName": "v1.md"}, {"id": "v2", "fileName": "gone.md"}]}))
    (tmp_path / "2024_a_1" / "actas" / "v1.md").write_text("# Uno")
    (tmp_path / "2024_b_2" / "x_acta.md").write_text("# Antes")
    found = meetings.read_meetings(meetings.folder_files(spark, str(tmp_path)))
    assert [r.id for r in found.collect()] == ["2", "1"]
    assert [(r.ord, r.start_us, r.text) for r in meetings.transcript_rows(found).collect()] == [(0, 0, "Hola."), (1, 65 * S, "Adiós.")]
    versions = {r.version_id: (r.markdown, r.legacy) for r in meetings.acta_versions(meetings.folder_files(spark, str(tmp_path)), found).collect()}
    assert versions == {"v1": ("# Uno", False), "v2": (None, False), "legacy-2": ("# Antes", True)}
    assert meetings.find_folder(meetings.folder_files(spark, str(tmp_path)), "1").first().folder.endswith("2024_a_1")
    assert meetings.meeting_by_id(found, "2").count() == 1


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"version": 1, "terms": [{"word": " Aritz ", "aliases": ["arich", " Arich", "", "ariz"]}, {"word": " "}]}))
    terms = meetings.read_vocabulary(spark, str(tmp_path / "v.json"))
    assert [tuple(r) for r in terms.collect()] == [(0, "Aritz", ["arich", "ariz"])]
    assert json.loads(meetings.vocabulary_json(terms).first().document)["terms"] == [{"word": "Aritz", "aliases": ["arich", "ariz"]}]
