"""Documents of a meeting: Markdown, text, summary text, JSON; their names; and writing them.

Inputs: meetings (meeting_id, title, date, start_ts, duration_us, organizer,
company, acta, summary), participants (meeting_id, ord, speaker_id,
display_name), segments (meeting_id, ord, start_us, speaker_id, speaker_name,
text), cards (meeting_id, ord, start_us, end_us, range, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import none_or_blank, strip
from ..functions.times import hms

TECHNICAL = r"(?i)^(?:SPEAKER|HABLANTE|LOCUTOR)(?:[_\s\-]\d+|\d+)?$"


def filled(x: Column) -> Column:
    return F.when(~none_or_blank(x), x)


def ordered(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(meeting_id, name): each meeting's values as an array in order."""
    a = F.array_sort(F.collect_list(F.struct("ord", value.alias("v"))))
    return rows.groupBy("meeting_id").agg(F.transform(a, lambda x: x["v"]).alias(name))


def speaker_shown(name: Column, speaker: Column) -> Column:
    return F.coalesce(filled(name), filled(speaker), F.lit("Hablante"))


def gathered(meetings: DataFrame, participants: DataFrame, segments: DataFrame) -> DataFrame:
    """Meetings with names (users', else all participants'), lines of Markdown and of text."""
    shown = F.coalesce(filled(F.col("display_name")), F.col("speaker_id"))
    users = participants.filter(~none_or_blank(F.col("display_name")) & ~F.trim("display_name").rlike(TECHNICAL))
    first = users.groupBy("meeting_id", F.lower(F.trim("display_name")).alias("k")).agg(F.min(F.struct("ord", F.trim("display_name").alias("v"))).alias("f")).select("meeting_id", "f.ord", "f.v")
    speaker = speaker_shown(F.col("speaker_name"), F.col("speaker_id"))
    md = F.concat(F.lit("### "), hms(F.col("start_us")), F.lit(" — "), speaker, F.lit("\n\n"), "text", F.lit("\n\n"))
    txt = F.concat(F.lit("["), hms(F.col("start_us")), F.lit("] "), speaker, F.lit(":\n"), "text", F.lit("\n\n"))
    out = meetings.join(ordered(first, F.col("v"), "_users"), "meeting_id", "left").join(ordered(participants, shown, "_all"), "meeting_id", "left")
    return out.join(ordered(segments.withColumn("_md", md), F.struct(F.col("_md").alias("md"), txt.alias("txt")), "_lines"), "meeting_id", "left")


def _bullets(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n, F.lit("\n"))), "")


def _line(label: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(label), value, F.lit("\n")), F.lit(""))


def _head(md: bool) -> list[Column]:
    mark = "**" if md else ""
    return [
        _line(f"{mark}Fecha:{mark} ", F.date_format("date", "dd/MM/yyyy")),
        _line(f"{mark}Hora:{mark} ", F.date_format("start_ts", "HH:mm")),
        _line(f"{mark}Duración:{mark} ", hms(F.col("duration_us"))),
        _line(f"{mark}Organizador:{mark} ", filled(F.col("organizer"))),
    ]


def _title() -> Column:
    return F.concat("title", F.lit("\n"), F.repeat(F.lit("="), F.length("title")), F.lit("\n"))


def markdown(meetings: DataFrame, participants: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, document)"""
    m = gathered(meetings, participants, segments)
    names = F.coalesce(F.when(F.size("_users") > 0, _bullets(F.col("_users"))), F.when(F.size("_all") > 0, _bullets(F.col("_all"))), F.lit("_Sin participantes registrados._\n"))
    said = F.coalesce(F.array_join(F.transform("_lines", lambda x: x["md"]), ""), F.lit("_Transcripción vacía._\n"))
    acta = F.coalesce(F.concat(F.lit("\n---\n\n"), filled(F.col("acta")), F.lit("\n")), F.lit(""))
    parts = [F.lit("# "), F.col("title"), F.lit("\n\n"), *_head(True), _line("**Empresa:** ", filled(F.col("company"))), F.lit("\n## Participantes\n\n"), names, F.lit("\n## Transcripción\n\n"), said, acta]
    return m.select("meeting_id", F.concat(*parts).alias("document"))


def plain_text(meetings: DataFrame, participants: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, document)"""
    m = gathered(meetings, participants, segments)
    names = F.coalesce(F.when(F.size("_users") > 0, _bullets(F.col("_users"))), _bullets(F.col("_all")), F.lit(""))
    said = F.coalesce(F.array_join(F.transform("_lines", lambda x: x["txt"]), ""), F.lit(""))
    parts = [_title(), *_head(False), F.lit("\nPARTICIPANTES:\n"), names, F.lit("\nTRANSCRIPCIÓN:\n" + "-" * 30 + "\n"), said]
    return m.select("meeting_id", F.concat(*parts).alias("document"))


def summary_text(meetings: DataFrame, cards: DataFrame) -> DataFrame:
    """(meeting_id, document)"""
    short = lambda us: F.format_string("%02d:%02d", F.floor(us / 60_000_000) % 60, F.floor(us / 1_000_000) % 60)
    stamp = F.coalesce(filled(F.col("range")), F.concat(short(F.col("start_us")), F.lit(" - "), short(F.col("end_us"))))
    card = F.concat(F.lit("["), stamp, F.lit("]\n"), strip(F.col("text")), F.lit("\n\n"))
    m = meetings.join(ordered(cards, card, "_cards"), "meeting_id", "left")
    said = F.coalesce(F.array_join("_cards", ""), F.concat(strip(filled(F.col("summary"))), F.lit("\n\n")), F.lit("_Sin resumen disponible._\n\n"))
    parts = [_title(), *_head(False), F.lit("\nRESUMEN DE LA REUNIÓN:\n" + "-" * 30 + "\n"), said]
    return m.select("meeting_id", F.concat(*parts).alias("document"))


def interval_string(us: Column) -> Column:
    """``[d.]hh:mm:ss[.fffffff]``, as the JSON contract writes offsets."""
    s = F.floor(us / 1_000_000)
    days = F.when(s >= 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("."))).otherwise(F.lit(""))
    rest = F.when(us % 1_000_000 != 0, F.format_string(".%06d0", us % 1_000_000)).otherwise(F.lit(""))
    return F.concat(days, F.format_string("%02d:%02d:%02d", F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60), rest)


def parse_interval(text: Column) -> Column:
    """Microseconds of such a string; null if it is none."""
    pattern = r"^(?:(\d+)\.)?(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,7}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("long"), F.lit(0))
    whole = ((part(1) * 24 + part(2)) * 60 + part(3)) * 60 + part(4)
    fraction = F.substring(F.rpad(F.regexp_extract(text, pattern, 5), 7, "0"), 1, 6).cast("long")
    return F.when(text.rlike(pattern), whole * 1_000_000 + fraction)


def meeting_json(meetings: DataFrame, participants: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, document): camelCase names, offsets as interval strings, lists in order."""
    seg = F.struct(F.col("start_us"), F.col("end_us"), "speaker_id", "speaker_name", "text")
    s, p = ordered(segments, seg, "_s"), ordered(participants, F.struct("speaker_id", "display_name"), "_p")
    m = meetings.join(s, "meeting_id", "left").join(p, "meeting_id", "left")
    said = F.transform("_s", lambda x: F.struct(interval_string(x["start_us"]).alias("startTime"), interval_string(x["end_us"]).alias("endTime"), x["speaker_id"].alias("speakerId"), x["speaker_name"].alias("speakerDisplayName"), x["text"].alias("text")))
    people = F.transform("_p", lambda x: F.struct(x["speaker_id"].alias("id"), x["display_name"].alias("displayName")))
    empty = lambda a: F.coalesce(a, F.array())
    body = F.struct(F.col("meeting_id").cast("string").alias("id"), "title", F.date_format("date", "yyyy-MM-dd'T'00:00:00").alias("date"), "organizer", "company", empty(people).alias("participants"), empty(said).alias("transcript"), F.col("acta").alias("actaMarkdown"))
    return m.select("meeting_id", F.to_json(body).alias("document"))


def safe_name(title: Column) -> Column:
    """Letters that file names cannot hold become ``_``, spaces ``-``; blank is ``Reunion``."""
    safe = F.regexp_replace(F.regexp_replace(strip(title), r'[\x00-\x1F<>:"/\\|?*]', "_"), " ", "-")
    return F.when(none_or_blank(title), F.lit("Reunion")).otherwise(safe)


def folder_name(date: Column, title: Column, meeting_id: Column) -> Column:
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("_"), safe_name(title), F.lit("_"), F.substring(meeting_id.cast("string"), 1, 6))


def base_name(start: Column, title: Column) -> Column:
    return F.concat(safe_name(title), F.lit("_"), F.date_format(start, "yyyy-MM-dd_HH-mm"))


def version_file(created: Column, language: Column, detail: Column, version_id: Column) -> Column:
    return F.concat(F.lit("acta_"), F.date_format(created, "yyyyMMdd_HHmmss"), F.lit("_"), F.lower(language), F.lit("_"), F.lower(detail), F.lit("_"), F.substring(version_id, 1, 6), F.lit(".md"))


def meeting_files(meetings: DataFrame, participants: DataFrame, segments: DataFrame, cards: DataFrame, versions: DataFrame) -> DataFrame:
    """(meeting_id, folder, file, content): every file of a meeting's folder.

    The meeting as JSON, its transcript as Markdown and text, its summary if it
    has one, its minutes, and the parameters that list them. ``versions``:
    (meeting_id, version_id, created_at timestamp, language, detail, markdown,
    active); they come with an index, and the active one (else the newest) is the meeting's minutes.
    """
    v = versions.withColumn("file", version_file(F.col("created_at"), F.col("language"), F.col("detail"), F.col("version_id")))
    entry = F.struct(F.col("version_id").alias("id"), F.col("meeting_id").cast("string").alias("meetingId"), F.col("file").alias("fileName"), "language", F.col("detail").alias("detailLevel"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("createdAt"), F.col("markdown").alias("originalAiMarkdownContent"))
    newest = F.max(F.struct(F.coalesce("active", F.lit(False)).alias("active"), "created_at", "version_id", "markdown"))
    kept = v.groupBy("meeting_id").agg(newest.alias("_best"), F.array_sort(F.collect_list(F.struct("created_at", "version_id", entry.alias("e")))).alias("_index"))
    m = meetings.join(kept, "meeting_id", "left").withColumn("acta", F.coalesce("_best.markdown", "acta"))
    named = m.select("meeting_id", folder_name(F.col("date"), F.col("title"), F.col("meeting_id")).alias("folder"), base_name(F.coalesce("start_ts", F.col("date").cast("timestamp")), F.col("title")).alias("base"), "title", "date", "duration_us", "acta", "summary", "_best", "_index")
    plain = m.drop("_best", "_index")

    def of(documents: DataFrame, suffix: str) -> DataFrame:
        return documents.join(named.select("meeting_id", "folder", "base"), "meeting_id").select("meeting_id", "folder", F.concat("base", F.lit(suffix)).alias("file"), F.col("document").alias("content"))

    told = cards.select("meeting_id").union(meetings.filter(~none_or_blank(F.col("summary"))).select("meeting_id")).distinct()
    summaries = summary_text(plain, cards).join(told, "meeting_id", "left_semi")
    own = named.filter(~none_or_blank(F.col("acta"))).select("meeting_id", F.col("acta").alias("document"))
    index = F.struct(F.col("meeting_id").cast("string").alias("meetingId"), F.col("_best.version_id").alias("activeVersionId"), F.transform("_index", lambda x: x["e"]).alias("versions"))
    indexes = named.filter("_index IS NOT NULL").select("meeting_id", "folder", F.lit("actas/index.json").alias("file"), F.to_json(index).alias("content"))
    texts = v.join(named.select("meeting_id", "folder"), "meeting_id").select("meeting_id", "folder", F.concat(F.lit("actas/"), "file").alias("file"), F.coalesce("markdown", F.lit("")).alias("content"))
    files = of(meeting_json(plain, participants, segments), "_meeting.json").union(of(markdown(plain, participants, segments), "_transcript.md")).union(of(plain_text(plain, participants, segments), "_transcript.txt"))
    files = files.union(of(summaries, "_resumen.txt")).union(of(own, "_acta.md")).union(indexes).union(texts)
    listed = named.join(told.withColumn("_told", F.lit(True)), "meeting_id", "left")
    file = lambda suffix, when=F.lit(True): F.when(when, F.concat("base", F.lit(suffix)))
    made = F.struct(file("_meeting.json").alias("MeetingJson"), file("_transcript.md").alias("TranscriptMarkdown"), file("_transcript.txt").alias("TranscriptText"), file("_resumen.txt", F.col("_told")).alias("SummaryText"), file("_acta.md", ~none_or_blank(F.col("acta"))).alias("ActaMarkdown"))
    parameters = F.struct(F.col("meeting_id").cast("string").alias("meetingId"), "title", F.date_format("date", "yyyy-MM-dd'T'00:00:00").alias("date"), interval_string(F.col("duration_us")).alias("duration"), made.alias("generatedFiles"))
    return files.union(listed.select("meeting_id", "folder", F.concat("base", F.lit("_params.json")).alias("file"), F.to_json(parameters).alias("content")))

