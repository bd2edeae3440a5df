"""Queries over sources, sinks and changes of the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import minutes, text
from ..functions.times import hms
from ..operators import catalog, speakers, stages, windows
from ..sinks import exports
from ..sinks.archive import Archive
from ..sources import meetings as meeting_files
from ..sources import transcripts
from ..sources.meetings import clean_aliases
from ..sources.shared import cut, shared_folder
from .basic import HMS, TECHNICAL, TOKENS, VOCABULARY, vocabulary
from .derived import MEETINGS, WITH, meetings, segments, table
from .registry import query

# Sources: transcripts written in each format and read back

FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SAID = f"said AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) - 1 AS ord, start_us // 1000000 * 1000000 AS start_us, end_us // 1000000 * 1000000 AS end_us, speaker_id AS speaker, {FLAT} AS text FROM segments WHERE {FLAT} <> '')"


def said(spark, sf) -> DataFrame:
    """Segments in whole seconds, each text in one line."""
    second = lambda c: F.floor(F.col(c) / 1_000_000) * 1_000_000
    s = segments(spark, sf).select("meeting_id", "ord", second("start_us").alias("start_us"), second("end_us").alias("end_us"), F.col("speaker_id").alias("speaker"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return s.filter("text <> ''")


def files(rows: DataFrame, line, head: str = "") -> DataFrame:
    """(meeting_id, content): each meeting's lines in order."""
    return exports.ordered(rows.withColumn("_l", line), F.col("_l"), "_lines").select("meeting_id", F.concat(F.lit(head), F.array_join("_lines", "")).alias("content"))


def clock(us, mark: str):
    return F.concat(hms(us), F.lit(mark), F.lit("000"))


def cue(mark: str, speaker):
    return F.concat(clock(F.col("start_us"), mark), F.lit(" --> "), clock(F.col("end_us"), mark), F.lit("\n"), speaker, "text", F.lit("\n\n"))


@query(f"{WITH}, {SAID} SELECT * FROM said")
def src_parse_srt(spark, sf):
    tag = F.concat(F.lit("["), "speaker", F.lit("] "))
    f = files(said(spark, sf), F.concat((F.col("ord") + 1).cast("string"), F.lit("\n"), cue(",", tag)))
    return transcripts.exploded(f, transcripts.parse_srt(F.col("content")), "meeting_id")


@query(f"{WITH}, {SAID} SELECT meeting_id, ord, start_us, end_us, '' AS speaker, text FROM said")
def src_parse_vtt(spark, sf):
    """Voice tags are lost, as tags go before speakers are looked for."""
    f = files(said(spark, sf), cue(".", F.concat(F.lit("<v "), "speaker", F.lit(">"))), "WEBVTT\n\n")
    return transcripts.exploded(f, transcripts.parse_vtt(F.col("content")), "meeting_id")


NEXT = "coalesce(lead(start_us) OVER (PARTITION BY meeting_id ORDER BY ord), start_us + 5000000)"


@query(f"{WITH}, {SAID} SELECT meeting_id, ord, start_us, {NEXT} AS end_us, speaker, text FROM said")
def src_parse_ts_lines(spark, sf):
    f = files(said(spark, sf), F.concat(F.lit("["), hms(F.col("start_us")), F.lit("] "), "speaker", F.lit(": "), "text", F.lit("\n")))
    return transcripts.exploded(f, transcripts.parse_stamped_lines(F.col("content")), "meeting_id")


@query(f"{WITH}, {SAID}, h AS (SELECT meeting_id, ord, start_us, {NEXT} AS end_us, speaker, text FROM said) SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) - 1 AS ord, start_us, end_us, speaker, text FROM h WHERE ord % 5 <> 4")
def src_parse_md(spark, sf):
    """Every fifth heading has no text: it only ends the segment before it."""
    numbered = exports.ordered(said(spark, sf), F.struct("start_us", "speaker", "text"), "a").select("meeting_id", F.posexplode("a").alias("ord", "s")).select("meeting_id", "ord", "s.*")
    body = F.when(F.col("ord") % 5 == 4, F.lit("")).otherwise(F.concat("text", F.lit("\n\n")))
    f = files(numbered, F.concat(F.lit("### "), hms(F.col("start_us")), F.lit(" — "), "speaker", F.lit("\n\n"), body))
    return transcripts.exploded(f, transcripts.parse_markdown(F.col("content")), "meeting_id")


PARAGRAPHS = r"p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(trim(text, chr(10) || ' ' || chr(13) || chr(9)), '\r?\n\s*\r?\n'), lambda x: trim(x, chr(10) || ' ' || chr(13) || chr(9))), lambda x: x <> '') AS a FROM documents)"


@query(f"WITH {PARAGRAPHS} SELECT doc_id, i - 1 AS ord, (i - 1) * 5000000 AS start_us, i * 5000000 AS end_us, '' AS speaker, a[i] AS text FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM p)")
def src_parse_plain(spark, sf):
    return transcripts.exploded(table(spark, sf, "documents"), transcripts.parse_plain(F.col("text")), "doc_id")


@query(f"{WITH}, {SAID} SELECT meeting_id, ord, start_us, CASE WHEN meeting_id % 3 = 2 THEN {NEXT} ELSE end_us END AS end_us, CASE WHEN meeting_id % 3 = 1 THEN '' ELSE speaker END AS speaker, text FROM said")
def src_parse_auto(spark, sf):
    """Three formats side by side, each found by its content."""
    s = said(spark, sf)
    of = lambda i: s.filter(F.col("meeting_id") % 3 == i)
    srt = files(of(0), cue(",", F.concat(F.lit("["), "speaker", F.lit("] "))))
    vtt = files(of(1), cue(".", F.lit("")), "WEBVTT\n\n")
    lines = files(of(2), F.concat(F.lit("["), hms(F.col("start_us")), F.lit("] "), "speaker", F.lit(": "), "text", F.lit("\n")))
    return transcripts.exploded(srt.union(vtt).union(lines), transcripts.parse_any(F.col("content")), "meeting_id")


@query("SELECT doc_id, kind IN ('mp3', 'wav', 'm4a') AS audio, kind IN ('txt', 'srt', 'vtt') AS text FROM (SELECT doc_id, ['mp3', 'wav', 'm4a', 'txt', 'srt', 'vtt', 'exe', ''][(doc_id % 8 + 1)::INT] AS kind FROM documents)")
def src_supported_formats(spark, sf):
    names = F.array(*[F.lit(x) for x in ("a/b.MP3", ".wav", "m4a", "x.Txt", "c:\\d\\e.srt", "VTT", "setup.exe", None)])
    name = F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", transcripts.supported(name, transcripts.AUDIO_FORMATS).alias("audio"), transcripts.supported(name, transcripts.TEXT_FORMATS).alias("text"))


@query(f"{WITH}, {MEETINGS} SELECT meeting_id, title FROM meetings WHERE meeting_id = 42")
def src_meeting_by_id(spark, sf):
    return meetings(spark, sf).filter("meeting_id = 42").limit(1).select("meeting_id", "title")


@query(f"WITH {VOCABULARY}, a AS (SELECT item_id, unnest(aliases) AS a, unnest(range(0, len(aliases))) AS i FROM vocab), f AS (SELECT item_id, min_by(a, i) AS a, min(i) AS i FROM a GROUP BY item_id, lower(a)) SELECT item_id, string_agg(a, '|' ORDER BY i) AS aliases FROM f GROUP BY item_id")
def src_vocab_json(spark, sf):
    """A vocabulary through its JSON form and back."""
    schema = "terms array<struct<item_id:bigint,word:string,aliases:array<string>>>"
    doc = vocabulary(spark, sf).select("item_id", F.to_json(F.struct(F.array(F.struct("item_id", "word", F.concat(F.array(F.lit(" ")), "aliases").alias("aliases"))).alias("terms"))).alias("d"))
    t = doc.select(F.explode(F.from_json("d", schema)["terms"]).alias("t"))
    return t.select("t.item_id", F.array_join(clean_aliases(F.col("t.aliases")), "|").alias("aliases")).filter("aliases <> ''")


def saved_meetings(spark, sf) -> DataFrame:
    """The meetings saved to the shared folder, and the files of their folders read back; every run writes its own."""
    archive = _archive(spark)
    archive.save(_meeting_files(spark, sf))
    return archive.files()


def _archive(spark) -> Archive:
    return Archive(spark, f"{shared_folder(spark)}/meetings-{uuid.uuid4().hex}")


@query(f"{WITH}, {MEETINGS} SELECT meeting_id::VARCHAR AS id, title, n_segments AS n FROM meetings")
def src_meeting_scan(spark, sf):
    found = meeting_files.read_meetings(saved_meetings(spark, sf))
    return found.select("id", "title", F.size("transcript").cast("long").alias("n"))


@query("SELECT '42' AS id, 1 AS folders FROM conversations WHERE conv_id = 42 LIMIT 1")
def src_find_dir(spark, sf):
    found = meeting_files.find_folder(saved_meetings(spark, sf), "42")
    return found.agg(F.lit("42").alias("id"), F.count("*").alias("folders")).filter("folders > 0")


@query(f"{WITH}, {MEETINGS} SELECT 'legacy-' || meeting_id AS version_id, '# Acta ' || meeting_id AS markdown FROM meetings WHERE meeting_id % 4 = 0 UNION ALL SELECT 'v' || i || '-' || meeting_id, '# Acta ' || meeting_id || ' ' || i FROM meetings, (SELECT unnest([1, 2]) AS i) WHERE meeting_id % 4 = 1")
def src_acta_versions(spark, sf):
    """Every fourth meeting has an index of two versions, every fourth none: there its own minutes are the one version."""
    files = saved_meetings(spark, sf)
    return meeting_files.acta_versions(files, meeting_files.read_meetings(files)).select("version_id", "markdown")


def _meeting_files(spark, sf) -> DataFrame:
    m, s = _meeting_rows(spark, sf), segments(spark, sf)
    cards = s.filter("meeting_id % 2 = 0").withColumn("range", F.lit(None).cast("string"))
    number = F.explode(F.array(F.lit(1), F.lit(2))).alias("i")
    v = m.filter("meeting_id % 4 = 1").select("meeting_id", number)
    name = F.col("meeting_id").cast("string")
    v = v.select("meeting_id", F.concat(F.lit("v"), "i", F.lit("-"), name).alias("version_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i")).alias("created_at"), F.lit("es").alias("language"), F.lit("full").alias("detail"), F.concat(F.lit("# Acta "), name, F.lit(" "), "i").alias("markdown"), (F.col("i") == 1).alias("active"))
    return exports.meeting_files(m, _people(spark, sf), s, cards, v)


# Sinks


def _meeting_rows(spark, sf) -> DataFrame:
    null = F.lit(None).cast("string")
    acta = F.when(F.col("meeting_id") % 4 == 0, F.concat(F.lit("# Acta "), F.col("meeting_id").cast("string")))
    company = F.when(F.col("meeting_id") % 3 == 0, F.lit("Compañía"))
    return meetings(spark, sf).select("meeting_id", "title", "date", F.lit(None).cast("timestamp").alias("start_ts"), (F.col("end_us") - F.col("start_us")).alias("duration_us"), null.alias("organizer"), company.alias("company"), acta.alias("acta"), null.alias("summary"))


def _people(spark, sf) -> DataFrame:
    s = segments(spark, sf)
    first = s.groupBy("meeting_id", "speaker_id").agg(F.min("ord").alias("ord"), F.min_by("speaker_name", "ord").alias("name"))
    return first.select("meeting_id", "ord", "speaker_id", F.when(F.col("meeting_id") % 2 == 0, F.col("name")).otherwise(F.col("speaker_id")).alias("display_name"))


PEOPLE = f"people AS (SELECT meeting_id, min(ord) AS ord, speaker_id, CASE WHEN meeting_id % 2 = 0 THEN min_by(speaker_name, ord) ELSE speaker_id END AS name FROM segments GROUP BY meeting_id, speaker_id), users AS (SELECT meeting_id, min_by(name, ord) AS name, min(ord) AS ord FROM people WHERE NOT regexp_matches(name, '{TECHNICAL}') GROUP BY meeting_id, lower(name)), who AS (SELECT meeting_id, string_agg('- ' || name || chr(10), '' ORDER BY ord) AS names FROM (SELECT meeting_id, name, ord FROM users UNION ALL SELECT meeting_id, name, ord FROM people p WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.meeting_id = p.meeting_id)) GROUP BY meeting_id)"
LINES = f"lines AS (SELECT meeting_id, string_agg('### ' || {HMS.format('start_us')} || ' — ' || speaker_name || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY ord) AS md, string_agg('[' || {HMS.format('start_us')} || '] ' || speaker_name || ':' || chr(10) || text || chr(10) || chr(10), '' ORDER BY ord) AS txt FROM segments GROUP BY meeting_id)"
DAY, LONG = "strftime(date, '%d/%m/%Y')", HMS.format("(end_us - start_us)")


@query(f"{WITH}, {MEETINGS}, {PEOPLE}, {LINES} SELECT meeting_id, '# ' || title || E'\\n\\n**Fecha:** ' || {DAY} || E'\\n**Duración:** ' || {LONG} || E'\\n' || CASE WHEN meeting_id % 3 = 0 THEN E'**Empresa:** Compañía\\n' ELSE '' END || E'\\n## Participantes\\n\\n' || names || E'\\n## Transcripción\\n\\n' || md || CASE WHEN meeting_id % 4 = 0 THEN E'\\n---\\n\\n# Acta ' || meeting_id || E'\\n' ELSE '' END AS document FROM meetings JOIN who USING (meeting_id) JOIN lines USING (meeting_id)")
def snk_markdown(spark, sf):
    return exports.markdown(_meeting_rows(spark, sf), _people(spark, sf), segments(spark, sf))


@query(f"{WITH}, {MEETINGS}, {PEOPLE}, {LINES} SELECT meeting_id, title || E'\\n' || repeat('=', length(title)::INT) || E'\\nFecha: ' || {DAY} || E'\\nDuración: ' || {LONG} || E'\\n\\nPARTICIPANTES:\\n' || names || E'\\nTRANSCRIPCIÓN:\\n' || repeat('-', 30) || E'\\n' || txt AS document FROM meetings JOIN who USING (meeting_id) JOIN lines USING (meeting_id)")
def snk_text(spark, sf):
    return exports.plain_text(_meeting_rows(spark, sf), _people(spark, sf), segments(spark, sf))


@query(f"{WITH}, {MEETINGS}, c AS (SELECT meeting_id, string_agg('[' || printf('%02d:%02d', start_us // 60000000 % 60, start_us // 1000000 % 60) || ' - ' || printf('%02d:%02d', end_us // 60000000 % 60, end_us // 1000000 % 60) || E']\\n' || trim(text, E' \\n\\t\\r') || E'\\n\\n', '' ORDER BY ord) AS t FROM segments WHERE meeting_id % 2 = 0 GROUP BY meeting_id) SELECT meeting_id, title || E'\\n' || repeat('=', length(title)::INT) || E'\\nFecha: ' || {DAY} || E'\\nDuración: ' || {LONG} || E'\\n\\nRESUMEN DE LA REUNIÓN:\\n' || repeat('-', 30) || E'\\n' || coalesce(t, E'_Sin resumen disponible._\\n\\n') AS document FROM meetings LEFT JOIN c USING (meeting_id)")
def snk_summary_text(spark, sf):
    cards = segments(spark, sf).filter("meeting_id % 2 = 0").withColumn("range", F.lit(None).cast("string"))
    return exports.summary_text(_meeting_rows(spark, sf), cards)


@query(f"{WITH} SELECT meeting_id, ord, start_us, end_us, speaker_id AS speaker, text FROM segments")
def snk_json(spark, sf):
    """Meetings as JSON, read back with an explicit schema."""
    j = exports.meeting_json(_meeting_rows(spark, sf), _people(spark, sf), segments(spark, sf))
    schema = "transcript array<struct<startTime:string,endTime:string,speakerId:string,text:string>>"
    t = j.select("meeting_id", F.posexplode(F.from_json("document", schema)["transcript"]).alias("ord", "s"))
    return t.select("meeting_id", F.col("ord").cast("long").alias("ord"), exports.parse_interval(F.col("s.startTime")).alias("start_us"), exports.parse_interval(F.col("s.endTime")).alias("end_us"), F.col("s.speakerId").alias("speaker"), "s.text")


@query(f"""{WITH}, {MEETINGS}, b AS (SELECT meeting_id, strftime(date, '%Y-%m-%d') || '_' || replace(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), ' ', '-') || '_' || (meeting_id::VARCHAR)[1:6] AS folder, replace(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), ' ', '-') || '_' || strftime(date, '%Y-%m-%d_%H-%M') AS base FROM meetings),
f AS (SELECT meeting_id, folder, base || unnest(['_meeting.json', '_transcript.md', '_transcript.txt', '_params.json']) AS file FROM b UNION ALL SELECT meeting_id, folder, base || '_resumen.txt' FROM b WHERE meeting_id % 2 = 0 UNION ALL SELECT meeting_id, folder, base || '_acta.md' FROM b WHERE meeting_id % 4 IN (0, 1) UNION ALL SELECT meeting_id, folder, unnest(['actas/index.json', 'actas/acta_20231114_221321_es_full_' || ('v1-' || meeting_id)[1:6] || '.md', 'actas/acta_20231114_221322_es_full_' || ('v2-' || meeting_id)[1:6] || '.md']) FROM b WHERE meeting_id % 4 = 1)
SELECT folder, count(*) AS files, string_agg(file, '|' ORDER BY file) AS names, CASE WHEN meeting_id % 4 = 1 THEN '# Acta ' || meeting_id || ' 1' WHEN meeting_id % 4 = 0 THEN '# Acta ' || meeting_id ELSE '' END AS acta FROM f GROUP BY folder, meeting_id""")
def snk_save_meeting(spark, sf):
    """What is in each saved folder, and the minutes in its document, after three saves into the same months: the last one replaces folders of the first."""
    files, archive = _meeting_files(spark, sf), _archive(spark)
    number = F.regexp_extract("folder", r"Reunion_-(\d+)", 1).cast("long")
    archive.save(files.filter(number % 2 == 0).withColumn("content", F.lit("{}")))
    archive.save(files.filter(number % 2 == 1))
    archive.save(files.filter(number % 2 == 0))
    files = archive.files()
    acta = meeting_files.read_meetings(files).select("folder", F.coalesce("actaMarkdown", F.lit("")).alias("acta"))
    names = files.groupBy("folder").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_list("file")), "|").alias("names"))
    return names.join(acta, "folder")


@query(f"{WITH}, {MEETINGS} SELECT meeting_id, strftime(date, '%Y-%m-%d') || '_' || replace(regexp_replace(title, '[<>:\"/\\\\|?*]', '_', 'g'), ' ', '-') || '_' || (meeting_id::VARCHAR)[1:6] AS folder FROM meetings")
def snk_file_naming(spark, sf):
    return meetings(spark, sf).select("meeting_id", exports.folder_name(F.col("date"), F.col("title"), F.col("meeting_id")).alias("folder"))


@query(f"{WITH}, {MEETINGS} SELECT meeting_id::VARCHAR AS id, 'deleted' AS phase FROM meetings WHERE meeting_id % 7 <> 3 UNION ALL SELECT meeting_id::VARCHAR, 'purged' FROM meetings WHERE meeting_id % 7 <> 3")
def snk_delete_meeting(spark, sf):
    """The meetings that readers find after every seventh is marked as deleted, and after the archive is purged."""
    archive = _archive(spark)
    archive.save(_meeting_files(spark, sf))
    found = meeting_files.read_meetings(archive.files())
    archive.delete(found.filter(F.col("id").cast("long") % 7 == 3))
    left = cut(meeting_files.read_meetings(archive.files()).select("id", F.lit("deleted").alias("phase")))
    archive.purge()
    return left.union(meeting_files.read_meetings(archive.files()).select("id", F.lit("purged").alias("phase")))


@query("WITH l AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey), a AS (SELECT o_custkey, min(o_orderkey) AS active FROM orders GROUP BY o_custkey) SELECT a.o_custkey AS meeting_id, coalesce(CASE WHEN active % 3 = 0 THEN newest ELSE active END, -1) AS version_id FROM a LEFT JOIN l USING (o_custkey)")
def snk_delete_version(spark, sf):
    """The active versions after every third version is deleted; -1 where none is left."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at"))
    active = o.groupBy("meeting_id").agg(F.min("version_id").alias("version_id"))
    return catalog.delete_versions(o, active, o.filter("version_id % 3 = 0").select("meeting_id", "version_id"))[1].fillna(-1, "version_id")


# Changes of the catalog


@query(f"{WITH}, {PEOPLE}, s AS (SELECT s.meeting_id, s.ord, CASE WHEN o.name IS NOT NULL AND s.speaker_id = 'SPEAKER_01' THEN 'SPEAKER_00' ELSE s.speaker_id END AS speaker_id, CASE WHEN s.speaker_id = 'SPEAKER_01' THEN coalesce(o.name, 'user') ELSE s.speaker_name END AS name FROM segments s LEFT JOIN people o ON o.meeting_id = s.meeting_id AND o.speaker_id = 'SPEAKER_00' AND lower(o.name) = 'user') SELECT * FROM s")
def dml_rename(spark, sf):
    """The second speaker renamed to a name that the first may have: then both become one."""
    s, p = segments(spark, sf), _people(spark, sf)
    renames = s.select("meeting_id").distinct().select("meeting_id", F.lit("speaker_01").alias("speaker_id"), F.lit(" user ").alias("new_name"))
    out, _ = speakers.rename(s.select("meeting_id", "ord", "speaker_id", "speaker_name"), p, renames)
    return out.withColumnRenamed("speaker_name", "name")


@query(f"{WITH}, k AS (SELECT DISTINCT meeting_id, lower(speaker_id) AS k FROM segments WHERE ord = 0) SELECT meeting_id, lower(speaker_id) AS speaker, min_by(speaker_name, ord) AS name FROM segments s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.meeting_id = s.meeting_id AND k.k = lower(s.speaker_id)) GROUP BY ALL UNION ALL SELECT meeting_id, lower(speaker_id), 'known' FROM segments WHERE ord = 0")
def dml_sync_participants(spark, sf):
    s = segments(spark, sf)
    known = s.filter("ord = 0").select("meeting_id", "ord", "speaker_id", F.lit("known").alias("display_name"))
    return speakers.sync_participants(s, known).select("meeting_id", F.lower("speaker_id").alias("speaker"), F.col("display_name").alias("name"))


@query(f"WITH {VOCABULARY}, n AS (SELECT lower(trim(word)) AS k, max_by(item_id, item_id) AS item FROM vocab WHERE trim(word) <> '' AND item_id % 2 = 0 GROUP BY ALL) SELECT lower(trim(word)) AS k, count(*) AS n FROM vocab WHERE item_id % 3 = 0 AND trim(word) <> '' AND lower(trim(word)) NOT IN (SELECT k FROM n WHERE item % 5 = 0) GROUP BY ALL UNION ALL SELECT k, 1 FROM n WHERE item % 5 <> 0 AND k NOT IN (SELECT lower(trim(word)) FROM vocab WHERE item_id % 3 = 0)")
def dml_vocab(spark, sf):
    """Terms after words are put in and some of them removed."""
    v = vocabulary(spark, sf).withColumnRenamed("item_id", "ord").filter("trim(word) <> ''").withColumn("word", F.trim("word"))
    put = catalog.upsert_vocabulary(v.filter("ord % 3 = 0"), v.filter("ord % 2 = 0"))
    gone = v.filter("ord % 2 = 0").groupBy(F.lower("word").alias("k")).agg(F.max_by(F.struct("ord", "word"), "ord").alias("m")).filter("m.ord % 5 = 0").select("m.word")
    return catalog.remove_terms(put, gone).groupBy(F.lower("word").alias("k")).agg(F.count("*").alias("n"))


@query(f"{WITH}, r AS (SELECT meeting_id, 0 AS side, ord, speaker_name AS name FROM segments UNION ALL SELECT meeting_id, 1, ord, 'Guest ' || (ord % 2) FROM segments), f AS (SELECT meeting_id, lower(name) AS k, min((side, ord, name)) AS f FROM r WHERE lower(name) <> 'guest 1' GROUP BY ALL) SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY f) - 1 AS ord, f[3] AS name FROM f")
def dml_participants(spark, sf):
    s = segments(spark, sf)
    guests = s.select("meeting_id", "ord", F.concat(F.lit(" Guest "), (F.col("ord") % 2).cast("string")).alias("name"))
    gone = s.select("meeting_id", F.lit("GUEST 1").alias("name")).distinct()
    return catalog.edit_participants(s.select("meeting_id", "ord", F.col("speaker_name").alias("name")), guests, gone)


@query("SELECT doc_id AS version_id, CASE WHEN doc_id % 3 = 0 THEN 'edited' ELSE lang END AS markdown, doc_id % 3 = 0 AND trim(lang) <> '' AND lang <> 'edited' AS can_restore FROM documents WHERE lang IS NOT NULL")
def dml_minutes_edit(spark, sf):
    """Every third version edited, every fifth of them put back by a later edit of none."""
    d = table(spark, sf, "documents").filter("lang IS NOT NULL")
    v = d.select(F.lit(1).alias("meeting_id"), F.col("doc_id").alias("version_id"), F.col("lang").alias("markdown"), F.lit(None).cast("string").alias("original"), F.lit(None).cast("long").alias("modified"))
    e = v.filter("version_id % 3 = 0").select("meeting_id", "version_id", F.lit("edited").alias("markdown"), F.col("version_id").alias("at"))
    return catalog.edit_minutes(v, e).select("version_id", "markdown", "can_restore")


# Generated texts


def _kept_marks(text: str) -> str:
    """SQL of a text in which marks beside a digit are others, out of reach."""
    for i, mark in enumerate(".,;:!?"):
        text = rf"regexp_replace(regexp_replace({text}, '(\d)[{mark}]', '\1' || chr({0xE000 + i}), 'g'), '[{mark}](\d)', chr({0xE000 + i}) || '\1', 'g')"
    return text


@query(rf"SELECT doc_id, regexp_replace(translate(regexp_replace({_kept_marks('text')}, '[.,;:!?]', '', 'g'), {' || '.join(f'chr({0xE000 + i})' for i in range(6))}, '.,;:!?'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def str_clean_punct(spark, sf):
    return table(spark, sf, "documents").select("doc_id", minutes.clean_punctuation(F.col("text")).alias("text"))


@query("SELECT doc_id, length(t) >= 100 AND regexp_matches(trim(t, chr(10) || ' ' || chr(9) || chr(13)), '[.|)\\]*`:}>]$') AS valid FROM (SELECT doc_id, '# Acta' || chr(10) || '## Temas' || chr(10) || text AS t FROM documents WHERE text IS NOT NULL)")
def str_minutes_valid(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", minutes.minutes_valid(F.concat(F.lit("# Acta\n## Temas\n"), "text")).alias("valid"))


@query()
def str_complete_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", minutes.complete_sentences(F.col("text")).alias("text"))


@query()
def str_sanitize_summary(spark, sf):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Resumen: ", "En esta reunión, se comenta que ", "Ninguno. ", "", "<|im_end|>")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", minutes.sanitize_summary(F.concat(lead, "text"), F.lit("antes"), "Acme").alias("text"))


@query()
def str_sanitize_minutes(spark, sf):
    body = F.concat(F.lit("# Acta\n## Participantes\n- SPEAKER_00\n- SPEAKER_01\n## Temas\nSPEAKER_01 propuso "), "text", F.lit("\n| SPEAKER_00 | tarea |\nsegún SPEAKER_01, sigue."))
    s = segments(spark, sf)
    return s.select("meeting_id", "ord", minutes.sanitize_minutes(body, F.array("speaker_name"), F.col("ord") % 2 == 1).alias("text"))


@query(f"{WITH} SELECT meeting_id, 'Resume.' || E'\\n\\nReunión: ' || meeting_id || E'\\n\\nTranscripción:\\n' || string_agg('[' || {HMS.format('start_us')} || '] ' || speaker_name || ': ' || text, E'\\n' ORDER BY ord) AS prompt FROM segments GROUP BY meeting_id")
def str_prompts(spark, sf):
    s = segments(spark, sf).withColumn("line", minutes.transcript_line(F.col("start_us"), F.col("speaker_name"), F.col("text")))
    lines = exports.ordered(s, F.col("line"), "lines")
    return lines.select("meeting_id", minutes.prompt(F.lit("Resume."), F.col("meeting_id").cast("string"), F.col("lines")).alias("prompt"))


@query()
def str_prompt_stages(spark, sf):
    """All prompts of minutes in stages: full ones, chunks, syntheses by level, drafts."""
    done = stages.minutes_in_stages(meetings(spark, sf), segments(spark, sf), target_tokens=60, target_us=120_000_000, synthesis_tokens=80)
    return done.select("meeting_id", "stage", "level", "ord", "prompt", "prompt_tokens", "completion_tokens")


@query("SELECT doc_id, 'Continúa.' || chr(10) || chr(10) || array_to_string(l[greatest(len(l) - 14, 1):], chr(10)) AS prompt FROM (SELECT doc_id, string_split_regex(replace(text, '. ', '.' || chr(10)), '\r\n|\r|\n') AS l FROM documents)")
def str_prompt_continuation(spark, sf):
    """For documents that broke off, a line for each sentence."""
    partial = F.replace("text", F.lit(". "), F.lit(".\n"))
    return table(spark, sf, "documents").select("doc_id", minutes.continuation_prompt(F.lit("Continúa."), partial).alias("prompt"))


@query(f"{WITH} SELECT meeting_id, ord, '<|im_start|>system' || chr(10) || 'Resume.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || trim(text, E' \\n\\t\\r') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM segments")
def str_prompt_live(spark, sf):
    return segments(spark, sf).select("meeting_id", "ord", minutes.live_prompt(F.lit(" Resume. "), F.col("text")).alias("prompt"))


BARE = r"CASE WHEN regexp_replace(w, '[.,?!:;\-]+$', '') = '' THEN w ELSE regexp_replace(w, '[.,?!:;\-]+$', '') END"
LEAD = r"length(regexp_extract(b, '^\P{L}*'))"


@query(rf"{WITH}, t AS (SELECT meeting_id, ord, words, unnest({TOKENS}) AS w, unnest(range(words)) AS i FROM segments), b AS (SELECT *, {BARE} AS b FROM t), p AS (SELECT meeting_id, ord, i, CASE WHEN i = 0 THEN b[:{LEAD}] || upper(b[{LEAD} + 1:{LEAD} + 1]) || b[{LEAD} + 2:] ELSE b END || CASE WHEN i + 1 = words THEN '.' WHEN i % 7 = 6 THEN ',' ELSE '' END AS x FROM b), j AS (SELECT meeting_id, ord, string_agg(x, ' ' ORDER BY i) AS x FROM p GROUP BY ALL) SELECT s.meeting_id, s.ord, coalesce(regexp_replace(j.x, '[.,?!:;]+([.,?!:;])', '\1', 'g'), '') AS text FROM segments s LEFT JOIN j USING (meeting_id, ord)")
def str_restore_punct(spark, sf):
    """Labels of a fake model: a comma every seventh word, a stop at the end."""
    w = segments(spark, sf).select("meeting_id", "ord", text.words(F.col("text")).alias("w"))
    labels = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.when(i == F.size("w"), ".").when(i % 7 == 0, ",").otherwise("0"))
    labels = F.when(F.size("w") > 0, labels).otherwise(F.array().cast("array<string>"))
    return w.select("meeting_id", "ord", minutes.restore_punctuation(F.col("w"), labels).alias("text"))


@query("SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE ceil(greatest(n - 200, 0) / 170)::BIGINT + 1 END AS windows FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: len(x) > 0)) AS n FROM documents WHERE text IS NOT NULL)")
def win_word_windows(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.size(minutes.word_windows(text.count_words(F.col("text")))).cast("long").alias("windows"))


SUBTOKENS = """n AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: len(x) > 0), lambda x: (len(x) + 1) // 2) AS c FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, c, len(c) AS n, CASE WHEN len(c) <= 200 THEN 0 ELSE 30 END AS back, 0 AS start FROM n WHERE len(c) > 0)"""
TAKEN = "least(200, n - start) - 20 * list_filter(range(11), lambda j: least(200, n - start) - 20 * j <= 20 OR list_sum(c[start + 1:start + least(200, n - start) - 20 * j]) + 2 <= 500)[1]"


@query(f"WITH RECURSIVE {SUBTOKENS}, r AS (SELECT doc_id, c, n, back, start, {TAKEN} AS take FROM s UNION ALL SELECT doc_id, c, n, back, start, {TAKEN} AS take FROM (SELECT doc_id, c, n, back, start + greatest(1, take - back) AS start FROM r WHERE start + take < n)) SELECT doc_id, start::INT AS start, take::INT AS take FROM r")
def win_subtoken_windows(spark, sf):
    """Windows of words that hold 500 subtokens at most, two letters to a subtoken."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    counts = F.transform(text.words(F.col("text")), lambda w: F.floor((F.length(w) + 1) / 2).cast("int"))
    return d.select("doc_id", F.explode(windows.subtoken_windows(counts)).alias("w")).select("doc_id", "w.start", "w.take")


@query("WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: len(x) > 0)) AS n FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, n, unnest(range(n)) AS i FROM w), l AS (SELECT doc_id, string_agg(((i + least(i // 170 * 170, ceil(greatest(n - 200, 0) / 170)::BIGINT * 170)) % 5)::VARCHAR, '' ORDER BY i) AS labels FROM i GROUP BY doc_id) SELECT doc_id, coalesce(labels, '') AS labels FROM w LEFT JOIN l USING (doc_id)")
def win_word_labels(spark, sf):
    """Labels of a fake model that depend on word and window, one for each word."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", text.count_words(F.col("text")).alias("n"))
    label = lambda start: lambda j: ((start + j + start) % 5).cast("string")
    of = lambda start: F.struct(start.alias("start"), F.transform(F.sequence(F.lit(0), F.least(F.lit(200), F.col("n") - start) - 1), label(start)).alias("labels"))
    return d.select("doc_id", F.array_join(minutes.window_labels(F.transform(minutes.word_windows(F.col("n")), of)), "").alias("labels"))
