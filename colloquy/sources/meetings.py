"""Meeting folders: one JSON document a meeting, minutes with an index of versions, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_spellings, none_or_blank, strip
from ..sinks.exports import parse_interval

MEETING = (
    "id string, title string, organizer string, company string, date string, startTime string, endTime string, actaMarkdown string, summaryText string, "
    "activeActaVersionId string, processingStatus int, transcriptionStatus int, diarizationStatus int, "
    "participants array<struct<id:string,displayName:string,colorHex:string>>, "
    "transcript array<struct<id:string,startTime:string,endTime:string,speakerId:string,speakerDisplayName:string,text:string,confidence:float,isFinal:boolean>>"
)
VERSIONS = "versions array<struct<id:string,meetingId:string,fileName:string,language:string,detailLevel:string,createdAt:string,lastModified:string,modelName:string>>"
VOCABULARY = "version int, terms array<struct<id:string,word:string,aliases:array<string>,createdAt:string>>"


FILES = "folder string, file string, content string"


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, file, content) of the JSON and Markdown files of the meeting folders right below ``root``; ``file`` has ``actas/`` in front where it is a version of minutes."""
    globs = [g for g in (f"{root}/*/*.json", f"{root}/*/*.md", f"{root}/*/actas/*") if _exists(spark, g)]
    if not globs:
        return spark.createDataFrame([], FILES)
    path = F.col("_metadata.file_path")
    parts = spark.read.text(globs, wholetext=True).select(F.regexp_extract(path, r"^(.*?)/(?:actas/)?[^/]*$", 1).alias("folder"), F.regexp_extract(path, r"((?:actas/)?[^/]*)$", 1).alias("file"), F.col("value").alias("content"))
    return parts


def read_meetings(files: DataFrame) -> DataFrame:
    """Meetings of the folders that ``files`` holds, newest first, with their ``folder``.

    Folders being deleted (``.deleting_``) are passed over. A folder's document is
    ``*_meeting.json``, else ``meeting.json``, else the first JSON file that holds
    no parameters; files that do not parse are left out.
    """
    name = F.col("file")
    rank = F.when(name.endswith("_meeting.json"), 0).when(name == "meeting.json", 1).when(~name.rlike(r"(?:_params|parameters)\.json$"), 2)
    ranked = files.filter(name.endswith(".json") & ~F.contains(name, F.lit("/")) & ~F.col("folder").rlike(r"(?:^|/)\.deleting_[^/]*$")).withColumn("_rank", rank).filter("_rank IS NOT NULL")
    chosen = ranked.groupBy("folder").agg(F.min_by("content", F.struct("_rank", "file")).alias("content"))
    parsed = chosen.withColumn("m", F.from_json("content", MEETING + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("m.*", "folder").filter("_corrupt IS NULL AND id IS NOT NULL").drop("_corrupt").orderBy(F.desc("date"), F.desc_nulls_last("startTime"))


def meeting_by_id(meetings: DataFrame, meeting_id: str) -> DataFrame:
    """The meeting with exactly this id."""
    return meetings.filter(F.col("id") == meeting_id).limit(1)


def find_folder(files: DataFrame, meeting_id: str) -> DataFrame:
    """(folder) of a meeting: only folders named by the id's beginning are read, all others if none of them is it."""
    of = lambda some: read_meetings(some).filter(F.col("id") == meeting_id).select("folder")
    named = of(files.filter(F.contains("folder", F.lit(f"_{meeting_id[:6]}"))))
    return of(files) if named.isEmpty() else named


def _exists(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return bool(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path))


def transcript_rows(meetings: DataFrame) -> DataFrame:
    """(meeting_id, ord, seg_id, start_us, end_us, speaker_id, speaker_name, text, confidence, is_final)"""
    rows = meetings.select(F.col("id").alias("meeting_id"), F.posexplode("transcript").alias("ord", "s"))
    return rows.select("meeting_id", "ord", F.col("s.id").alias("seg_id"), parse_interval(F.col("s.startTime")).alias("start_us"), parse_interval(F.col("s.endTime")).alias("end_us"), F.col("s.speakerId").alias("speaker_id"), F.col("s.speakerDisplayName").alias("speaker_name"), "s.text", "s.confidence", F.col("s.isFinal").alias("is_final"))


def participant_rows(meetings: DataFrame) -> DataFrame:
    """(meeting_id, ord, speaker_id, display_name, color_hex)"""
    rows = meetings.select(F.col("id").alias("meeting_id"), F.posexplode("participants").alias("ord", "p"))
    return rows.select("meeting_id", "ord", F.col("p.id").alias("speaker_id"), F.col("p.displayName").alias("display_name"), F.col("p.colorHex").alias("color_hex"))


def acta_versions(files: DataFrame, meetings: DataFrame) -> DataFrame:
    """(folder, meeting_id, version_id, language, created_at, markdown, legacy)

    Versions of ``actas/index.json`` with the text of their files; a missing file
    falls back to the meeting's own minutes. A meeting without an index has one
    legacy version, its ``*_acta.md`` or the minutes in its document.
    """
    own = meetings.select("folder", F.col("id").alias("meeting_id"), F.col("actaMarkdown").alias("_own"))
    index = files.filter("file = 'actas/index.json'").select("folder", F.explode(F.from_json("content", VERSIONS)["versions"]).alias("v"))
    texts = files.filter(F.col("file").endswith(".md")).select("folder", "file", F.col("content").alias("_text"))
    listed = index.join(own, "folder").withColumn("file", F.concat(F.lit("actas/"), "v.fileName")).join(texts, ["folder", "file"], "left")
    listed = listed.select("folder", "meeting_id", F.col("v.id").alias("version_id"), F.col("v.language").alias("language"), F.col("v.createdAt").alias("created_at"), F.coalesce("_text", "_own").alias("markdown"), F.lit(False).alias("legacy"))
    beside = texts.filter(F.col("file").rlike(r"^[^/]*_acta\.md$")).groupBy("folder").agg(F.min_by("_text", "file").alias("_text"))
    none = F.lit(None).cast("string")
    alone = own.join(index.select("folder").distinct(), "folder", "left_anti")
    legacy = alone.join(beside, "folder", "left").withColumn("markdown", F.coalesce("_text", "_own")).filter(~none_or_blank(F.col("markdown")))
    legacy = legacy.select("folder", "meeting_id", F.concat(F.lit("legacy-"), "meeting_id").alias("version_id"), none.alias("language"), none.alias("created_at"), "markdown", F.lit(True).alias("legacy"))
    return listed.unionByName(legacy)


def clean_aliases(aliases: Column) -> Column:
    """Trimmed, without blanks and without later spellings that differ in case alone."""
    return first_spellings(F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), strip), lambda a: a != ""))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, word, aliases) of a ``{version, terms}`` file; blank words are left out."""
    terms = spark.read.schema(VOCABULARY).option("multiLine", True).json(path).select(F.posexplode("terms").alias("ord", "t"))
    return terms.filter(~none_or_blank(F.col("t.word"))).select("ord", strip(F.col("t.word")).alias("word"), clean_aliases(F.col("t.aliases")).alias("aliases"))


def vocabulary_json(terms: DataFrame) -> DataFrame:
    """(document): one vocabulary (a user's word list) as ``{version, terms}``."""
    a = F.array_sort(F.collect_list(F.struct("ord", "word", "aliases")))
    body = F.struct(F.lit(1).alias("version"), F.transform(a, lambda x: F.struct(x["word"].alias("word"), x["aliases"].alias("aliases"))).alias("terms"))
    return terms.agg(F.to_json(body).alias("document"))
