"""Transcript files: SubRip, WebVTT, stamped lines, Markdown headings and plain paragraphs.

Each parser is an expression over the whole file's text and gives an array of
``SEGMENT``; ``read_transcripts`` picks the first format that yields anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, none_or_blank, strip

SEGMENT = "struct<start_us:bigint,end_us:bigint,speaker:string,text:string>"
SECOND = 1_000_000
SLOT = 5 * SECOND
# The stamps, lines, headings and tags of the formats.
SRT_STAMP = r"(\d+):(\d{2}):(\d{2}),(\d{3})\s+-->\s+(\d+):(\d{2}):(\d{2}),(\d{3})"
VTT_STAMP = r"(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})\s+-->\s+(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})"
LINE = r"(?m)^\[(\d+):(\d{2}):(\d{2})\]\s+([^:]+?)\s*:\s*(.+)$"
HEADING = r"^#{1,4}\s+(\d+):(\d{2}):(\d{2})\s+[—\-]\s+(.+)$"
TAG = r"^(\[[^\]]+\]|<v\s+[^>]+>)"

# File extensions that can be read.
AUDIO_FORMATS = "mp3 wav m4a aac wma flac ogg mp4".split()
TEXT_FORMATS = "txt md markdown text log rst org adoc asciidoc csv tsv srt vtt".split()


def _none() -> Column:
    return F.array().cast(f"array<{SEGMENT}>")


def _segment(start: Column, end: Column, speaker: Column, text: Column) -> Column:
    return F.struct(start.alias("start_us"), end.alias("end_us"), speaker.alias("speaker"), text.alias("text"))


def _offset(text: Column, pattern: str, first: int, millis: bool) -> Column:
    """Microseconds from the groups hours (may be missing), minutes, seconds and milliseconds."""
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("long"), F.lit(0))
    seconds = (part(first) * 60 + part(first + 1)) * 60 + part(first + 2)
    return seconds * SECOND + (part(first + 3) * 1000 if millis else 0)


def _cues(content: Column, stamp: str, cleaned) -> Column:
    """Blocks between blank lines; in each the first stamp, then text, perhaps with a speaker's tag in front."""

    def texts(x: Column) -> Column:
        body = F.filter(F.transform(F.slice(x["lines"], x["at"] + 1, F.size(x["lines"])), cleaned), lambda t: t != "")
        return F.when((x["at"] > 0) & (F.size(body) > 0), let(F.struct(F.get(x["lines"], x["at"] - 1).alias("stamp"), body.alias("body"), F.regexp_extract(F.get(body, F.lit(0)), TAG, 1).alias("tag")), spoken))

    def spoken(x: Column) -> Column:
        head = strip(F.substring(F.get(x["body"], F.lit(0)), F.length(x["tag"]) + 1, F.length(F.get(x["body"], F.lit(0)))))
        parts = F.filter(F.concat(F.array(head), F.slice(x["body"], 2, F.size(x["body"]))), lambda t: t != "")
        speaker = strip(F.regexp_replace(x["tag"], r"^\[|\]$|^<v\s+|>$", ""))
        return F.when(F.size(parts) > 0, _segment(_offset(x["stamp"], stamp, 1, True), _offset(x["stamp"], stamp, 5, True), speaker, F.array_join(parts, " ")))

    def block(b: Column) -> Column:
        lines = F.transform(F.split(strip(b), "\n"), strip)
        return let(lines, lambda ls: let(F.struct(ls.alias("lines"), F.array_position(F.transform(ls, lambda x: x.rlike(stamp)), F.lit(True)).cast("int").alias("at")), texts))

    return F.filter(F.transform(F.split(strip(content), r"\r?\n\r?\n"), block), lambda s: s.isNotNull())


def parse_srt(content: Column) -> Column:
    return _cues(content, SRT_STAMP, lambda line: line)


def parse_vtt(content: Column) -> Column:
    """Tags go before speakers are looked for, so that only ``[x]`` names one, never ``<v x>``."""
    cues = _cues(content, VTT_STAMP, lambda line: strip(F.regexp_replace(line, r"<[^>]+>", "")))
    return F.when(strip(content).rlike(r"^(?i)WEBVTT"), cues).otherwise(_none())


def parse_stamped_lines(content: Column) -> Column:
    """``[h:mm:ss] speaker: text``; a segment lasts until the next begins, the last one five seconds."""
    found = F.transform(F.regexp_extract_all(content, F.lit(LINE), F.lit(0)), lambda m: F.struct(_offset(m, LINE, 1, False).alias("at"), strip(F.regexp_extract(m, LINE, 4)).alias("speaker"), strip(F.regexp_extract(m, LINE, 5)).alias("text")))
    return let(found, lambda a: F.transform(a, lambda x, i: _segment(x["at"], F.coalesce(F.get(a, i + 1)["at"], x["at"] + SLOT), x["speaker"], x["text"])))


def parse_markdown(content: Column) -> Column:
    """``### h:mm:ss — speaker`` with the text below; a heading without text only ends the segment above it."""

    def sections(lines: Column) -> Column:
        marked = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
        heads = F.filter(marked, lambda x: x["line"].rlike(HEADING))
        return let(F.struct(lines.alias("lines"), heads.alias("heads")), bodies)

    def bodies(x: Column) -> Column:
        lines, heads = x["lines"], x["heads"]

        def section(h: Column, i: Column) -> Column:
            following = F.get(heads, i + 1)
            size = F.coalesce(following["i"], F.size(lines)) - h["i"] - 1
            text = F.filter(F.transform(F.slice(lines, h["i"] + 2, size), strip), lambda t: (t != "") & ~t.startswith("#"))
            start = _offset(h["line"], HEADING, 1, False)
            end = F.when(following.isNotNull(), _offset(following["line"], HEADING, 1, False)).otherwise(start + SLOT)
            return _segment(start, end, strip(F.regexp_extract(h["line"], HEADING, 4)), F.array_join(text, " "))

        return F.filter(F.transform(heads, section), lambda s: s["text"] != "")

    return let(F.transform(F.split(content, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"\r$", ""))), sections)


def parse_plain(content: Column) -> Column:
    """Paragraphs in slots of five seconds, without speakers."""
    parts = F.filter(F.transform(F.split(strip(content), r"\r?\n\s*\r?\n"), strip), lambda p: p != "")
    slot = lambda i: i.cast("long") * SLOT
    return F.transform(parts, lambda p, i: _segment(slot(i), slot(i + 1), F.lit(""), p))


def parse_any(content: Column) -> Column:
    """The first of the formats that finds a segment; blank content has none."""
    some = lambda a: F.when(F.size(a) > 0, a)
    found = F.coalesce(*[some(parse(content)) for parse in (parse_srt, parse_vtt, parse_stamped_lines, parse_markdown)], parse_plain(content))
    return F.when(none_or_blank(content), _none()).otherwise(found)


def exploded(files: DataFrame, parsed: Column, *keep: str) -> DataFrame:
    """``keep`` columns, ord, start_us, end_us, speaker, text."""
    rows = files.select(*keep, F.posexplode(parsed).alias("ord", "_s"))
    return rows.select(*keep, "ord", "_s.start_us", "_s.end_us", "_s.speaker", "_s.text")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, start_us, end_us, speaker, text) of all text files under a path, a row a segment."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return exploded(files, parse_any(F.col("content")), "path")


def supported(name: Column, formats: list[str]) -> Column:
    """Whether a file name, or a bare extension, is one of the formats; null is not."""
    return F.coalesce(F.lower(F.regexp_extract(strip(name), r"([^.\\/]*)$", 1)).isin(formats), F.lit(False))
