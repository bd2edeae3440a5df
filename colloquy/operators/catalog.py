"""Changes to the catalog as new tables: versions, vocabularies, participants, minutes, deletion, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import none_or_blank, strip
from ..sources.meetings import clean_aliases
from .timeline import overlaps

TECHNICAL = r"(?i)^(?:SPEAKER|HABLANTE|LOCUTOR)(?:[_\s\-]\d+|\d+)?$"


def delete_versions(versions: DataFrame, active: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining versions, and (meeting_id, version_id) active afterwards.

    versions (meeting_id, version_id, created_at), active (meeting_id, version_id),
    deleted (meeting_id, version_id). An active version that goes is replaced by
    the newest left, by null if none is.
    """
    left = versions.join(deleted, ["meeting_id", "version_id"], "left_anti")
    newest = left.groupBy("meeting_id").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("_newest"))
    gone = deleted.select("meeting_id", "version_id").distinct().withColumn("_gone", F.lit(True))
    now = active.join(gone, ["meeting_id", "version_id"], "left").join(newest, "meeting_id", "left")
    return left, now.select("meeting_id", F.when(F.col("_gone"), F.col("_newest")).otherwise(F.col("version_id")).alias("version_id"))


def upsert_vocabulary(terms: DataFrame, changes: DataFrame) -> DataFrame:
    """(ord, word, aliases): changed words get the new aliases, new words go behind (case ignored)."""
    k = F.lower(strip(F.col("word")))
    new = changes.filter(~none_or_blank(F.col("word"))).withColumn("k", k).groupBy("k").agg(F.max_by(F.struct("ord", strip(F.col("word")).alias("word"), clean_aliases(F.col("aliases")).alias("aliases")), "ord").alias("n"))
    old = terms.withColumn("k", k)
    both = old.join(new, "k", "full_outer")
    behind = F.lit(1_000_000_000) + F.col("n.ord")
    rows = both.select(F.coalesce("ord", behind).alias("ord"), F.coalesce("n.word", "word").alias("word"), F.coalesce("n.aliases", "aliases").alias("aliases"))
    return rows


def remove_terms(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Terms but those that (word) names, case ignored."""
    gone = words.select(F.lower(strip(F.col("word"))).alias("_k")).distinct()
    return terms.join(gone, F.lower("word") == F.col("_k"), "left_anti")


def merge_vocabulary(terms: DataFrame, imported: DataFrame) -> DataFrame:
    """(ord, word, aliases): words of both; a word of both has the aliases of both, first spellings first."""
    k = F.lower(strip(F.col("word")))
    shape = lambda df, side: df.filter(~none_or_blank(F.col("word"))).select(k.alias("k"), F.lit(side).alias("side"), "ord", strip(F.col("word")).alias("word"), "aliases")
    rows = shape(terms, 0).unionByName(shape(imported, 1)).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("side", "ord", "word", "aliases"))).alias("all"))
    first = F.get("all", F.lit(0))
    return rows.select((first["side"] * 1_000_000_000 + first["ord"]).alias("ord"), first["word"].alias("word"), clean_aliases(F.flatten(F.transform("all", lambda x: F.coalesce(x["aliases"], F.array())))).alias("aliases"))


def edit_participants(expected: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(meeting_id, ord, name) of expected participants after names are removed and added, case ignored."""
    k = F.lower(F.trim("name"))
    rows = expected.select("meeting_id", F.lit(0).alias("side"), "ord", F.trim("name").alias("name")).unionByName(added.select("meeting_id", F.lit(1).alias("side"), "ord", F.trim("name").alias("name")))
    rows = rows.filter(F.col("name") != "").withColumn("k", k).join(removed.select("meeting_id", k.alias("k")).distinct(), ["meeting_id", "k"], "left_anti")
    first = rows.groupBy("meeting_id", "k").agg(F.min(F.struct("side", "ord", "name")).alias("f"))
    place = F.row_number().over(W.partitionBy("meeting_id").orderBy("f.side", "f.ord", "f.name")) - 1
    return first.select("meeting_id", place.alias("ord"), "f.name")


def edit_minutes(versions: DataFrame, edits: DataFrame) -> DataFrame:
    """Versions (meeting_id, version_id, markdown, original, modified) after edits (meeting_id, version_id, markdown, at), with ``can_restore``.

    An edit without markdown restores the original; the first edit keeps what it replaces as the original.
    """
    e = edits.groupBy("meeting_id", "version_id").agg(F.max_by(F.struct("markdown", "at"), "at").alias("e"))
    v = versions.join(e, ["meeting_id", "version_id"], "left")
    original = F.when(F.col("e").isNotNull(), F.coalesce("original", "markdown")).otherwise(F.col("original"))
    now = F.when(F.col("e").isNull(), F.col("markdown")).otherwise(F.coalesce("e.markdown", "original", "markdown"))
    out = v.select("meeting_id", "version_id", now.alias("markdown"), original.alias("original"), F.coalesce("e.at", "modified").alias("modified"))
    return out.withColumn("can_restore", F.coalesce(~none_or_blank(F.col("original")) & (F.col("original") != F.col("markdown")), F.lit(False)))


def identity_scores(segments: DataFrame, spans: DataFrame, participants: DataFrame, old_centroids: DataFrame, new_centroids: DataFrame) -> DataFrame:
    """(meeting_id, ord, name, new_ord, new_speaker, cosine, iou, recall) of each named participant and each new speaker of a meeting.

    Shared time comes from the binned interval join; the pairs are those of one
    meeting's few speakers. Centroids are (meeting_id, speaker_id, vector).
    """
    named = participants.filter(~none_or_blank(F.col("display_name")) & ~F.trim("display_name").rlike(TECHNICAL) & ~none_or_blank(F.col("speaker_id")))
    named = named.select("meeting_id", "ord", F.col("display_name").alias("name"), F.lower("speaker_id").alias("old"))
    length = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(10_000))
    old_time = segments.groupBy("meeting_id", F.lower("speaker_id").alias("old")).agg(F.sum(length).alias("old_us"))
    new = spans.groupBy("meeting_id", F.lower("speaker_id").alias("new")).agg(F.sum(length).alias("new_us"), F.min("ord").alias("new_ord"), F.min_by("speaker_id", "ord").alias("new_speaker"))
    met = overlaps(segments.select("meeting_id", "ord", "speaker_id", "start_us", "end_us"), spans.select("meeting_id", "ord", "speaker_id", "start_us", "end_us"))
    shared = met.groupBy("meeting_id", F.lower("speaker_id").alias("old"), F.lower("b_speaker_id").alias("new")).agg(F.sum(F.least("end_us", "b_end_us") - F.greatest("start_us", "b_start_us")).alias("shared_us"))
    pairs = named.join(new, "meeting_id").join(old_time, ["meeting_id", "old"], "left").join(shared, ["meeting_id", "old", "new"], "left")
    pairs = pairs.join(old_centroids.select("meeting_id", F.lower("speaker_id").alias("old"), F.col("vector").alias("a")), ["meeting_id", "old"], "left")
    pairs = pairs.join(new_centroids.select("meeting_id", F.lower("speaker_id").alias("new"), F.col("vector").alias("b")), ["meeting_id", "new"], "left")
    both, old_us = F.coalesce("shared_us", F.lit(0)), F.coalesce("old_us", F.lit(0))
    cosine = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), vectors.cosine(F.col("a"), F.col("b")))
    share = lambda x: F.coalesce(F.try_divide(both.cast("double"), x), F.lit(0.0))
    return pairs.select("meeting_id", "ord", "name", "new_ord", "new_speaker", cosine.alias("cosine"), share(old_us + F.col("new_us") - both).alias("iou"), share(old_us).alias("recall"))
