"""Speakers and participants: renaming, merging, resolving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def resolve_aliases(links: DataFrame) -> DataFrame:
    """(id, resolved) for links (id, target), one an id: each id's last target; in or before a cycle the cycle's least id.

    What is resolved doubles its reach every round, so after as many rounds as the
    number of links has binary digits only cycles are left.
    """
    state = cut(links.select("id", F.col("target").alias("resolved"), F.col("target").alias("least")))
    onward = lambda: state.select(F.col("id").alias("_id"), F.col("resolved").alias("_next"), F.col("least").alias("_least"))
    joined = lambda: state.join(onward(), F.col("resolved") == F.col("_id"), "left")
    going = F.col("_next").isNotNull() & (F.col("_next") != F.col("resolved"))
    for _ in range(state.count().bit_length() + 1):
        step = cut(joined())
        if step.filter(going).isEmpty():
            break
        state = step.select("id", F.coalesce("_next", "resolved").alias("resolved"), F.least("least", "_least").alias("least"))
    return joined().select("id", F.when(going, F.col("_least")).otherwise(F.col("resolved")).alias("resolved"))


def sync_participants(segments: DataFrame, participants: DataFrame) -> DataFrame:
    """Participants with the speakers added whom only the transcript has, in order of their first words."""
    known = participants.select("meeting_id", F.lower("speaker_id").alias("_k")).distinct()
    own = F.coalesce(F.nullif(F.trim("speaker_name"), F.lit("")), F.col("speaker_id"))
    first = segments.filter(F.trim("speaker_id") != "").groupBy("meeting_id", F.lower("speaker_id").alias("_k")).agg(F.min(F.struct("ord", "speaker_id", own.alias("display_name"))).alias("f"))
    new = first.join(known, ["meeting_id", "_k"], "left_anti").select("meeting_id", (F.col("f.ord") + 1_000_000).alias("ord"), "f.speaker_id", "f.display_name")
    return participants.select("meeting_id", "ord", "speaker_id", "display_name").unionByName(new)


def rename(segments: DataFrame, participants: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and participants after ``renames`` (meeting_id, speaker_id, new_name), one a meeting.

    A name that another participant has already merges both speakers under that
    participant; any other name is taken over, a blank one falls back to the id.
    """
    wanted = renames.select("meeting_id", F.lower("speaker_id").alias("_from"), F.coalesce(F.nullif(F.trim("new_name"), F.lit("")), F.col("speaker_id")).alias("_name"), F.col("speaker_id").alias("_own"))
    p = participants.select("meeting_id", F.col("ord").alias("_ord"), F.col("speaker_id").alias("_other"), F.col("display_name").alias("_other_name"))
    met = wanted.join(p, "meeting_id").filter((F.lower("_other") != F.col("_from")) & (F.lower("_other_name") == F.lower("_name")))
    into = met.groupBy("meeting_id", "_from").agg(F.min(F.struct("_ord", "_other", "_other_name")).alias("m"))
    plan = wanted.join(into, ["meeting_id", "_from"], "left").select("meeting_id", "_from", F.coalesce("m._other", "_own").alias("_id"), F.coalesce("m._other_name", "_name").alias("_name"), F.col("m").isNotNull().alias("_merged"))
    hit = F.lower("speaker_id") == F.col("_from")
    s = segments.join(plan, "meeting_id", "left")
    merged = F.coalesce(hit & F.col("_merged"), F.lit(False))
    s = s.withColumns({"speaker_id": F.when(merged, F.col("_id")).otherwise(F.col("speaker_id")), "speaker_name": F.when(F.coalesce(hit, F.lit(False)), F.col("_name")).otherwise(F.col("speaker_name"))}).select(*segments.columns)
    q = participants.join(plan, "meeting_id", "left")
    kept = q.filter(~F.coalesce(hit & F.col("_merged"), F.lit(False)))
    kept = kept.withColumn("display_name", F.when(F.coalesce(hit, F.lit(False)), F.col("_name")).otherwise(F.col("display_name"))).select(*participants.columns)
    return s, kept
