"""Interval joins, as-of lookup and run merging over transcript timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN_US = 10_000_000


def overlaps(a: DataFrame, b: DataFrame, key: str = "meeting_id", bin_us: int = BIN_US) -> DataFrame:
    """Pairs of rows of a key whose intervals overlap, as columns of a and of b (prefixed ``b_``).

    Both sides are cut to time bins, so the join is one on (key, bin) and not all
    pairs of a key; a pair counts in the first bin that both are in.
    """
    bins = lambda start, end: F.sequence(F.floor(start / bin_us), F.floor(F.greatest(end - 1, start) / bin_us))
    left = a.withColumn("_bin", F.explode(bins(F.col("start_us"), F.col("end_us"))))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    right = right.withColumn("_b_bin", F.explode(bins(F.col("b_start_us"), F.col("b_end_us"))))
    first = F.floor(F.greatest("start_us", "b_start_us") / bin_us)
    joined = left.join(right, (F.col(key) == F.col(f"b_{key}")) & (F.col("_bin") == F.col("_b_bin")))
    met = (F.least("end_us", "b_end_us") > F.greatest("start_us", "b_start_us")) & (F.col("_bin") == first)
    return joined.filter(met).drop("_bin", "_b_bin", f"b_{key}")


def overlap_argmax(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(meeting_id, ord, speaker, overlap_us): who speaks most in each segment; ties: the earlier span."""
    met = overlaps(segments.select("meeting_id", "ord", "start_us", "end_us"), spans.select("meeting_id", "ord", "speaker_id", "start_us", "end_us"))
    shared = F.least("end_us", "b_end_us") - F.greatest("start_us", "b_start_us")
    by = met.groupBy("meeting_id", "ord", F.lower("b_speaker_id").alias("k")).agg(F.sum(shared).alias("overlap_us"), F.min(F.struct("b_ord", "b_speaker_id")).alias("first"))
    best = by.groupBy("meeting_id", "ord").agg(F.max_by(F.struct("first", "overlap_us"), F.struct(F.col("overlap_us"), -F.col("first.b_ord"))).alias("best"))
    return best.select("meeting_id", "ord", F.col("best.first.b_speaker_id").alias("speaker"), F.col("best.overlap_us").alias("overlap_us"))


def nearest_span(segments: DataFrame, spans: DataFrame, within_us: int) -> DataFrame:
    """(meeting_id, ord, speaker, distance_us): the span with the smallest gap below ``within_us``; ties: the earlier one."""
    wide = segments.select("meeting_id", "ord", (F.col("start_us") - within_us).alias("start_us"), (F.col("end_us") + within_us).alias("end_us"))
    met = overlaps(wide, spans.select("meeting_id", "ord", "speaker_id", "start_us", "end_us"))
    start, end = F.col("start_us") + within_us, F.col("end_us") - within_us
    gap = F.greatest(F.lit(0), start - F.col("b_end_us"), F.col("b_start_us") - end)
    near = met.withColumn("distance_us", gap).filter(F.col("distance_us") < within_us)
    best = near.groupBy("meeting_id", "ord").agg(F.min(F.struct("distance_us", "b_ord", "b_speaker_id")).alias("best"))
    return best.select("meeting_id", "ord", F.col("best.b_speaker_id").alias("speaker"), F.col("best.distance_us").alias("distance_us"))


def as_of(positions: DataFrame, segments: DataFrame, fallback_us: int = 3_000_000) -> DataFrame:
    """(meeting_id, pos_us, ord): the last segment begun by then, null once it has ended.

    One sort of both sides by time, no range join. A segment without a length counts ``fallback_us``.
    """
    end = F.when(F.col("end_us") > F.col("start_us"), F.col("end_us")).otherwise(F.col("start_us") + fallback_us)
    begun = segments.select("meeting_id", F.col("start_us").alias("t"), F.lit(0).alias("kind"), "ord", end.alias("until"))
    asked = positions.select("meeting_id", F.col("pos_us").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("long").alias("until"))
    w = W.partitionBy("meeting_id").orderBy("t", "kind", "ord").rowsBetween(W.unboundedPreceding, 0)
    seen = begun.unionByName(asked).withColumn("last", F.last(F.when(F.col("kind") == 0, F.struct("ord", "until")), ignorenulls=True).over(w))
    return seen.filter("kind = 1").select("meeting_id", F.col("t").alias("pos_us"), F.when(F.col("t") < F.col("last.until"), F.col("last.ord")).alias("ord"))


def islands(df: DataFrame, key: list[str], order: list, begins: Column) -> DataFrame:
    """``df`` with ``island``, a number that grows at every row where ``begins`` holds."""
    return df.withColumn("island", F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def smooth_merge(spans: DataFrame, min_us: int = 250_000, gap_us: int = 500_000) -> DataFrame:
    """(meeting_id, speaker_id, start_us, end_us): short spans dropped, neighbours of one speaker merged over short gaps."""
    kept = spans.filter((F.col("end_us") > F.col("start_us")) & (F.col("end_us") - F.col("start_us") >= min_us) & (F.trim("speaker_id") != ""))
    order = ["start_us", "ord"]
    w = W.partitionBy("meeting_id").orderBy(*order)
    runs = islands(kept, ["meeting_id"], order, F.lag("speaker_id").over(w) != F.col("speaker_id")).withColumnRenamed("island", "run")
    ended = F.max("end_us").over(W.partitionBy("meeting_id", "run").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    parts = runs.withColumn("gap", F.col("start_us") - ended)
    parts = islands(parts, ["meeting_id"], order, F.col("gap").isNull() | (F.col("gap") > gap_us))
    return parts.groupBy("meeting_id", "island").agg(F.first("speaker_id").alias("speaker_id"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("island")


def threshold_runs(frames: DataFrame, active: Column, key: str = "audio_id") -> DataFrame:
    """(key, first_frame, last_frame, n) of each unbroken run of active frames."""
    on = frames.filter(active)
    w = W.partitionBy(key).orderBy("frame")
    runs = islands(on, [key], ["frame"], F.lag("frame").over(w) + 1 != F.col("frame"))
    return runs.groupBy(key, "island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n")).drop("island")


def dedupe_consecutive(segments: DataFrame) -> DataFrame:
    """Segments but those that repeat the speaker and text of the non-blank one before."""
    w = W.partitionBy("meeting_id").orderBy("ord")
    rows = segments.filter(F.trim("text") != "")
    same = (F.lag(F.lower("speaker_id")).over(w) == F.lower("speaker_id")) & (F.lag(F.lower("text")).over(w) == F.lower("text"))
    return rows.withColumn("_same", same).filter(F.coalesce(~F.col("_same"), F.lit(True))).drop("_same")
