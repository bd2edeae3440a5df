"""Transcript tables over the generic tables, the same in Spark and in SQL.

conversations are transcripts: 400 ms a word, a pause of 4 s after every fourth
turn and of 0.8 s else; two speakers take two turns each. Spans are the segments
300 ms later, with the speakers of every third turn swapped. events are frames
of speech probabilities by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import count_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, ord, speaker_id, speaker_name, text, words, start_us, end_us)"""
    c = table(spark, sf_dir, "conversations").withColumn("words", count_words(F.col("text")))
    dur, gap = F.col("words") * 400_000, F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, 4_000_000).otherwise(800_000)
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(dur + gap).over(before), F.lit(0))
    speaker = F.concat(F.lit("SPEAKER_0"), (F.floor(F.col("turn") / 2) % 2).cast("string"))
    out = c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("ord"), speaker.alias("speaker_id"), F.initcap("role").alias("speaker_name"), "text", "words", start.alias("start_us"), dur.alias("dur"))
    return out.select("meeting_id", "ord", "speaker_id", "speaker_name", "text", "words", "start_us", (F.col("start_us") + F.col("dur")).alias("end_us"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, ord, speaker_id, start_us, end_us), no two at once"""
    s = segments(spark, sf_dir)
    other = F.when(F.col("speaker_id") == "SPEAKER_00", "SPEAKER_01").otherwise("SPEAKER_00")
    return s.select("meeting_id", "ord", F.when(F.col("ord") % 3 == 2, other).otherwise(F.col("speaker_id")).alias("speaker_id"), (F.col("start_us") + 300_000).alias("start_us"), (F.col("end_us") + 300_000).alias("end_us"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(audio_id, frame, prob)"""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("audio_id"), (F.row_number().over(order) - 1).alias("frame"), F.least(F.col("value") / 200.0, F.lit(1.0)).alias("prob"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, title, date, start_us, end_us, n_segments)"""
    m = segments(spark, sf_dir).groupBy("meeting_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_segments"))
    title = F.concat(F.lit("Reunion: "), F.col("meeting_id").cast("string"), F.lit("/semana "), (F.col("meeting_id") % 52).cast("string"))
    return m.select("meeting_id", title.alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("meeting_id") % 365).cast("int")).alias("date"), "start_us", "end_us", "n_segments")


SEGMENTS = """
seg0 AS (SELECT conv_id AS meeting_id, turn AS ord, upper(role[1]) || lower(role[2:]) AS speaker_name, text,
  len(list_filter(string_split_regex(text, '\\s+'), lambda x: len(x) > 0)) AS words FROM conversations),
seg AS (SELECT meeting_id, ord, 'SPEAKER_0' || ((ord // 2) % 2) AS speaker_id, speaker_name, text, words,
  coalesce(sum(400000 * words + CASE WHEN (meeting_id + ord) % 4 = 0 THEN 4000000 ELSE 800000 END)
    OVER (PARTITION BY meeting_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_us FROM seg0),
segments AS (SELECT *, start_us + 400000 * words AS end_us FROM seg),
spans AS (SELECT meeting_id, ord, CASE WHEN ord % 3 = 2 THEN CASE WHEN speaker_id = 'SPEAKER_00' THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END ELSE speaker_id END AS speaker_id,
  start_us + 300000 AS start_us, end_us + 300000 AS end_us FROM segments)
"""
MEETINGS = """
meetings AS (SELECT meeting_id, 'Reunion: ' || meeting_id || '/semana ' || (meeting_id % 52) AS title, DATE '2024-01-01' + (meeting_id % 365)::INT AS date,
  min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_segments FROM segments GROUP BY meeting_id)
"""
FRAMES = """
frames AS (SELECT user_id AS audio_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, least(value / 200.0, 1.0) AS prob FROM events)
"""
WITH = "WITH " + SEGMENTS
