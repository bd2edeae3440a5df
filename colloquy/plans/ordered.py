"""Queries over ordered folds, clustering, signals and replayed streams."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import audio, catalog, clustering, folds
from ..streaming import live
from .derived import FRAMES, WITH, frames, segments, spans, table
from .registry import query


@query()
def fold_consolidate(spark, sf):
    return folds.consolidate(segments(spark, sf))


@query()
def fold_chunk(spark, sf):
    return folds.chunk(segments(spark, sf), target_tokens=60, target_us=120_000_000)


@query()
def fold_vad_regions(spark, sf):
    return folds.speech_regions(frames(spark, sf)).withColumn("mean_prob", F.round("mean_prob", 4))


CARRY = """n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS rn, greatest(10000, end_us - start_us) AS length FROM segments),
sh AS (SELECT n.meeting_id, n.rn, lower(p.speaker_id) AS k, min_by(p.speaker_id, p.ord) AS name, sum(least(n.end_us, p.end_us) - greatest(n.start_us, p.start_us)) AS shared, min(p.ord) AS first FROM n JOIN spans p ON p.meeting_id = n.meeting_id AND least(n.end_us, p.end_us) > greatest(n.start_us, p.start_us) GROUP BY ALL),
best AS (SELECT meeting_id, rn, max_by(name, (shared, -first)) AS name, max(shared) AS shared, list(k) AS known FROM sh GROUP BY ALL),
near AS (SELECT n.meeting_id, n.rn, min_by(p.speaker_id, (greatest(0, p.start_us - n.end_us, n.start_us - p.end_us), p.ord)) AS name FROM n JOIN spans p ON p.meeting_id = n.meeting_id AND greatest(0, p.start_us - n.end_us, n.start_us - p.end_us) < 1500000 GROUP BY ALL),
x AS (SELECT n.meeting_id, n.rn, n.ord, n.start_us, n.end_us, best.name AS best, best.shared / length < 0.35 AS little, known, near.name AS near FROM n LEFT JOIN best USING (meeting_id, rn) LEFT JOIN near USING (meeting_id, rn)),
r AS (SELECT meeting_id, rn, ord, start_us, end_us, coalesce(best, near, 'SPEAKER_00') AS speaker FROM x WHERE rn = 1 UNION ALL
  SELECT x.meeting_id, x.rn, x.ord, x.start_us, x.end_us, CASE WHEN best IS NULL THEN coalesce(near, r.speaker, 'SPEAKER_00') WHEN little AND list_contains(known, lower(r.speaker)) THEN r.speaker ELSE best END FROM r JOIN x ON x.meeting_id = r.meeting_id AND x.rn = r.rn + 1)"""


@query(f"{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {CARRY} SELECT meeting_id, ord, start_us, end_us, speaker FROM r")
def jn_overlap_carry(spark, sf):
    return folds.align(segments(spark, sf), spans(spark, sf), split=False).drop("part", "text")


@query()
def jn_split_dialogue(spark, sf):
    return folds.align(segments(spark, sf), spans(spark, sf))


def _voices(spark, sf, people):
    """(meeting_id, speaker_id, vector) before and after: two vectors a meeting; in every third meeting the voices change places, in every fourth some are unknown."""
    place = F.col("meeting_id") * 2 + F.when(F.col("speaker_id") == "SPEAKER_00", 0).otherwise(1)
    other = F.col("meeting_id") * 2 + F.when(F.col("speaker_id") == "SPEAKER_00", 1).otherwise(0)
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    of = lambda at: people.select("meeting_id", "speaker_id", at.alias("vec_id")).join(e, "vec_id").select("meeting_id", "speaker_id", "vector")
    return of(place), of(F.when(F.col("meeting_id") % 3 == 0, other).when(F.col("meeting_id") % 4 != 1, place))


@query()
def jn_identity_transfer(spark, sf):
    s, p = segments(spark, sf), spans(spark, sf)
    people = s.groupBy("meeting_id", "speaker_id").agg(F.min("ord").alias("ord"), F.min_by("speaker_name", "ord").alias("display_name"))
    return folds.transfer_identities(catalog.identity_scores(s, p, people, *_voices(spark, sf, people)))


def _voiced(spark, sf, size: int = 200):
    """Vectors by meeting: two hundred ids are one."""
    return table(spark, sf, "embeddings").withColumn("meeting_id", F.floor(F.col("vec_id") / size))


@query()
def ml_ahc(spark, sf):
    return clustering.cluster_meetings(_voiced(spark, sf), lambda x: clustering.agglomerate(clustering.unit_rows(x), 0.9))


@query()
def ml_vbx(spark, sf):
    return clustering.cluster_meetings(_voiced(spark, sf), lambda x: clustering.speakers(x, threshold=0.9))


@query()
def ml_kmeans(spark, sf):
    def nearest(x: np.ndarray) -> np.ndarray:
        c = clustering.k_means(x, 3)
        return np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)

    return clustering.cluster_meetings(_voiced(spark, sf), nearest)


@query()
def ml_hungarian(spark, sf):
    """The vectors of each meeting (eight ids) to dimensions, one to one."""
    return clustering.cluster_meetings(_voiced(spark, sf, 8), clustering.assign_best)


@query()
def ml_assign_local(spark, sf):
    """Three local speakers a chunk to three centroids; the third of every chunk is silent."""
    e = table(spark, sf, "embeddings").withColumn("chunk", F.floor(F.col("vec_id") / 3))
    centroids = np.eye(3, 64)
    return clustering.cluster_meetings(e, lambda x: clustering.assign_local(x, np.arange(len(x), 0, -1) - 1.0, centroids), "chunk")


@query("SELECT label, least(greatest(count(*), 1), 8) AS speakers FROM embeddings GROUP BY label")
def ml_num_speakers(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.least(F.greatest(F.count("*"), F.lit(1)), F.lit(8)).alias("speakers"))


@query()
def ml_plda(spark, sf):
    """Vectors through a fixed projection, then clustered by linkage."""
    rng = np.random.default_rng(3)
    plda = clustering.Plda(np.zeros(64), np.zeros(32), rng.normal(size=(64, 32)), np.zeros(32), np.eye(32), np.ones(32))
    return clustering.cluster_meetings(_voiced(spark, sf), lambda x: clustering.agglomerate(clustering.unit_rows(plda.project(x)), 1.0))


RATES, TIMES = (8_000, 16_000, 32_000), 300


def _recordings(spark, sf):
    """16-bit WAV files of the vectors' components, repeated: three rates, one channel or two."""
    number = lambda c: F.pmod(F.floor(c * 10_000), F.lit(65_536)).cast("int")
    little = lambda c: F.concat(F.lpad(F.hex(number(c) % 256), 2, "0"), F.lpad(F.hex(F.floor(number(c) / 256)), 2, "0"))
    e = table(spark, sf, "embeddings")
    data = F.unhex(F.repeat(F.array_join(F.transform(F.col("embedding").cast("array<double>"), little), ""), TIMES))
    size = 64 * TIMES * 2
    heads = [struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVEfmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", size) for rate in RATES for channels in (1, 2)]
    head = F.get(F.array(*[F.lit(h) for h in heads]), (F.col("vec_id") % len(heads)).cast("int"))
    return e.select(F.col("vec_id").alias("audio_id"), F.concat(head, data).alias("content"))


@query()
def sig_fbank(spark, sf):
    """The first value and the frames of every chunk of features, over recordings in blocks."""
    bank = audio.filterbank_seconds(audio.decode_blocks(_recordings(spark, sf), 1, overlap=signal.FRAME - signal.HOP))
    done = audio.normalised_chunks(bank)
    return done.select(F.col("audio_id").alias("vec_id"), "chunk", "frames", F.round(F.get(F.get("mels", F.lit(0)), F.lit(0)), 4).alias("first"))


DECODED = """r AS (SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 10000)) AS v, [8000, 8000, 16000, 16000, 32000, 32000][(vec_id % 6 + 1)::INT] AS rate, vec_id % 2 + 1 AS channels FROM embeddings),
n AS (SELECT *, 19200 // channels AS n, rate / 16000.0::DOUBLE AS ratio FROM r),
k AS (SELECT *, unnest(range(floor(n / ratio)::BIGINT)) AS k FROM n),
p AS (SELECT *, floor(k * ratio)::BIGINT AS low, least(floor(k * ratio)::BIGINT + 1, n - 1) AS high FROM k),
x AS (SELECT vec_id, k, k * ratio - low AS part, CASE WHEN channels = 1 THEN v[low % 64 + 1] ELSE (v[2 * low % 64 + 1] + v[(2 * low + 1) % 64 + 1]) / 2 END / 32768 AS a, CASE WHEN channels = 1 THEN v[high % 64 + 1] ELSE (v[2 * high % 64 + 1] + v[(2 * high + 1) % 64 + 1]) / 2 END / 32768 AS b FROM p)"""


@query(f"WITH {DECODED} SELECT vec_id, k // 16000 AS block, count(*) AS n, sum((a + (b - a) * part) * (1 + k % 16000 % 7)) AS weighed FROM x GROUP BY ALL")
def src_audio_decode(spark, sf):
    """Recordings of several rates and channels in blocks of a second: each block's samples, weighed by their places."""
    blocks = audio.decode_blocks(_recordings(spark, sf), 1)
    weighed = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (1 + i % 7)), F.lit(0.0), lambda s, x: s + x)
    return blocks.select(F.col("audio_id").alias("vec_id"), "block", F.size("samples").cast("long").alias("n"), weighed.alias("weighed"))


# Streams, replayed over tables: the same processors as on a stream


def _live(spark, sf):
    s = segments(spark, sf)
    return s.select(F.col("meeting_id").cast("string").alias("meeting_id"), F.col("ord").alias("seq"), F.concat(F.lit("s"), F.col("ord").cast("string")).alias("seg_id"), "speaker_id", "speaker_name", "text", F.col("start_us").cast("long").alias("start_us"), F.col("end_us").cast("long").alias("end_us"))


@query()
def fold_append_live(spark, sf):
    return live.run(_live(spark, sf), "meeting_id", live.Transcript())


SESSIONS = """f AS (SELECT audio_id::VARCHAR AS meeting_id, frame + 1 AS i, (frame + 1) * 512 AS pos, prob FROM frames),
r AS (SELECT meeting_id, 0 AS i, false AS speaking, 0 AS quiet, NULL::VARCHAR AS event, 0 AS sample, 0.0::DOUBLE AS prob FROM (SELECT DISTINCT meeting_id FROM f) UNION ALL
  SELECT meeting_id, i, prob >= 0.5 OR (speaking AND NOT past), CASE WHEN prob >= 0.5 OR past THEN 0 ELSE since END, CASE WHEN prob >= 0.5 AND NOT speaking THEN 'start' WHEN past THEN 'end' END, pos, prob
  FROM (SELECT *, prob < 0.35 AND speaking AND pos - since >= 20800 AS past FROM (SELECT f.*, r.speaking, CASE WHEN f.prob < 0.35 AND r.speaking AND r.quiet = 0 THEN f.pos ELSE r.quiet END AS since FROM r JOIN f ON f.meeting_id = r.meeting_id AND f.i = r.i + 1)))"""


@query(f"WITH RECURSIVE {FRAMES}, {SESSIONS} SELECT meeting_id, event, sample, prob FROM r WHERE event IS NOT NULL")
def st_vad_session(spark, sf):
    f = frames(spark, sf).select(F.col("audio_id").cast("string").alias("meeting_id"), F.col("frame").alias("seq"), "prob")
    return live.run(f, "meeting_id", live.SpeechSessions())


@query()
def st_utterance(spark, sf):
    """Chunks of 100 ms whose loudness follows the events; speech from 0.5 on."""
    f = frames(spark, sf).withColumn("loud", F.col("prob") >= 0.5)
    before = F.lag("loud", 1, False).over(W.partitionBy("audio_id").orderBy("frame"))
    event = F.when(F.col("loud") & ~before, "start").when(~F.col("loud") & before, "end").otherwise("")
    rows = f.select(F.col("audio_id").cast("string").alias("meeting_id"), F.col("frame").alias("seq"), F.lit(1600).alias("n_samples"), (F.col("prob") / 10).alias("rms"), (F.col("prob") / 10).alias("mic_rms"), F.lit(0.0).alias("sys_rms"), event.alias("event"))
    return live.run(rows, "meeting_id", live.Utterances())


@query()
def st_two_stream_mix(spark, sf):
    """Mixed chunks of every user's events, 800 samples each; a flush behind the last event sends one last chunk of what waits."""
    e = table(spark, sf, "events")
    # events are dealt out by the streams' key and put in order before they get samples
    e = e.select(F.col("user_id").cast("string").alias("meeting_id"), "ts", "event_id", "value")
    order = W.partitionBy("meeting_id").orderBy("ts", "event_id")
    e = e.withColumns({"seq": F.row_number().over(order), "last": F.lead(F.lit(False), 1, True).over(order)})
    source = F.when(F.col("event_id") % 2 == 0, "mic").otherwise("sys")
    sources = F.when(F.col("last"), F.array(source, F.lit("flush"))).otherwise(F.array(source))
    e = e.select("meeting_id", "seq", "value", F.explode(sources).alias("source"))
    flush = F.col("source") == "flush"
    samples = F.when(flush, F.array().cast("array<double>")).otherwise(F.array_repeat(F.col("value") / 1000, 800))
    rows = e.select("meeting_id", (F.col("seq") + flush.cast("int")).alias("seq"), "source", samples.alias("samples"))
    out = live.run(rows, "meeting_id", live.Mixer())
    return out.select("meeting_id", "chunk", "dominant", F.round("mic_rms", 6).alias("mic_rms"), F.round("sys_rms", 6).alias("sys_rms"))


@query()
def st_live_clean(spark, sf):
    terms = [("ze", "the"), ("ent", "and"), ("uhf", "of"), ("dele", "de"), ("lla", "la"), ("ke", "que"), ("unt", "und"), ("dy", "die")]
    return live.clean_live(_live(spark, sf), terms).select("meeting_id", "seq", "text")


@query("WITH e AS (SELECT user_id::VARCHAR AS meeting_id, event_id % 5 AS seg, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type FROM events) SELECT meeting_id, seq, seg::VARCHAR AS seg_id, CASE WHEN v = 0 THEN 'appended' ELSE 'updated' END AS change, v AS version, event_type AS text FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, seg ORDER BY seq) - 1 AS v FROM e)")
def st_upsert(spark, sf):
    """Every event updates one of five segments of its user, or appends it."""
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("meeting_id"), seq.cast("long").alias("seq"), (F.col("event_id") % 5).cast("string").alias("seg_id"), F.col("event_type").alias("text"))
    rows = e.withColumns({"start_us": F.col("seq") * 1000, "end_us": F.col("seq") * 1000 + 500})
    return live.run(rows, "meeting_id", live.Segments()).drop("start_us", "end_us")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def st_latest(spark, sf):
    e = table(spark, sf, "events")
    return live.latest(e, F.col("user_id"), F.struct("ts", "event_id")).select("user_id", "event_id")


ARRIVALS = "a AS (SELECT meeting_id::VARCHAR AS meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord * 5 % 8, ord) AS seq, ord, end_us FROM segments)"


def _arrivals(spark, sf):
    """Segments in another order than they were said."""
    seq = F.row_number().over(W.partitionBy("meeting_id").orderBy(F.col("ord") * 5 % 8, "ord"))
    return segments(spark, sf).select(F.col("meeting_id").cast("string").alias("meeting_id"), seq.cast("long").alias("seq"), F.concat(F.lit("s"), F.col("ord").cast("string")).alias("seg_id"), F.col("end_us").cast("long").alias("end_us"))


@query(f"{WITH}, {ARRIVALS} SELECT meeting_id, seq, 's' || ord AS seg_id, end_us, coalesce(end_us < newest - 10000000, false) AS late FROM (SELECT *, max(end_us) OVER (PARTITION BY meeting_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a)")
def st_late_segments(spark, sf):
    return live.run(_arrivals(spark, sf), "meeting_id", live.Arrivals())


@query()
def st_timed_cards(spark, sf):
    """Cards by the clock's ticks, each there three seconds after it was asked for."""
    return live.run(_live(spark, sf), "meeting_id", live.TimedCards(latency_us=3_000_000))


@query()
def st_card_emit(spark, sf):
    return live.run(_live(spark, sf), "meeting_id", live.Cards())


@query()
def st_card_trigger(spark, sf):
    """How many cards each meeting's triggers let through."""
    return live.run(_live(spark, sf), "meeting_id", live.Cards()).groupBy("meeting_id").agg(F.count("*").alias("cards"), F.max("end_us").alias("upto"))


@query()
def st_finalize(spark, sf):
    rows = _live(spark, sf)
    stop = rows.groupBy("meeting_id").agg((F.max("seq") + 1).alias("seq")).select("meeting_id", "seq", F.lit("stop").alias("seg_id"), *[F.lit(None).cast("string").alias(c) for c in ("speaker_id", "speaker_name", "text")], *[F.lit(None).cast("long").alias(c) for c in ("start_us", "end_us")])
    return live.run(rows.unionByName(stop), "meeting_id", live.Cards())
