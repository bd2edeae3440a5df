"""Queries over filters, projections, aggregates, windows, sets and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quality, text, times, vectors
from ..operators import budgets, stages, timeline, windows
from .derived import FRAMES, MEETINGS, WITH, frames, meetings, segments, spans, table
from .registry import query

HMS = "printf('%02d:%02d:%02d', {0} // 3600000000, ({0} // 60000000) % 60, ({0} // 1000000) % 60)"
MMSS = f"CASE WHEN {{0}} >= 3600000000 THEN {HMS} ELSE printf('%02d:%02d', ({{0}} // 60000000) % 60, ({{0}} // 1000000) % 60) END"
TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda x: len(x) > 0)"
ASR = r"""list_filter(string_split_regex(text, '[ \t\r\n,.;:!?()\[\]"«»]+'), lambda x: regexp_matches(x, '^[\p{L}\p{Nd}]'))"""


@query(f"{WITH} SELECT meeting_id, lower(speaker_id) AS speaker, count(*) AS utterances, sum(end_us - start_us)::BIGINT AS spoken_us, printf('%02d:%02d', sum(end_us - start_us)::BIGINT // 60000000, (sum(end_us - start_us)::BIGINT // 1000000) % 60) AS spoken FROM segments GROUP BY meeting_id, lower(speaker_id)")
def agg_speaker_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = segments(spark, sf).groupBy("meeting_id", F.lower("speaker_id").alias("speaker")).agg(F.count("*").alias("utterances"), F.sum(F.col("end_us") - F.col("start_us")).alias("spoken_us"))
    return out.withColumn("spoken", times.total_minutes(F.col("spoken_us")))


@query(f"{WITH}, {MEETINGS} SELECT meeting_id, strftime(date, '%Y-%m-%d') AS date FROM meetings m WHERE contains(lower(title), 'semana 3') OR contains(strftime(date, '%d/%m/%Y'), 'semana 3') OR EXISTS (SELECT 1 FROM segments s WHERE s.meeting_id = m.meeting_id AND contains(lower(s.text), 'semana 3'))")
def flt_history_search(spark, sf):
    return search_history(meetings(spark, sf), segments(spark, sf), " Semana 3 ").select("meeting_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


def search_history(m: DataFrame, s: DataFrame, wanted: str) -> DataFrame:
    """Meetings whose title, date or any text holds the query, newest first; a blank query finds all."""
    q = wanted.strip().lower()
    if not q:
        return m.orderBy(F.desc("date"))
    own = F.contains(F.lower("title"), F.lit(q)) | F.contains(F.date_format("date", "dd/MM/yyyy"), F.lit(q))
    spoken = s.filter(F.contains(F.lower("text"), F.lit(q))).select("meeting_id").distinct().withColumn("_spoken", F.lit(True))
    return m.join(spoken, "meeting_id", "left").filter(own | F.col("_spoken")).drop("_spoken").orderBy(F.desc("date"))


VOCABULARY = "vocab AS (SELECT item_id, text AS word, list_filter(string_split_regex(text, '\\s+'), lambda x: len(x) > 0) AS aliases FROM benchmark)"


def vocabulary(spark, sf):
    """(item_id, word, aliases): each item's text as a term, its words as the aliases"""
    return table(spark, sf, "benchmark").select("item_id", F.col("text").alias("word"), text.words(F.col("text")).alias("aliases"))


@query(f"WITH {VOCABULARY} SELECT item_id, word FROM vocab WHERE contains(lower(word), 'the') OR len(list_filter(aliases, lambda a: contains(lower(a), 'the'))) > 0")
def flt_vocab_search(spark, sf):
    has = lambda x: F.contains(F.lower(x), F.lit("the"))
    return vocabulary(spark, sf).filter(has(F.col("word")) | F.exists("aliases", has)).select("item_id", "word")


@query("SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024.0 * 10 + 0.5) / 10) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', floor(n / 1048576.0 * 10 + 0.5) / 10) || ' MB' ELSE printf('%.2f', floor(n / 1073741824.0 * 100 + 0.5) / 100) || ' GB' END AS size FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37)::BIGINT AS n FROM orders)")
def prj_fmt_bytes(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", times.format_bytes(k * k * 37).alias("size"))


TECHNICAL = r"(?i)^(?:SPEAKER|HABLANTE|LOCUTOR)(?:[_\s\-]\d+|\d+)?$"


def technical_name(name):
    """Whether a name is a label of the diarizer; blank ones are."""
    return text.none_or_blank(name) | F.trim(name).rlike(TECHNICAL)


@query(f"{WITH} SELECT meeting_id, ord, regexp_matches(trim(speaker_id), '(?i)^(SPEAKER|HABLANTE|LOCUTOR)([_\\s\\-]\\d+|\\d+)?$') AS technical_id, regexp_matches(trim(speaker_name), '(?i)^(SPEAKER|HABLANTE|LOCUTOR)([_\\s\\-]\\d+|\\d+)?$') AS technical_name FROM segments")
def flt_technical_name(spark, sf):
    return segments(spark, sf).select("meeting_id", "ord", technical_name(F.col("speaker_id")).alias("technical_id"), technical_name(F.col("speaker_name")).alias("technical_name"))


@query("SELECT page_id FROM pages WHERE html IS NULL OR NOT regexp_matches(html, '\\S')")
def flt_blank(spark, sf):
    return table(spark, sf, "pages").filter(text.none_or_blank(F.col("html"))).select("page_id")


@query(f"{WITH} SELECT meeting_id, ord FROM spans WHERE end_us > start_us AND end_us - start_us >= 8000000 AND trim(speaker_id) <> ''")
def flt_min_duration(spark, sf):
    kept = (F.col("end_us") > F.col("start_us")) & (F.col("end_us") - F.col("start_us") >= 8_000_000) & (F.trim("speaker_id") != "")
    return spans(spark, sf).filter(kept).select("meeting_id", "ord")


@query("SELECT event_id FROM events WHERE NOT ((value < 35 AND value / 100.0 < 0.40) OR value / 10000.0 < 0.003)")
def flt_region_energy(spark, sf):
    dur_ms, prob, rms = F.col("value") * 10, F.col("value") / 100.0, F.col("value") / 10000.0
    return table(spark, sf, "events").filter(~(((dur_ms < 350) & (prob < 0.40)) | (rms < 0.003))).select("event_id")


@query("SELECT event_id, value / 100000.0 < 0.005 AND value / 10000.0 >= 0.012 AS mic_only FROM events WHERE value * 10 >= 250 AND value / 10000.0 >= 0.003")
def flt_utterance_gate(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").filter((v * 10 >= 250) & (v / 10000.0 >= 0.003)).select("event_id", ((v / 100000.0 < 0.005) & (v / 10000.0 >= 0.012)).alias("mic_only"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (value / 490.0 > 0.5 AND value / 490.0 + event_id % 2 < 1.5) AS clean, count(*) FILTER (value / 490.0 > 0.5 AND value / 490.0 + event_id % 2 < 1.5) >= 0.20 * count(*) AS trainable FROM events GROUP BY user_id HAVING count(*) FILTER (value / 490.0 > 0.5) >= 3")
def flt_active_mask(spark, sf):
    own = F.col("value") / 490.0
    clean = F.sum(((own > 0.5) & (own + F.col("event_id") % 2 < 1.5)).cast("long"))
    out = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), clean.alias("clean"), F.sum((own > 0.5).cast("long")).alias("active"))
    return out.filter("active >= 3").select("user_id", "n", "clean", (F.col("clean") >= 0.20 * F.col("n")).alias("trainable"))


@query(f"{WITH} SELECT meeting_id, ord, {HMS.format('(start_us * 40)')} AS hms FROM segments")
def prj_format_hms(spark, sf):
    return segments(spark, sf).select("meeting_id", "ord", times.hms(F.col("start_us") * 40).alias("hms"))


@query(f"{WITH} SELECT meeting_id, ord, {MMSS.format('greatest(start_us * 10 - 5000000, 0)')} AS mmss FROM segments")
def prj_format_mmss(spark, sf):
    return segments(spark, sf).select("meeting_id", "ord", times.mmss(F.col("start_us") * 10 - 5_000_000).alias("mmss"))


@query(f"{WITH} SELECT meeting_id, ord, coalesce(nullif(trim(CASE WHEN ord % 3 = 0 THEN ' ' ELSE speaker_name END), ''), nullif(trim(CASE WHEN ord % 2 = 0 THEN NULL ELSE speaker_id END), ''), 'Hablante') AS shown FROM segments")
def prj_speaker_fallback(spark, sf):
    name = F.when(F.col("ord") % 3 == 0, " ").otherwise(F.col("speaker_name"))
    speaker = F.when(F.col("ord") % 2 == 1, F.col("speaker_id"))
    return segments(spark, sf).select("meeting_id", "ord", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(speaker), F.lit("")), F.lit("Hablante")).alias("shown"))


@query(f"{WITH} SELECT meeting_id, ord, CASE WHEN end_us - 4000000 > start_us THEN end_us - 4000000 ELSE start_us + 3000000 END AS end_us FROM segments")
def prj_end_fallback(spark, sf):
    end = F.col("end_us") - 4_000_000
    return segments(spark, sf).select("meeting_id", "ord", F.when(end > F.col("start_us"), end).otherwise(F.col("start_us") + 3_000_000).alias("end_us"))


@query(
    f"""{WITH}, pre AS (SELECT meeting_id, count(*) AS n_segments, count(DISTINCT lower(speaker_id)) AS n_participants,
    string_agg(CASE WHEN ord < 3 THEN speaker_name || ': ' || text END, ' ' ORDER BY ord) AS t FROM segments GROUP BY meeting_id)
    SELECT meeting_id, n_segments, n_participants, CASE WHEN length(t) > 160 THEN t[1:157] || '...' ELSE t END AS preview FROM pre"""
)
def prj_history_row(spark, sf):
    s = segments(spark, sf).groupBy("meeting_id").agg(F.count("*").alias("n_segments"), F.countDistinct(F.lower("speaker_id")).alias("n_participants"), F.array_sort(F.collect_list(F.when(F.col("ord") < 3, F.struct("ord", F.concat("speaker_name", F.lit(": "), "text").alias("t"))))).alias("first"))
    joined = F.array_join(F.transform("first", lambda x: x["t"]), " ")
    return s.select("meeting_id", "n_segments", "n_participants", F.when(F.length(joined) > 160, F.concat(F.substring(joined, 1, 157), F.lit("..."))).otherwise(joined).alias("preview"))


@query(f"{WITH} SELECT meeting_id, ceil(sum(15 + length(speaker_name) + 2 + length(text) + 2) / 3.8)::BIGINT AS transcript_tokens, sum(ceil(length(text) / 3.5))::BIGINT AS text_tokens FROM segments GROUP BY meeting_id")
def prj_token_estimate(spark, sf):
    chars = budgets.segment_chars(F.col("speaker_name"), F.col("speaker_id"), F.col("text"))
    return segments(spark, sf).groupBy("meeting_id").agg(F.ceil(F.sum(chars) / 3.8).cast("long").alias("transcript_tokens"), F.sum(budgets.token_estimate(F.col("text"), 3.5)).alias("text_tokens"))


OPTIONS = """opts AS (SELECT o_orderkey, ['openai/gpt-6-luna','anthropic/claude-x','qwen/q3','openai/o3-mini','deepseek/deepseek-r1','other'][(o_orderkey % 6 + 1)::INT] AS model,
 ['Breve','Normal','Detallada','Exhaustiva'][(o_orderkey % 4 + 1)::INT] AS detail, ['none','low','medium','high'][(o_orderkey // 4 % 4 + 1)::INT] AS effort, floor(o_totalprice)::BIGINT AS prompt FROM orders)"""
BUDGET = """SELECT o_orderkey, least(least(base, cap) + CASE WHEN {reserves} THEN CASE effort WHEN 'low' THEN 2000 WHEN 'medium' THEN 4000 WHEN 'high' THEN 8000 ELSE 4000 END ELSE 0 END, greatest(2000, ctx - prompt - {margin}))::BIGINT AS tokens FROM (SELECT *,
 CASE detail WHEN 'Breve' THEN 4000 WHEN 'Detallada' THEN 12000 WHEN 'Exhaustiva' THEN 16000 ELSE 8000 END AS base,
 CASE WHEN contains(model,'claude') THEN 8192 WHEN contains(model,'qwen') THEN 16384 WHEN contains(model,'gpt-6') THEN 32768 WHEN contains(model,'o1') OR contains(model,'o3') THEN 32768 WHEN contains(model,'deepseek') THEN {deep} ELSE 16384 END AS cap,
 CASE WHEN contains(model,'claude') THEN 200000 ELSE 128000 END AS ctx,
 model = 'openai/gpt-6-luna' OR starts_with(model,'openai/o1') OR starts_with(model,'openai/o3') OR contains(model,'deepseek-r1') AS thinks FROM opts)"""


def options(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        pick(["openai/gpt-6-luna", "anthropic/claude-x", "qwen/q3", "openai/o3-mini", "deepseek/deepseek-r1", "other"], k % 6).alias("model"),
        pick(["Breve", "Normal", "Detallada", "Exhaustiva"], k % 4).alias("detail"),
        pick(["none", "low", "medium", "high"], F.floor(k / 4) % 4).alias("effort"),
        F.floor("o_totalprice").cast("long").alias("prompt"),
    )


@query(f"WITH {OPTIONS} " + BUDGET.format(reserves="thinks AND effort <> 'none'", margin=1500, deep=8192))
def prj_token_budget(spark, sf):
    o = options(spark, sf)
    return o.select("o_orderkey", budgets.token_budget(o.model, o.detail, o.effort, o.prompt).cast("long").alias("tokens"))


@query(f"WITH {OPTIONS} " + BUDGET.format(reserves="thinks OR effort <> 'none'", margin=1000, deep=16384))
def prj_token_budget_router(spark, sf):
    o = options(spark, sf)
    return o.select("o_orderkey", budgets.token_budget(o.model, o.detail, o.effort, o.prompt, router=True).cast("long").alias("tokens"))


@query(f"{WITH}, {MEETINGS}, t AS (SELECT meeting_id, ceil(sum(15 + length(speaker_name) + 2 + length(text) + 2) / 3.8) AS tokens FROM segments GROUP BY meeting_id), d AS (SELECT m.*, tokens, ['Breve','Normal','Detallada','Exhaustiva'][(meeting_id % 4 + 1)::INT] AS detail FROM meetings m JOIN t USING (meeting_id)) SELECT meeting_id, (end_us - start_us) * 10 >= 3600000000 OR ((end_us - start_us) * 10 >= 2700000000 AND detail IN ('Detallada', 'Exhaustiva')) OR tokens >= 12000 OR (tokens >= 8000 AND detail IN ('Detallada', 'Exhaustiva')) AS hierarchical FROM d")
def prj_hierarchical_flag(spark, sf):
    t = prj_token_estimate(spark, sf).select("meeting_id", F.col("transcript_tokens").alias("tokens"))
    detail = F.element_at(F.array(*[F.lit(x) for x in budgets.DETAIL_TOKENS]), (F.col("meeting_id") % 4 + 1).cast("int"))
    return meetings(spark, sf).join(t, "meeting_id").select("meeting_id", budgets.hierarchical((F.col("end_us") - F.col("start_us")) * 10, F.col("tokens"), detail, F.col("n_segments")).alias("hierarchical"))


STATUS = ["None", "Transcribing", "Diarizing", "Processing", "Completed"]


@query(f"{WITH}, {MEETINGS} SELECT meeting_id, CASE WHEN status = 'None' AND n_segments > 0 THEN 'Completed' ELSE status END AS status FROM (SELECT *, ['None','Transcribing','Diarizing','Processing','Completed'][(meeting_id % 5 + 1)::INT] AS status FROM meetings)")
def prj_compat_upgrade(spark, sf):
    status = F.element_at(F.array(*[F.lit(x) for x in STATUS]), (F.col("meeting_id") % 5 + 1).cast("int"))
    return meetings(spark, sf).select("meeting_id", F.when((status == "None") & (F.col("n_segments") > 0), "Completed").otherwise(status).alias("status"))


@query(f"{WITH}, {MEETINGS} SELECT meeting_id, CASE status WHEN 'Transcribing' THEN 'None' ELSE status END AS transcription, CASE WHEN status IN ('Transcribing', 'Diarizing') THEN 'Pending' WHEN status = 'Processing' AND n_segments % 2 = 0 THEN 'Pending' ELSE status END AS processing FROM (SELECT *, ['None','Transcribing','Diarizing','Processing','Completed'][(meeting_id % 5 + 1)::INT] AS status FROM meetings)")
def prj_recovery(spark, sf):
    """After a restart: what was running waits again; processing only if nothing was written."""
    status = F.element_at(F.array(*[F.lit(x) for x in STATUS]), (F.col("meeting_id") % 5 + 1).cast("int"))
    untouched = F.col("n_segments") % 2 == 0
    return meetings(spark, sf).select("meeting_id", F.when(status == "Transcribing", "None").otherwise(status).alias("transcription"), F.when(status.isin("Transcribing", "Diarizing") | ((status == "Processing") & untouched), "Pending").otherwise(status).alias("processing"))


# Aggregates


@query(f"WITH {FRAMES}, r AS (SELECT audio_id, frame, frame - row_number() OVER (PARTITION BY audio_id ORDER BY frame) AS g FROM frames WHERE prob >= 0.5), runs AS (SELECT audio_id, count(*) * 0.032::DOUBLE AS dur FROM r GROUP BY audio_id, g) SELECT audio_id, count(*) AS regions, round(sum(dur), 6) AS speech, round(avg(dur), 6) AS mean, round(sum(dur) / (SELECT count(*) * 0.032::DOUBLE FROM frames f WHERE f.audio_id = runs.audio_id), 6) AS ratio FROM runs GROUP BY audio_id")
def agg_vad_stats(spark, sf):
    f = frames(spark, sf)
    runs = timeline.threshold_runs(f, F.col("prob") >= 0.5).groupBy("audio_id").agg(F.count("*").alias("regions"), F.round(F.sum(F.col("n") * 0.032), 6).alias("speech"), F.round(F.avg(F.col("n") * 0.032), 6).alias("mean"), F.sum("n").alias("n"))
    total = f.groupBy("audio_id").agg(F.count("*").alias("total"))
    return runs.join(total, "audio_id").select("audio_id", "regions", "speech", "mean", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / len(embedding)), 6) AS rms, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak FROM embeddings")
def agg_rms_peak(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.rms(e), 6).alias("rms"), F.round(vectors.peak(e), 6).alias("peak"))


@query("SELECT user_id, round(sum(value / 1000 * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS energy FROM events GROUP BY user_id")
def agg_weighted_energy(spark, sf):
    n = F.col("event_id") % 5 + 1
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum(F.col("value") / 1000 * n) / F.sum(n), 6).alias("energy"))


@query("SELECT user_id, round(CASE WHEN count(*) > 0 THEN sum(value) / count(*) ELSE 0 END, 6) AS rtf, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) ELSE 0 END, 6) AS speedup FROM events GROUP BY user_id")
def agg_rtf(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.coalesce(F.try_divide(F.sum("value"), F.count("*")), F.lit(0.0)), 6).alias("rtf"), F.round(F.coalesce(F.try_divide(F.count("*"), F.sum("value")), F.lit(0.0)), 6).alias("speedup"))


@query(f"{WITH} SELECT meeting_id, count(*) AS words, count(DISTINCT lower(w)) FILTER (length(w) >= 2) AS distinct_words FROM (SELECT meeting_id, unnest({TOKENS}) AS w FROM segments) GROUP BY meeting_id")
def agg_distinct_words(spark, sf):
    w = segments(spark, sf).select("meeting_id", F.explode(text.words(F.col("text"))).alias("w"))
    return w.groupBy("meeting_id").agg(F.count("*").alias("words"), F.countDistinct(F.when(F.length("w") >= 2, F.lower("w"))).alias("distinct_words"))


@query(f"{WITH}, t AS (SELECT meeting_id, ord, {ASR} AS w FROM segments) SELECT meeting_id, ord, round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w), 6) AS diversity, len(w) >= 15 AND len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) < 0.25 AS low FROM t WHERE len(w) > 0")
def agg_lexical_diversity(spark, sf):
    t = segments(spark, sf).select("meeting_id", "ord", text.asr_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    d = quality.lexical_diversity(F.col("w"))
    return t.select("meeting_id", "ord", F.round(d, 6).alias("diversity"), ((F.size("w") >= 15) & (d < 0.25)).alias("low"))


@query("SELECT l_orderkey, sum(l_partkey % 100)::BIGINT AS prompt, sum(l_suppkey % 100)::BIGINT AS completion, sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END)::BIGINT AS reasoning, count(*) AS stages FROM lineitem GROUP BY l_orderkey")
def agg_token_totals(spark, sf):
    """Each order's lines are its stages; every third one reports no reasoning tokens."""
    reasoning = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber"))
    used = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).alias("prompt"), (F.col("l_suppkey") % 100).alias("completion"), reasoning.alias("reasoning"))
    return stages.token_totals(used, "l_orderkey")


WINDOWED = """n AS (SELECT audio_id, max(frame) + 1 AS n FROM frames GROUP BY audio_id),
w AS (SELECT audio_id, n, win, round_even((win * 1600)::DOUBLE / 16000 / 0.016875::DOUBLE, 0)::BIGINT AS first FROM (SELECT audio_id, n, unnest(range(n // 6 + 1)) AS win FROM n)),
p AS (SELECT audio_id, win, first + f AS frame FROM (SELECT *, unnest(range(20)) AS f FROM w) WHERE first + f < ceil((n * 270)::DOUBLE / 16000 / 0.016875::DOUBLE) + 1),
a AS (SELECT p.audio_id, p.win, p.frame, s, coalesce(prob, 0.0) * CASE WHEN (frame + s + win) % 3 = 0 THEN 1.0 ELSE 0.25 END AS act, (win + s) % 4 - 1 AS speaker FROM (SELECT *, unnest([0, 1, 2]) AS s FROM p) p LEFT JOIN frames USING (audio_id, frame)),
c AS (SELECT audio_id, frame, count(DISTINCT win) AS weight, sum(act) AS acts FROM a GROUP BY ALL)"""


@query(f"WITH {FRAMES}, {WINDOWED} SELECT a.audio_id, a.frame, speaker, round(sum(act) / min(weight), 9) AS activation, min(round_even(round(c.acts / weight, 9), 0))::BIGINT AS speakers FROM a JOIN c USING (audio_id, frame) WHERE speaker >= 0 GROUP BY a.audio_id, a.frame, speaker")
def agg_frame_overlap_add(spark, sf):
    """Windows of 20 frames every tenth of a second, three local speakers in each, of which one may be nobody."""
    f = frames(spark, sf)
    n = f.groupBy("audio_id").agg((F.max("frame") + 1).alias("n"))
    starts = n.select("audio_id", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 6))).alias("window"))
    first = windows.first_frame(F.col("window") * 1600)
    cells = starts.select("audio_id", "window", first.alias("first"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("at"))
    cells = cells.withColumn("frame", F.col("first") + F.col("at")).join(f, ["audio_id", "frame"], "left")
    act = lambda s: F.coalesce("prob", F.lit(0.0)) * F.when((F.col("frame") + s + F.col("window")) % 3 == 0, 1.0).otherwise(0.25)
    heard = cells.groupBy("audio_id", "window").agg(F.array_sort(F.collect_list(F.struct("at", F.array(act(0), act(1), act(2)).alias("acts")))).alias("a"))
    heard = heard.select("audio_id", "window", (F.col("window") * 1600).alias("start_sample"), F.transform("a", lambda x: x["acts"]).alias("frames"))
    placed = windows.placed_windows(heard, n.select("audio_id", (F.col("n") * 270).alias("samples")))
    who = starts.select("audio_id", "window", F.array(*[((F.col("window") + s) % 4 - 1).cast("int") for s in range(3)]).alias("speakers"))
    acts, counts = windows.overlap_add(placed, who)
    return acts.join(counts, ["audio_id", "frame"]).select("audio_id", "frame", "speaker", F.round("activation", 9).alias("activation"), "speakers")


@query(f"{WITH} SELECT meeting_id, ord, array_to_string({TOKENS}, ' ') AS joined, len({TOKENS}) AS n FROM segments WHERE words > 0")
def agg_group_words(spark, sf):
    w = segments(spark, sf).select("meeting_id", "ord", F.posexplode(text.words(F.col("text"))).alias("pos", "w"))
    g = w.groupBy("meeting_id", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("a"))
    return g.select("meeting_id", "ord", F.array_join(F.transform("a", lambda x: x["w"]), " ").alias("joined"), F.size("a").alias("n"))


@query("SELECT label, dim, round(sum(x * (vec_id % 3 + 1)) / sum(vec_id % 3 + 1), 6) AS value FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings) GROUP BY label, dim")
def agg_centroid(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 3 + 1).alias("w"), F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w"), 6).alias("value"))


@query(f"{WITH}, n AS (SELECT meeting_id, 0 AS kind, ord, ' ' || speaker_name AS name FROM segments UNION ALL SELECT meeting_id, 1, ord, speaker_id FROM segments), f AS (SELECT meeting_id, lower(trim(name)) AS k, min(struct_pack(kind := kind, ord := ord, name := trim(name))) AS first FROM n WHERE trim(name) <> '' AND NOT regexp_matches(trim(name), '(?i)^(SPEAKER|HABLANTE|LOCUTOR)([_\\s\\-]\\d+|\\d+)?$') GROUP BY ALL) SELECT meeting_id, first.name AS name, row_number() OVER (PARTITION BY meeting_id ORDER BY first.kind, first.ord) AS place FROM f")
def agg_user_participants(spark, sf):
    s = segments(spark, sf)
    n = s.select("meeting_id", F.lit(0).alias("kind"), "ord", F.concat(F.lit(" "), "speaker_name").alias("name")).union(s.select("meeting_id", F.lit(1), "ord", "speaker_id"))
    first = n.filter(~technical_name(F.col("name"))).groupBy("meeting_id", F.lower(F.trim("name")).alias("k")).agg(F.min(F.struct("kind", "ord", F.trim("name").alias("name"))).alias("first"))
    return first.select("meeting_id", F.col("first.name").alias("name"), F.row_number().over(W.partitionBy("meeting_id").orderBy("first.kind", "first.ord")).alias("place"))


@query(f"WITH {VOCABULARY} SELECT lower(word) AS k, min_by(word, item_id) AS word FROM vocab GROUP BY lower(word)")
def agg_official_words(spark, sf):
    return vocabulary(spark, sf).groupBy(F.lower("word").alias("k")).agg(F.min_by("word", "item_id").alias("word"))


# Windows


@query(f"{WITH} SELECT meeting_id, ord, lag(speaker_id) OVER w IS DISTINCT FROM speaker_id AS shown FROM segments WINDOW w AS (PARTITION BY meeting_id ORDER BY ord)")
def win_speaker_header(spark, sf):
    w = W.partitionBy("meeting_id").orderBy("ord")
    return segments(spark, sf).select("meeting_id", "ord", (~F.lag("speaker_id").over(w).eqNullSafe(F.col("speaker_id"))).alias("shown"))


@query(f"{WITH} SELECT meeting_id, ord, coalesce(lead(start_us) OVER (PARTITION BY meeting_id ORDER BY ord), start_us + 5000000) AS end_us FROM segments")
def win_lead_end(spark, sf):
    return segments(spark, sf).select("meeting_id", "ord", F.coalesce(F.lead("start_us").over(W.partitionBy("meeting_id").orderBy("ord")), F.col("start_us") + 5_000_000).alias("end_us"))


# Colours of speakers in order of their first words.
PALETTE = ["#4F46E5", "#059669", "#D97706", "#E11D48", "#9333EA", "#0D9488", "#DB2777", "#EA580C"]


@query(f"{WITH}, f AS (SELECT meeting_id, lower(speaker_id) AS speaker, min(ord) AS first FROM segments GROUP BY ALL) SELECT meeting_id, speaker, {PALETTE}[((row_number() OVER (PARTITION BY meeting_id ORDER BY first) - 1) % 8 + 1)::INT] AS color FROM f")
def win_color_index(spark, sf):
    f = segments(spark, sf).groupBy("meeting_id", F.lower("speaker_id").alias("speaker")).agg(F.min("ord").alias("first"))
    i = F.row_number().over(W.partitionBy("meeting_id").orderBy("first")) - 1
    return f.select("meeting_id", "speaker", F.element_at(F.array(*[F.lit(c) for c in PALETTE]), i % 8 + 1).alias("color"))


@query(f"{WITH}, k AS (SELECT * FROM spans WHERE end_us - start_us >= 250000), c AS (SELECT *, CASE WHEN lag(speaker_id) OVER w = speaker_id THEN 0 ELSE 1 END AS n FROM k WINDOW w AS (PARTITION BY meeting_id ORDER BY start_us, ord)), r AS (SELECT *, sum(n) OVER (PARTITION BY meeting_id ORDER BY start_us, ord) AS run FROM c), g AS (SELECT *, start_us - max(end_us) OVER (PARTITION BY meeting_id, run ORDER BY start_us, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM r), i AS (SELECT *, sum(CASE WHEN gap <= 900000 THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY start_us, ord) AS island FROM g) SELECT meeting_id, first(speaker_id) AS speaker_id, min(start_us) AS start_us, max(end_us) AS end_us FROM i GROUP BY meeting_id, island")
def win_smooth_merge(spark, sf):
    return timeline.smooth_merge(spans(spark, sf), 250_000, 900_000)


@query(f"WITH {FRAMES}, r AS (SELECT audio_id, frame, frame - row_number() OVER (PARTITION BY audio_id ORDER BY frame) AS g FROM frames WHERE prob >= 0.5) SELECT audio_id, min(frame) * 16875 AS start_us, (max(frame) + 1) * 16875 AS end_us, 0.95::DOUBLE AS confidence FROM r GROUP BY audio_id, g")
def win_activation_runs(spark, sf):
    runs = timeline.threshold_runs(frames(spark, sf), F.col("prob") >= 0.5)
    return runs.select("audio_id", (F.col("first_frame") * 16875).alias("start_us"), ((F.col("last_frame") + 1) * 16875).alias("end_us"), F.lit(0.95).alias("confidence"))


@query(f"WITH {FRAMES}, b AS (SELECT audio_id, frame // 3 AS frame, arg_max(frame % 3, struct_pack(p := prob, s := -(frame % 3))) AS spk FROM frames WHERE prob > 0.35 GROUP BY ALL), r AS (SELECT *, frame - row_number() OVER (PARTITION BY audio_id, spk ORDER BY frame) AS g FROM b) SELECT audio_id, spk, min(frame) AS first_frame, max(frame) AS last_frame FROM r GROUP BY audio_id, spk, g")
def win_exclusive_runs(spark, sf):
    f = frames(spark, sf).filter("prob > 0.35").select("audio_id", F.floor(F.col("frame") / 3).alias("frame"), (F.col("frame") % 3).alias("spk"), "prob")
    best = f.groupBy("audio_id", "frame").agg(F.max_by("spk", F.struct("prob", -F.col("spk"))).alias("spk"))
    w = W.partitionBy("audio_id").orderBy("frame")
    begins = (F.lag("frame").over(w) + 1 != F.col("frame")) | (F.lag("spk").over(w) != F.col("spk"))
    runs = timeline.islands(best, ["audio_id"], ["frame"], begins)
    return runs.groupBy("audio_id", "island").agg(F.first("spk").alias("spk"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")).drop("island")


@query(f"{WITH}, {MEETINGS}, s AS (SELECT meeting_id, end_us, unnest(CASE WHEN end_us < 10000000 THEN [0::BIGINT] ELSE list_distinct(list_append(range(0, (end_us - 10000000)::BIGINT + 1, 1000000), CASE WHEN end_us % 1000000 > 0 THEN (end_us // 1000000 - 9) * 1000000 ELSE end_us - 10000000 END)) END) AS start_us FROM meetings) SELECT meeting_id, start_us FROM s")
def win_sliding_chunks(spark, sf):
    """Windows of 10 s every second, and a last one over what is left."""
    end, second = F.col("end_us"), 1_000_000
    full = F.sequence(F.lit(0), end - 10 * second, F.lit(second))
    tail = F.when(end % second > 0, (F.floor(end / second) - 9) * second).otherwise(end - 10 * second)
    starts = F.when(end < 10 * second, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array_append(full, tail)))
    return meetings(spark, sf).select("meeting_id", F.explode(starts).alias("start_us"))


@query(f"{WITH}, l AS (SELECT meeting_id, greatest(max_by(end_us, ord) - 90000000, 0) AS since, max(ord) AS last FROM segments GROUP BY meeting_id) SELECT s.meeting_id, s.ord FROM segments s JOIN l USING (meeting_id) WHERE end_us >= since")
def win_sliding_text(spark, sf):
    s = segments(spark, sf)
    w = W.partitionBy("meeting_id")
    since = F.greatest(F.max_by("end_us", "ord").over(w) - 90_000_000, F.lit(0))
    marked = s.withColumns({"inside": F.col("end_us") >= since, "back": F.row_number().over(w.orderBy(F.desc("ord")))}).withColumn("any", F.max("inside").over(w))
    return marked.filter(F.when(F.col("any"), F.col("inside")).otherwise(F.col("back") <= 5)).select("meeting_id", "ord")


@query(f"{WITH} SELECT meeting_id, ord FROM (SELECT *, lag(lower(speaker_id)) OVER w = lower(speaker_id) AND lag(lower(text)) OVER w = lower(text) AS same FROM segments WHERE trim(text) <> '' WINDOW w AS (PARTITION BY meeting_id ORDER BY ord)) WHERE NOT coalesce(same, false)")
def win_dedupe_consecutive(spark, sf):
    return timeline.dedupe_consecutive(segments(spark, sf)).select("meeting_id", "ord")
