"""Queries over joins, sets, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import minutes, text
from ..operators import timeline
from ..operators.ranking import placed
from .basic import TOKENS, VOCABULARY, vocabulary
from .derived import MEETINGS, WITH, meetings, segments, spans, table
from .registry import query

# Joins

OVERLAP = "o AS (SELECT s.meeting_id, s.ord, p.speaker_id, p.ord AS p_ord, least(s.end_us, p.end_us) - greatest(s.start_us, p.start_us) AS shared FROM segments s JOIN spans p ON s.meeting_id = p.meeting_id AND least(s.end_us, p.end_us) > greatest(s.start_us, p.start_us))"


@query(f"{WITH}, {OVERLAP}, b AS (SELECT meeting_id, ord, speaker_id, sum(shared)::BIGINT AS overlap_us, min(p_ord) AS first FROM o GROUP BY ALL) SELECT meeting_id, ord, speaker_id AS speaker, overlap_us FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, ord ORDER BY overlap_us DESC, first) AS rn FROM b) WHERE rn = 1")
def jn_overlap_argmax(spark, sf):
    return timeline.overlap_argmax(segments(spark, sf), spans(spark, sf))


PAUSES = "pauses AS (SELECT meeting_id, ord, end_us + 400000 AS start_us, end_us + 500000 AS end_us FROM segments)"
GAP = "n AS (SELECT s.meeting_id, s.ord, p.speaker_id, p.ord AS p_ord, greatest(0, s.start_us - p.end_us, p.start_us - s.end_us) AS distance_us FROM pauses s JOIN spans p ON s.meeting_id = p.meeting_id AND greatest(0, s.start_us - p.end_us, p.start_us - s.end_us) < 1500000)"


@query(f"{WITH}, {PAUSES}, {GAP} SELECT meeting_id, ord, speaker_id AS speaker, distance_us FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, ord ORDER BY distance_us, p_ord) AS rn FROM n) WHERE rn = 1")
def jn_nearest(spark, sf):
    """Who speaks nearest to a moment in the pause after each segment."""
    pauses = segments(spark, sf).select("meeting_id", "ord", (F.col("end_us") + 400_000).alias("start_us"), (F.col("end_us") + 500_000).alias("end_us"))
    return timeline.nearest_span(pauses, spans(spark, sf), 1_500_000)


NAMES = "names AS (SELECT meeting_id, lower(speaker_id) AS k, min_by(speaker_name, ord) AS name FROM segments WHERE ord % 2 = 1 GROUP BY ALL)"


def names(s: DataFrame) -> DataFrame:
    return s.filter("ord % 2 = 1").groupBy("meeting_id", F.lower("speaker_id").alias("k")).agg(F.min_by("speaker_name", "ord").alias("name"))


@query(f"{WITH}, {NAMES} SELECT s.meeting_id, s.ord, coalesce(nullif(s.speaker_id, ''), 'SPEAKER_00') AS speaker, coalesce(n.name, s.speaker_id) AS name FROM segments s LEFT JOIN names n ON s.meeting_id = n.meeting_id AND lower(s.speaker_id) = n.k")
def jn_fallback_names(spark, sf):
    s = segments(spark, sf)
    speaker = F.coalesce(F.nullif("speaker_id", F.lit("")), F.lit("SPEAKER_00"))
    named = s.withColumn("k", F.lower("speaker_id")).join(names(s), ["meeting_id", "k"], "left")
    return named.select("meeting_id", "ord", speaker.alias("speaker"), F.coalesce("name", "speaker_id").alias("name"))


@query(f"{WITH}, pos AS (SELECT meeting_id, ord * 3100000 AS pos_us FROM segments), c AS (SELECT p.meeting_id, p.pos_us, s.ord, s.end_us, row_number() OVER (PARTITION BY p.meeting_id, p.pos_us ORDER BY s.start_us DESC, s.ord DESC) AS rn FROM pos p LEFT JOIN segments s ON s.meeting_id = p.meeting_id AND s.start_us <= p.pos_us) SELECT meeting_id, pos_us, CASE WHEN pos_us < end_us THEN ord ELSE -1 END AS ord FROM c WHERE rn = 1")
def jn_asof_active(spark, sf):
    """The active segment at each position; -1 for none."""
    s = segments(spark, sf)
    active = timeline.as_of(s.select("meeting_id", (F.col("ord") * 3_100_000).alias("pos_us")), s)
    return active.withColumn("ord", F.coalesce("ord", F.lit(-1)))


@query(f"{WITH} SELECT meeting_id, lower(speaker_id) AS speaker, min_by(ord, start_us) AS ord, min(start_us) AS start_us FROM segments GROUP BY ALL")
def jn_first_utterance(spark, sf):
    first = F.min_by("ord", F.struct("start_us", "ord"))
    return segments(spark, sf).groupBy("meeting_id", F.lower("speaker_id").alias("speaker")).agg(first.alias("ord"), F.min("start_us").alias("start_us"))


@query(f"{WITH}, {NAMES} SELECT s.meeting_id, s.ord, coalesce(nullif(n.name, ''), nullif(s.speaker_name, ''), s.speaker_id, 'Hablante') AS shown FROM segments s LEFT JOIN names n ON s.meeting_id = n.meeting_id AND lower(s.speaker_id) = n.k WHERE s.ord < 3")
def jn_preview_participant(spark, sf):
    s = segments(spark, sf)
    named = s.filter("ord < 3").withColumn("k", F.lower("speaker_id")).join(names(s), ["meeting_id", "k"], "left")
    return named.select("meeting_id", "ord", F.coalesce(F.nullif("name", F.lit("")), F.nullif("speaker_name", F.lit("")), "speaker_id", F.lit("Hablante")).alias("shown"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def jn_anti_inactive(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query(f"{WITH}, {MEETINGS} SELECT meeting_id FROM meetings m WHERE EXISTS (SELECT 1 FROM segments s WHERE s.meeting_id = m.meeting_id AND contains(lower(s.text), 'that'))")
def jn_semi_any(spark, sf):
    spoken = segments(spark, sf).filter(F.contains(F.lower("text"), F.lit("that"))).select("meeting_id")
    return meetings(spark, sf).select("meeting_id").join(spoken, "meeting_id", "left_semi")


@query("SELECT s.s_nationkey, count(*) AS missing, round(sum(s.s_acctbal), 2) AS total FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE lower(c.c_name) = lower(replace(s.s_name, 'Supplier', 'Customer')) AND c.c_acctbal > 0) GROUP BY s.s_nationkey")
def jn_inventory_diff(spark, sf):
    """Source items without a valid destination item, and what they weigh."""
    valid = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.lower("c_name").alias("k")).distinct()
    source = table(spark, sf, "supplier").withColumn("k", F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))))
    return source.join(valid, "k", "left_anti").groupBy("s_nationkey").agg(F.count("*").alias("missing"), F.round(F.sum("s_acctbal"), 2).alias("total"))


# Sorts, limits, sets


@query(f"{WITH}, {MEETINGS} SELECT meeting_id, row_number() OVER (ORDER BY date DESC, start_us DESC NULLS LAST, meeting_id) AS place FROM meetings")
def srt_meetings(spark, sf):
    m = meetings(spark, sf).select("meeting_id", "date", "start_us")
    return placed(m, F.desc("date"), F.desc_nulls_last("start_us"), F.asc("meeting_id")).select("meeting_id", "place")


@query(f"WITH {VOCABULARY} SELECT item_id, word, rank() OVER (ORDER BY lower(word), word) AS place FROM vocab")
def srt_vocab(spark, sf):
    v = vocabulary(spark, sf).select("item_id", "word", F.lower("word").alias("k"))
    return placed(v, F.asc("k"), F.asc("word"), ties=True).select("item_id", "word", "place")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def srt_versions(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("SELECT o_custkey, coalesce(max(CASE WHEN o_orderkey % 50 = o_custkey % 50 THEN o_orderkey END), max_by(o_orderkey, (o_orderdate, -o_orderkey))) AS active FROM orders GROUP BY o_custkey")
def srt_active_version(spark, sf):
    """The selected version if there is one, else the newest."""
    selected = F.max(F.when(F.col("o_orderkey") % 50 == F.col("o_custkey") % 50, F.col("o_orderkey")))
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.coalesce(selected, newest).alias("active"))


@query(f"WITH {VOCABULARY}, a AS (SELECT item_id, unnest(aliases) AS a, unnest(range(1, len(aliases) + 1)) AS i FROM vocab) SELECT item_id, string_agg(a, '|' ORDER BY length(a) DESC, i) AS aliases FROM a GROUP BY item_id")
def srt_alias_length(spark, sf):
    keyed = F.transform("aliases", lambda a, i: F.struct((-F.length(a)).alias("n"), i.alias("i"), a.alias("a")))
    return vocabulary(spark, sf).filter(F.size("aliases") > 0).select("item_id", F.array_join(F.transform(F.array_sort(keyed), lambda x: x["a"]), "|").alias("aliases"))


@query(f"WITH {VOCABULARY}, f AS (SELECT min_by(word, item_id) AS word, min(item_id) AS first FROM vocab GROUP BY lower(word)) SELECT word FROM f ORDER BY first LIMIT 20")
def lim_hotwords(spark, sf):
    f = vocabulary(spark, sf).groupBy(F.lower("word").alias("k")).agg(F.min_by("word", "item_id").alias("word"), F.min("item_id").alias("first"))
    return f.orderBy("first").limit(20).select("word")


@query(f"WITH {VOCABULARY} SELECT item_id, len(list_filter(aliases, lambda a: length(a) >= 2)[1:6]) AS n FROM vocab", name="lim_aliases6")
def lim_aliases6(spark, sf):
    return vocabulary(spark, sf).select("item_id", F.size(F.slice(F.filter("aliases", lambda a: F.length(a) >= 2), 1, 6)).cast("long").alias("n"))


ENDED = r"replace(replace(text, ' de', chr(13) || ' de'), ' the', chr(13) || chr(10) || ' the')"


@query(rf"SELECT doc_id, array_to_string(l[greatest(len(l) - 14, 1):], chr(10)) AS tail FROM (SELECT doc_id, string_split_regex({ENDED}, '\r\n|\r|\n') AS l FROM documents)")
def lim_tail_lines(spark, sf):
    """Of texts whose lines end in all three ways."""
    ended = F.replace(F.replace("text", F.lit(" de"), F.lit("\r de")), F.lit(" the"), F.lit("\r\n the"))
    return table(spark, sf, "documents").select("doc_id", minutes.tail_lines(ended).alias("tail"))


CLEAN = r"list_distinct(list_filter(list_transform({0}, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{Nd}}\s]', '', 'g')), lambda x: length(x) >= 3 AND x NOT IN ({1})))"


def _stop() -> str:
    from ..functions.words import STOP_WORDS

    return ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


@query(f"{WITH}, p AS (SELECT meeting_id, ord, {CLEAN.format(TOKENS, _stop())} AS a FROM segments), q AS (SELECT meeting_id, ord, a, lag(a) OVER (PARTITION BY meeting_id ORDER BY ord) AS b FROM p) SELECT meeting_id, ord, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM q WHERE b IS NOT NULL")
def set_jaccard(spark, sf):
    p = segments(spark, sf).select("meeting_id", "ord", text.overlap_words(text.words(F.col("text"))).alias("a"))
    q = p.withColumn("b", F.lag("a").over(W.partitionBy("meeting_id").orderBy("ord"))).filter("b IS NOT NULL")
    return q.select("meeting_id", "ord", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"WITH {VOCABULARY}, u AS (SELECT lower(word) AS k, item_id, i, a FROM (SELECT word, item_id, unnest(aliases) AS a, unnest(range(0, len(aliases))) AS i FROM vocab)), f AS (SELECT k, lower(a) AS l, min_by(a, item_id * 10 + i) AS a FROM u GROUP BY ALL) SELECT k, count(*) AS n, string_agg(a, '|' ORDER BY a) AS aliases FROM f GROUP BY k")
def set_alias_union(spark, sf):
    """Aliases of terms that differ in case alone, united; the first spelling stays."""
    u = vocabulary(spark, sf).select(F.lower("word").alias("k"), "item_id", F.posexplode("aliases").alias("i", "a"))
    f = u.groupBy("k", F.lower("a").alias("l")).agg(F.min_by("a", F.struct("item_id", "i")).alias("a"))
    return f.groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("a")), "|").alias("aliases"))


@query(f"{WITH}, w AS (SELECT meeting_id, ord, unnest({TOKENS}) AS w, unnest(range(0, words)) AS i FROM segments) SELECT meeting_id, lower(w) AS k, min_by(w, ord * 100000 + i) AS spelled FROM w GROUP BY ALL")
def set_distinct_ci(spark, sf):
    w = segments(spark, sf).select("meeting_id", "ord", F.posexplode(text.words(F.col("text"))).alias("i", "w"))
    return w.groupBy("meeting_id", F.lower("w").alias("k")).agg(F.min_by("w", F.struct("ord", "i")).alias("spelled"))
