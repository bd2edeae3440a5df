"""Queries over string, time, JSON, map and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality, text, times, vectors
from ..functions.words import FUNCTION_WORDS, HALLUCINATIONS, INCOMPLETE_ENDINGS, PREAMBLES, STOP_WORDS
from ..operators import aliases
from ..sources.shared import cut
from .basic import ASR, TOKENS
from .derived import WITH, segments, table
from .registry import query


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in dict.fromkeys(values)) + "]"


@query(rf"SELECT doc_id, len({TOKENS}) AS n FROM documents")
def str_count_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.count_words(F.col("text")).cast("long").alias("n"))


INCOMPLETE = rf"""CASE WHEN length(trim(t)) = 0 THEN false ELSE regexp_matches(t, '[,:;\-–]$') OR NOT regexp_matches(t, '[.?!…]$')
  OR coalesce(regexp_matches(nxt, '^\s*\p{{Ll}}'), false)
  OR coalesce(list_contains({_list(INCOMPLETE_ENDINGS)}, lower(list_filter(string_split_regex(regexp_replace(t, '[.!?…,;:]+$', ''), '\s+'), lambda x: len(x) > 0)[-1])), false) END"""
PAIRS = f"{WITH}, p AS (SELECT meeting_id, ord, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, trim(lead(text) OVER (PARTITION BY meeting_id ORDER BY ord), ' ' || chr(9) || chr(10) || chr(13)) AS nxt FROM segments)"


def _pairs(spark, sf):
    from pyspark.sql import Window as W

    following = F.lead("text").over(W.partitionBy("meeting_id").orderBy("ord"))
    return segments(spark, sf).select("meeting_id", "ord", F.col("text").alias("t"), following.alias("nxt"))


@query(f"{PAIRS} SELECT meeting_id, ord, {INCOMPLETE} AS incomplete FROM p")
def str_sentence_incomplete(spark, sf):
    return _pairs(spark, sf).select("meeting_id", "ord", text.sentence_incomplete(F.col("t"), F.col("nxt")).alias("incomplete"))


@query(rf"{PAIRS} SELECT meeting_id, ord, CASE WHEN nxt IS NULL OR nxt = '' THEN t WHEN t = '' THEN nxt WHEN ends_with(t, '.') AND ({INCOMPLETE}) THEN regexp_replace(t, '\.+$', '') || ' ' || nxt ELSE t || ' ' || nxt END AS combined FROM p")
def str_combine(spark, sf):
    return _pairs(spark, sf).select("meeting_id", "ord", text.combine(F.col("t"), F.col("nxt")).alias("combined"))


SANITIZED = rf"""CASE WHEN length(t) > 1 AND ((starts_with(t, '[') AND ends_with(t, ']')) OR (starts_with(t, '(') AND ends_with(t, ')'))) THEN ''
  WHEN len(list_filter({_list(HALLUCINATIONS)}, lambda p: contains(lower(c), p))) > 0 OR regexp_matches(c, '^[\p{{P}}\s]*$') OR length(c) < 2 THEN '' ELSE c END"""


@query(rf"SELECT doc_id, {SANITIZED} AS clean FROM (SELECT doc_id, t, trim(regexp_replace(regexp_replace(t, '\[.*?\]|\(.*?\)', '', 'g'), '\s{{2,}}', ' ', 'g')) AS c FROM (SELECT doc_id, trim(CASE WHEN doc_id % 5 = 0 THEN '[Música]' WHEN doc_id % 5 = 1 THEN '(risas) ' || text WHEN doc_id % 7 = 0 THEN text || ' gracias por ver' WHEN doc_id % 11 = 0 THEN '...' ELSE text END, chr(10) || ' ') AS t FROM documents))")
def str_sanitize_asr(spark, sf):
    d, t = F.col("doc_id"), F.col("text")
    heard = F.when(d % 5 == 0, F.lit("[Música]")).when(d % 5 == 1, F.concat(F.lit("(risas) "), t)).when(d % 7 == 0, F.concat(t, F.lit(" gracias por ver"))).when(d % 11 == 0, F.lit("...")).otherwise(t)
    return table(spark, sf, "documents").select("doc_id", text.sanitize_asr(heard).alias("clean"))


def _replaced(text: str, alias: str, word: str) -> str:
    """SQL of a text with an alias replaced between what are no letters; twice, as neighbours share what is between them."""
    for _ in range(2):
        text = rf"regexp_replace({text}, '(^|[^\p{{L}}])(?i:{alias})([^\p{{L}}]|$)', '\1{word}\2', 'g')"
    return text


@query(f"SELECT doc_id, {_replaced(_replaced(_replaced('text', 'thing', 'cosa'), 'the', 'ze'), 'and', 'y')} AS text FROM documents")
def str_replace_aliases(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.replace_aliases(F.col("text"), [("the", "ze"), ("thing", "cosa"), ("and", "y")]).alias("text"))


@query(rf"""WITH a AS (SELECT item_id, unnest(regexp_extract_all(text, '\p{{L}}+')) AS alias FROM benchmark), v AS (SELECT lower(alias) AS k, min(item_id) AS item FROM a WHERE length(alias) > 3 GROUP BY ALL),
p AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{{L}}+|\P{{L}}+') AS l FROM documents))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(coalesce('«' || v.item || '»', x), '' ORDER BY i) AS text FROM p LEFT JOIN v ON v.k = lower(p.x) GROUP BY doc_id) r USING (doc_id)""")
def jn_aliases(spark, sf):
    """Every word of over three letters of the benchmark as an alias of its first item's number, over whole texts."""
    words = F.filter(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) > 3)
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("«"), F.col("item_id").cast("string"), F.lit("»")).alias("word"), words.alias("aliases"))
    return aliases.replace_vocabulary(table(spark, sf, "documents").select("doc_id", "text"), terms)


@query()
def str_phonetic_aliases(spark, sf):
    w = segments(spark, sf).select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    return w.select("word", F.array_join(text.phonetic_aliases(F.col("word")), "|").alias("aliases"))


@query(r"WITH p AS (SELECT doc_id, unnest(l) AS a, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,;\n\r]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)), f AS (SELECT doc_id, min_by(a, i) AS a, min(i) AS i FROM p GROUP BY doc_id, lower(a)) SELECT doc_id, string_agg(a, '|' ORDER BY i) AS aliases FROM f GROUP BY doc_id")
def str_parse_aliases(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.parse_aliases(F.col("text")), "|").alias("aliases")).filter("aliases <> ''")


@query(rf"SELECT item_id, 'Glosario: ' || array_to_string(({TOKENS})[1:5], ', ') || '.' AS prompt FROM benchmark WHERE len({TOKENS}) > 0")
def str_glossary_prompt(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.glossary_prompt(F.slice(text.words(F.col("text")), 1, 5)).alias("prompt")).filter("prompt <> ''")


@query(rf"SELECT doc_id, len({ASR}) AS n, array_to_string(({ASR})[1:3], '|') AS head FROM documents")
def str_asr_words(spark, sf):
    w = text.asr_words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(F.slice(w, 1, 3), "|").alias("head"))


RATE = f"{WITH}, w AS (SELECT meeting_id, ord, len({ASR}) AS n, words * (CASE ord % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.1 ELSE 0.4 END)::DOUBLE AS s FROM segments)"


def _seconds():
    return F.col("words") * F.when(F.col("ord") % 3 == 0, 0.01).when(F.col("ord") % 3 == 1, 0.1).otherwise(0.4)


@query(f"{RATE} SELECT meeting_id, ord, round(CASE WHEN s < 0.5 AND n >= 3 THEN n / greatest(0.05, s) WHEN s < 1 AND n >= 6 THEN n / greatest(0.1, s) WHEN s >= 1 AND n / s > 8 AND n >= 10 THEN n / s END, 4) AS rate FROM w")
def qa_speech_rate(spark, sf):
    s = segments(spark, sf)
    return s.select("meeting_id", "ord", F.round(quality.speech_rate(F.size(text.asr_words(F.col("text"))), _seconds())["metric"], 4).alias("rate"))


LOOP = """CASE WHEN len(w) < 4 THEN NULL WHEN len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i+1] AND w[i] = w[i+2] AND w[i] = w[i+3])) > 0 THEN 1
 WHEN len(list_filter(range(1, greatest(len(w) - 4, 1)), lambda i: w[i:i+1] = w[i+2:i+3] AND w[i:i+1] = w[i+4:i+5])) > 0 THEN 2
 WHEN len(list_filter(range(1, greatest(len(w) - 7, 1)), lambda i: w[i:i+2] = w[i+3:i+5] AND w[i:i+2] = w[i+6:i+8])) > 0 THEN 3
 WHEN len(list_filter(range(1, greatest(len(w) - 10, 1)), lambda i: w[i:i+3] = w[i+4:i+7] AND w[i:i+3] = w[i+8:i+11])) > 0 THEN 4
 WHEN len(list_filter(range(1, greatest(len(w) - 13, 1)), lambda i: w[i:i+4] = w[i+5:i+9] AND w[i:i+4] = w[i+10:i+14])) > 0 THEN 5
 WHEN len(w) >= 15 AND len(list_distinct(w)) / len(w) < 0.25 THEN 0 END"""


# how many words in a row equal the one so many places on; a loop is a long enough run of them
SHIFTED = ", ".join(f"w = lead(w, {n}) OVER p AS e{n}" for n in range(1, 6))
LOOPED = " OR ".join(f"sum(e{n}::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {max(2 * n, 3) - 1} FOLLOWING) = {max(2 * n, 3)}" for n in range(1, 6))


@query(f"""WITH t AS (SELECT doc_id, list_transform({ASR}, lambda x: lower(x)) AS a FROM documents), w AS (SELECT doc_id, unnest(a) AS w, unnest(range(len(a))) AS i FROM t),
e AS (SELECT doc_id, i, {SHIFTED} FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)), r AS (SELECT doc_id, bool_or(coalesce(looped, false)) AS looped FROM (SELECT doc_id, {LOOPED} AS looped FROM e) GROUP BY doc_id)
SELECT t.doc_id, coalesce(r.looped, false) OR (len(a) >= 15 AND len(list_distinct(a)) / len(a) < 0.25) AS looped FROM t LEFT JOIN r USING (doc_id)""")
def qa_ngram_loop(spark, sf):
    return table(spark, sf, "documents").select("doc_id", quality.ngram_loop(text.asr_words(F.col("text"))).isNotNull().alias("looped"))


def _with_terms(spark, sf):
    """Segments with the glossary of their meeting: twenty items each, all items over all meetings."""
    b = table(spark, sf, "benchmark").filter("text IS NOT NULL")
    glossaries = b.groupBy(F.floor(F.col("item_id") / 20).alias("g")).agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("t"))
    glossaries = glossaries.select("g", F.transform("t", lambda x: x["text"]).alias("terms"))
    known = F.array_distinct(F.flatten(F.transform("terms", lambda t: text.words(F.lower(t)))))
    glossaries = cut(glossaries.withColumns({"glossary": quality.glossary_words(F.col("terms")), "known": known}))  # parsed once, not for each segment
    n = (b.agg(F.max(F.floor(F.col("item_id") / 20))).first()[0] or 0) + 1
    s = segments(spark, sf).withColumn("g", F.pmod("meeting_id", F.lit(n)))
    return s.join(glossaries, "g", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("terms", "glossary", "known")})


TERMS = "gl AS (SELECT item_id // 20 AS g, list(text ORDER BY item_id, text) AS terms FROM benchmark WHERE text IS NOT NULL GROUP BY ALL), gs AS (SELECT s.*, coalesce(gl.terms, []) AS terms FROM (SELECT *, meeting_id % (SELECT max(item_id // 20) + 1 FROM benchmark) AS g FROM segments) s LEFT JOIN gl USING (g))"
# the words in order: a state of (place, matches) taken from word to word
ECHO = rf"""ge AS (SELECT meeting_id, ord, w, len(terms) AS terms, list_filter(flatten(list_transform(terms, lambda t: string_split_regex(lower(t), '[ \t\r\n,.;:!?()\[\]"«»]+'))), lambda x: length(x) >= 2) AS g FROM (SELECT *, list_transform({ASR}, lambda x: lower(x)) AS w FROM gs)),
gq AS (SELECT *, len(list_filter(w, lambda x: list_contains(g, x))) / len(w) AS share, len(list_filter(w, lambda x: list_contains({_list(FUNCTION_WORDS)}, x))) / len(w) AS usual, list_reduce(list_prepend({{'at': 0, 'n': 0, 'w': ''}}, list_transform(w, lambda x: {{'at': 0, 'n': 0, 'w': x}})),
  lambda s, x: CASE WHEN s.at >= len(g) THEN s WHEN list_contains(g[s.at + 1:], x.w) THEN {{'at': s.at + list_position(g[s.at + 1:], x.w), 'n': s.n + 1, 'w': ''}} ELSE {{'at': len(g)::INT, 'n': s.n, 'w': ''}} END).n AS in_order FROM ge),
gf AS (SELECT meeting_id, ord, CASE WHEN len(w) >= 5 AND len(g) > 0 AND share >= 0.70 AND usual < 0.15 THEN share WHEN len(w) >= 5 AND len(g) > 0 AND terms >= 5 AND in_order >= 5 AND in_order / len(w) >= 0.60 THEN in_order END AS echo FROM gq)"""


@query(f"{WITH}, {TERMS}, {ECHO} SELECT meeting_id, ord, CASE WHEN echo IS NOT NULL THEN 'VocabularyEchoing' END AS type, round(echo, 6) AS metric FROM gf")
def qa_vocab_echo(spark, sf):
    s = _with_terms(spark, sf).select("meeting_id", "ord", quality.vocabulary_echo(text.asr_words(F.col("text")), F.col("terms"), F.col("glossary")).alias("fault"))
    return s.select("meeting_id", "ord", "fault.type", F.round("fault.metric", 6).alias("metric"))


@query(f"{WITH}, {TERMS}, {ECHO}, w AS (SELECT meeting_id, ord, list_transform({ASR}, lambda x: lower(x)) AS w, words * (CASE ord % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.1 ELSE 0.4 END)::DOUBLE AS s FROM segments) SELECT meeting_id, ord, CASE WHEN len(w) = 0 THEN NULL WHEN (s < 0.5 AND len(w) >= 3) OR (s < 1 AND len(w) >= 6) OR (s >= 1 AND len(w) / s > 8 AND len(w) >= 10) THEN 'SpeechRateExceeded' WHEN ({LOOP}) IS NOT NULL THEN 'NgramRepetitionLoop' WHEN echo IS NOT NULL THEN 'VocabularyEchoing' END AS type FROM w JOIN gf USING (meeting_id, ord)")
def qa_detect_anomaly(spark, sf):
    return _with_terms(spark, sf).select("meeting_id", "ord", quality.detect_anomaly(F.col("text"), _seconds(), F.col("terms"), F.col("glossary"))["type"].alias("type"))


FAULTY = f"(len(w) > 0 AND ((s < 0.5 AND len(w) >= 3) OR (s < 1 AND len(w) >= 6) OR (s >= 1 AND len(w) / s > 8 AND len(w) >= 10) OR ({LOOP}) IS NOT NULL))"


@query(rf"""{WITH}, t AS (SELECT meeting_id, ord, words * (CASE ord % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.1 ELSE 0.4 END)::DOUBLE AS s, text, CASE WHEN ord % 4 = 0 THEN '' WHEN ord % 4 = 1 THEN 'Bien.' ELSE text END AS again FROM segments),
h AS (SELECT meeting_id, ord, s, text, again, list_transform({ASR}, lambda x: lower(x)) AS w FROM t), g AS (SELECT *, {FAULTY} AS bad FROM h), a AS (SELECT *, CASE WHEN again = '' THEN false WHEN again = text THEN bad ELSE false END AS bad_again FROM g)
SELECT meeting_id, ord, CASE WHEN NOT bad THEN text WHEN again <> '' AND NOT bad_again THEN again WHEN again = '' AND s < 0.6 THEN NULL ELSE '[Ininteligible / pendiente de revisión]' END AS text FROM a WHERE trim(text) <> ''""")
def qa_region_recovery(spark, sf):
    """A second hearing that is silent, clear, or the same as the first."""
    again = F.when(F.col("ord") % 4 == 0, F.lit("")).when(F.col("ord") % 4 == 1, F.lit("Bien.")).otherwise(F.col("text"))
    none = F.array().cast("array<string>")
    s = segments(spark, sf).filter(~text.none_or_blank(F.col("text")))
    return s.select("meeting_id", "ord", quality.recovered(F.col("text"), again, _seconds(), none).alias("text"))


@query(rf"{WITH}, {TERMS}, w AS (SELECT meeting_id, ord, {TOKENS} AS w, list_distinct(flatten(list_transform(terms, lambda t: list_filter(string_split_regex(lower(t), '\s+'), lambda x: len(x) > 0)))) AS known, words * (CASE ord % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.1 ELSE 0.4 END)::DOUBLE AS s FROM gs), h AS (SELECT meeting_id, ord, s, len(w) AS n, len(known) AS k, array_to_string(list_transform(w, lambda x: CASE WHEN list_contains(known, regexp_replace(lower(x), '[^\p{{L}}\p{{Nd}}]', '', 'g')) THEN '1' ELSE '0' END), '') AS hits FROM w) SELECT meeting_id, ord, (n > 4 AND s > 0.05 AND n / s > 6) OR (n >= 4 AND k >= 4 AND length(replace(hits, '0', '')) / n >= 0.85 AND contains(hits, '1111')) AS anomalous FROM h")
def qa_live_anomaly(spark, sf):
    return _with_terms(spark, sf).select("meeting_id", "ord", quality.live_anomaly(F.col("text"), _seconds(), F.col("known")).alias("anomalous"))


@query()
def qa_validate_card(spark, sf):
    from pyspark.sql import Window as W

    before = F.lag("text").over(W.partitionBy("meeting_id").orderBy("ord"))
    s = segments(spark, sf).withColumn("previous", before)
    return s.select("meeting_id", "ord", quality.validate_card(F.col("text"), F.col("text"), F.col("previous"), F.col("start_us"), F.col("end_us"), F.lit(0)).alias("reason"))


NORM = rf"trim(regexp_replace(regexp_replace(lower(trim(t)), '[^\p{{L}}\p{{Nd}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"SELECT doc_id, CASE WHEN len(pre) > 0 THEN trim(n[length(pre[1]) + 1:]) ELSE n END AS norm FROM (SELECT doc_id, n, list_filter({_list(PREAMBLES)}, lambda p: starts_with(n, p)) AS pre FROM (SELECT doc_id, {NORM} AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Se ha comentado que ' || text ELSE text END AS t FROM documents)))")
def str_normalize_sentence(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Se ha comentado que "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.normalize_sentence(t).alias("norm"))


@query(rf"SELECT doc_id, len(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{Nd}}\s]', ' ', 'g'), '\s+'), lambda x: length(x) >= 4 AND NOT list_contains({_list(STOP_WORDS)}, x)))) AS n FROM documents")
def str_content_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.content_words(F.col("text"))).cast("long").alias("n"))


@query(rf"SELECT doc_id, len(list_filter(list_transform({TOKENS}, lambda x: lower(x)), lambda x: list_contains({_list(FUNCTION_WORDS)}, x))) AS n FROM documents")
def str_function_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(text.words(F.lower("text")), lambda x: x.isin(FUNCTION_WORDS))).cast("long").alias("n"))


# Times, JSON, maps, vectors


@query("SELECT event_id, ((h * 60 + m) * 60 + s) * 1000000 + ms * 1000 AS us FROM (SELECT event_id, event_id % 30 AS h, event_id % 60 AS m, event_id * 7 % 60 AS s, event_id * 13 % 1000 AS ms FROM events)")
def dt_parse_offset(spark, sf):
    e = F.col("event_id")
    stamp = F.format_string("%d:%02d:%02d,%03d", e % 30, e % 60, e * 7 % 60, e * 13 % 1000)
    return table(spark, sf, "events").select("event_id", times.parse_offset(stamp).alias("us"))


@query("SELECT event_id, strftime(ts, '%d/%m/%Y') AS day, strftime(ts, '%H:%M') AS hour, strftime(ts, '%Y-%m-%d_%H-%M') AS base FROM events")
def dt_format(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("day"), F.date_format("ts", "HH:mm").alias("hour"), F.date_format("ts", "yyyy-MM-dd_HH-mm").alias("base"))


@query("SELECT event_id, props->>'$.k' AS id, event_type AS content, lower(event_type) = 'error' AS truncated, (props->>'$.k')::BIGINT + event_id AS total FROM events")
def js_chat_response(spark, sf):
    """Chat responses as JSON: content as text or as parts, token totals."""
    from ..sources.chat import parse_chat

    parts = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct("event_type"))).otherwise(F.lit(None))
    content = F.when(parts.isNull(), F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.concat(F.lit('[{"type":"text","text":"'), "event_type", F.lit('"}]')))
    finish = F.when(F.col("event_type") == "error", "Length").otherwise("stop")
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"id":"'), k, F.lit('","model":"m","choices":[{"finish_reason":"'), finish, F.lit('","message":{"content":'), content, F.lit('}}],"usage":{"prompt_tokens":'), k, F.lit(',"completion_tokens":'), F.col("event_id").cast("string"), F.lit("}}"))
    out = table(spark, sf, "events").select("event_id", parse_chat(body).alias("r"))
    return out.select("event_id", "r.id", "r.content", "r.truncated", "r.total")


@query("SELECT event_id, coalesce(lower(event_type) = 'error', false) AS truncated, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE event_id % 7 + event_id % 11 END AS total FROM events")
def js_usage_flags(spark, sf):
    """Responses that end in ``LENGTH`` or else, every third one with a total of its own."""
    from ..sources.chat import parse_chat

    e = F.col("event_id")
    finish = F.when(F.lower("event_type") == "error", "LENGTH").otherwise("stop")
    own = F.when(e % 3 == 0, F.format_string(',"total_tokens":%d', e % 5)).otherwise("")
    usage = F.concat(F.format_string('"prompt_tokens":%d,"completion_tokens":%d', e % 7, e % 11), own)
    body = F.concat(F.lit('{"choices":[{"finish_reason":"'), finish, F.lit('","message":{"content":"x"}}],"usage":{'), usage, F.lit("}}"))
    return table(spark, sf, "events").select("event_id", parse_chat(body).alias("r")).select("event_id", "r.truncated", "r.total")


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN embedding[1]::DOUBLE END AS x FROM embeddings")
def map_centroids(spark, sf):
    m = F.create_map(F.lower(F.lit("SPEAKER_0")), F.col("embedding").cast("array<double>"))
    asked = F.when(F.col("vec_id") % 2 == 0, "Speaker_0").otherwise("SPEAKER_1")
    return table(spark, sf, "embeddings").select("vec_id", F.get(vectors.centroid_of(m, asked), F.lit(0)).alias("x"))


@query("WITH RECURSIVE l AS (SELECT o_orderkey AS id, o_orderkey // 10 * 10 + greatest(o_orderkey % 10 - 1, 0) AS target FROM orders), r AS (SELECT id, target, 0 AS step FROM l UNION ALL SELECT r.id, l.target, step + 1 FROM r JOIN l ON l.id = r.target WHERE l.target <> r.target) SELECT id, max_by(target, step) AS resolved FROM r GROUP BY id")
def map_alias_chain(spark, sf):
    """Every id resolved along its chain of aliases to the last one; every tenth stands for itself."""
    from ..operators.speakers import resolve_aliases

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("n"))
    links = o.select("id", (F.floor(F.col("n") / 10) * 10 + F.greatest(F.col("n") % 10 - 1, F.lit(0))).alias("target"))
    return resolve_aliases(links)


PAIR = "p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _vector_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


@query(f"WITH {PAIR} SELECT vec_id, round(list_cosine_similarity(x::DOUBLE[], y::DOUBLE[]), 6) AS cosine FROM p")
def vec_cosine(spark, sf):
    return _vector_pairs(spark, sf).select("vec_id", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(greatest(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 1e-12)), 6) AS first FROM embeddings")
def vec_l2norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.get(vectors.l2_norm(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query(f"WITH {PAIR} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (x[i]::DOUBLE - y[i]) * (x[i]::DOUBLE - y[i]))), 6) AS d2 FROM p")
def vec_sqdist(spark, sf):
    return _vector_pairs(spark, sf).select("vec_id", F.round(vectors.squared_distance(F.col("x"), F.col("y")), 6).alias("d2"))


@query(f"WITH {PAIR} SELECT vec_id, round(list_avg(list_transform(range(1, 65), lambda i: (x[i]::DOUBLE + y[i]) / 2)), 6) AS mean, len(x) // 3 AS n FROM p")
def sig_downmix(spark, sf):
    p = _vector_pairs(spark, sf).select("vec_id", vectors.downmix(F.zip_with("x", "y", lambda a, b: F.array(a, b))).alias("m"))
    resampled = vectors.resample(F.col("m"), 48_000, 16_000)
    mean = F.aggregate("m", F.lit(0.0), lambda s, x: s + x) / F.size("m")
    return p.select("vec_id", F.round(mean, 6).alias("mean"), F.size(resampled).cast("long").alias("n"))


@query("SELECT vec_id, round(embedding[1 + 4]::DOUBLE + (embedding[1 + 5] - embedding[1 + 4]::DOUBLE) * 0.5, 6) AS third FROM embeddings")
def sig_resample(spark, sf):
    r = vectors.resample(F.col("embedding"), 36_000, 16_000)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.get(r, F.lit(2)), 6).alias("third"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: trunc(least(greatest(x::DOUBLE * 3, -1), 1) * 32767)))::BIGINT AS total FROM embeddings")
def sig_pcm16(spark, sf):
    p = vectors.pcm16(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf, "embeddings").select("vec_id", F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"WITH {PAIR} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x[i]::DOUBLE * 4 + y[i]::DOUBLE * 4 > 0.9 THEN 0.9 + 0.1 * tanh((x[i]::DOUBLE * 4 + y[i]::DOUBLE * 4 - 0.9) / 0.1) WHEN x[i]::DOUBLE * 4 + y[i]::DOUBLE * 4 < -0.9 THEN -0.9 + 0.1 * tanh((x[i]::DOUBLE * 4 + y[i]::DOUBLE * 4 + 0.9) / 0.1) ELSE x[i]::DOUBLE * 4 + y[i]::DOUBLE * 4 END)), 6) AS total FROM p")
def sig_mix(spark, sf):
    m = vectors.mix(F.col("x"), F.col("y"), 4.0, 4.0)
    return _vector_pairs(spark, sf).select("vec_id", F.round(F.aggregate(m, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
