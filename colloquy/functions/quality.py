"""Detection of recognition faults and of unusable summary cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as lists
from .text import asr_words, content_words, jaccard, let, none_or_blank, normalize_sentence, overlap_words, strip, words

FAULT = "struct<type:string,metric:double>"


def _fault(kind: str, metric: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), metric.cast("double").alias("metric"))


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def speech_rate(n_words: Column, seconds: Column) -> Column:
    """A fault if more words were heard than can be spoken; else null."""
    short = _fault("SpeechRateExceeded", n_words / F.greatest(F.lit(0.05), seconds))
    second = _fault("SpeechRateExceeded", n_words / F.greatest(F.lit(0.1), seconds))
    longer = _fault("SpeechRateExceeded", n_words / seconds)
    return F.when((seconds < 0.5) & (n_words >= 3), short).when((seconds < 1.0) & (n_words >= 6), second).when((seconds >= 1.0) & (n_words / seconds > 8.0) & (n_words >= 10), longer)


def _repeats(w: Column, start: Column, n: int) -> Column:
    """How often the n words at start follow one another."""
    same = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda j: (F.pmod(j - start, F.lit(n)) == 0) & (j >= start) & (F.slice(w, j + 1, n) == F.slice(w, start + 1, n)))
    steps = F.filter(same, lambda hit, j: (j >= start) & (F.pmod(j - start, F.lit(n)) == 0))
    first_miss = F.array_position(steps, F.lit(False))
    return F.when(first_miss > 0, first_miss - 1).otherwise(F.size(steps))


def ngram_loop(tokens: Column) -> Column:
    """A fault if words or phrases repeat as a loop does; else null."""
    return let(F.transform(tokens, lambda x: F.lower(x)), _loop)


def _loop(w: Column) -> Column:
    n_words = F.size(w)

    def thrice(n: int) -> Column:
        # most places differ in the first word already
        here = lambda i: (_at(w, i) == _at(w, i + n)) & (F.slice(w, i + 1, n) == F.slice(w, i + n + 1, n)) & (F.slice(w, i + 1, n) == F.slice(w, i + 2 * n + 1, n))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n_words - 3 * n, F.lit(0))), here)
        return F.when(n_words >= 3 * n, F.get(starts, F.lit(0)))

    def fault_of(n: int) -> Column:
        return let(thrice(n), lambda start: F.when(start.isNotNull(), _fault("NgramRepetitionLoop", _repeats(w, start, n))))

    four = lambda i: (_at(w, i) == _at(w, i + 1)) & (_at(w, i) == _at(w, i + 2)) & (_at(w, i) == _at(w, i + 3))
    single = F.exists(F.sequence(F.lit(0), F.greatest(n_words - 4, F.lit(0))), lambda i: F.coalesce(four(i), F.lit(False)))
    out = F.when(n_words < 4, F.lit(None).cast(FAULT)).when(single, _fault("NgramRepetitionLoop", F.lit(4)))
    diversity = F.size(F.array_distinct(w)) / n_words
    poor = F.when((n_words >= 15) & (diversity < 0.25), _fault("NgramRepetitionLoop", diversity))
    return out.otherwise(F.coalesce(*[fault_of(n) for n in range(2, 6)], poor))


def lexical_diversity(tokens: Column) -> Column:
    return F.try_divide(F.size(F.array_distinct(F.transform(tokens, lambda x: F.lower(x)))), F.size(tokens))


def glossary_words(terms: Column) -> Column:
    """The words of a glossary's terms in order; compute them once for each glossary, not for each text."""
    return F.filter(F.flatten(F.transform(terms, lambda t: F.split(F.lower(t), r'[ \t\r\n,.;:!?()\[\]"«»]+'))), lambda x: F.length(x) >= 2)


def vocabulary_echo(tokens: Column, terms: Column, glossary: Column | None = None) -> Column:
    """A fault if the glossary was read out rather than speech; else null.

    ``glossary``: the terms' ``glossary_words``, if they are known already. The order match is a greedy scan that never starts over: the first word that
    no later glossary word equals ends it.
    """
    glossary = glossary_words(terms) if glossary is None else glossary
    given = F.struct(F.transform(tokens, lambda x: F.lower(x)).alias("w"), glossary.alias("glossary"), F.size(terms).alias("terms"))
    return let(given, lambda x: _echo(x["w"], x["glossary"], x["terms"]))


def _echo(w: Column, glossary: Column, n_terms: Column) -> Column:
    n_words = F.size(w)
    share = F.size(F.filter(w, lambda x: F.array_contains(glossary, x))) / n_words
    function_share = F.size(F.filter(w, lambda x: x.isin(lists.FUNCTION_WORDS))) / n_words

    def scan(state: Column, word: Column) -> Column:
        rest = F.slice(glossary, state["at"] + 1, F.size(glossary))
        found = F.array_position(rest, word).cast("int")
        going = state["at"] < F.size(glossary)
        return F.when(~going, state).otherwise(F.struct(F.when(found > 0, state["at"] + found).otherwise(F.size(glossary)).alias("at"), F.when(found > 0, state["n"] + 1).otherwise(state["n"]).alias("n")))

    in_order = F.aggregate(w, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), scan)["n"]
    usable = (n_words >= 4) & (F.size(glossary) > 0)
    by_share = usable & (share >= 0.70) & (function_share < 0.15) & (n_words >= 5)
    by_order = usable & (n_words >= 5) & (n_terms >= 5) & (in_order >= 5) & (in_order / n_words >= 0.60)
    return F.when(by_share, _fault("VocabularyEchoing", share)).when(by_order, _fault("VocabularyEchoing", in_order))


def detect_anomaly(text: Column, seconds: Column, terms: Column | None = None, glossary: Column | None = None) -> Column:
    """The first fault of rate, loop and echo; null for none."""

    def first(tokens: Column) -> Column:
        checks = [speech_rate(F.size(tokens), seconds), ngram_loop(tokens)]
        if terms is not None:
            checks.append(F.when(F.size(terms) > 0, vocabulary_echo(tokens, terms, glossary)))
        return F.when(F.size(tokens) > 0, F.coalesce(*checks))

    return let(asr_words(text), first)


def live_anomaly(text: Column, seconds: Column, official: Column) -> Column:
    """Whether a live result is a burst or a spilled glossary."""

    def judge(tokens: Column, known: Column) -> Column:
        n_words = F.size(tokens)
        burst = (n_words > 4) & (seconds > 0.05) & (F.try_divide(n_words, seconds) > 6.0)
        hits = F.transform(tokens, lambda x: F.array_contains(known, F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}]", "")))
        zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("all"))
        step = lambda s, hit: F.struct(F.when(hit, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(hit, s["run"] + 1).otherwise(0)).alias("best"), (s["all"] + hit.cast("int")).alias("all"))
        spill = let(F.aggregate(hits, zero, step), lambda r: (F.try_divide(r["all"], n_words) >= 0.85) & (r["best"] >= 4))
        return burst | ((n_words >= 4) & (F.size(known) >= 4) & spill)

    # what is known is made once a text, not once for each of its words
    bound = let(F.struct(words(text).alias("tokens"), F.transform(official, lambda x: F.lower(x)).alias("known")), lambda x: judge(x["tokens"], x["known"]))
    return F.coalesce(bound, F.lit(False))


def recovered(heard: Column, again: Column, seconds: Column, terms: Column) -> Column:
    """What stays of a region's text: itself if no fault is found, else what a second hearing gave, if that has none.

    Where neither is usable, a silent second hearing of less than 0.6 s drops the
    region (null), anything else is marked for review.
    """
    faulty = lambda x: detect_anomaly(x, seconds, terms).isNotNull()
    second = F.when(~none_or_blank(again) & ~faulty(again), again).when(none_or_blank(again) & (seconds < 0.6), F.lit(None)).otherwise(F.lit(lists.UNINTELLIGIBLE))
    return F.when(none_or_blank(heard), F.lit(None)).when(~faulty(heard), heard).otherwise(second)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def validate_card(summary: Column, transcript: Column, previous: Column, start: Column, end: Column, summarized: Column) -> Column:
    """The first reason against a summary card, null if it is good."""

    def judge(x: Column) -> Column:
        low, parts, norms, fours, long_parts, mine, theirs = (x[c] for c in ("low", "parts", "norms", "fours", "long", "mine", "theirs"))
        n_words = F.size(low)
        thrice = F.exists(fours, lambda g: F.size(F.filter(fours, lambda h: h == g)) >= 3)
        # compared at even offsets only
        evens = F.filter(F.sequence(F.lit(0), F.greatest(n_words - 6, F.lit(0))), lambda i: (i % 2 == 0) & (i + 6 <= n_words))
        pairs = F.exists(evens, lambda i: (F.slice(low, i + 1, 2) == F.slice(low, i + 3, 2)) & (F.slice(low, i + 1, 2) == F.slice(low, i + 5, 2)))

        def dominant(s: Column) -> Column:
            alike = F.size(F.filter(long_parts, lambda o: jaccard(s["w"], o["w"]) >= 0.70)) - F.when(F.size(s["w"]) > 0, 1).otherwise(0)
            return let(alike, lambda n: (n >= 1) & (s["n"] * (n + 1) >= n_words * 0.40))

        common = F.exists(mine, lambda w: F.array_contains(theirs, w) | ((F.length(w) >= 5) & F.exists(theirs, lambda t: t.startswith(F.substring(w, 1, 5)))))
        return (
            F.when((F.length(strip(summary)) < 12) | (n_words < 4), "EmptyOrTooShort")
            .when(F.size(norms) > F.size(F.array_distinct(norms)), "RepeatedSentence")
            .when(thrice | pairs, "DegenerativeLoop")
            .when((n_words >= 25) & (F.size(parts) >= 2) & F.exists(long_parts, dominant), "SentenceDominance")
            .when((n_words > 95) | (F.length(summary) > 650), "ExcessiveLength")
            .when((F.size(words(previous)) >= 8) & (jaccard(overlap_words(low), overlap_words(words(previous))) >= 0.82), "DuplicateOfPreviousCard")
            .when((F.size(theirs) >= 5) & (F.size(mine) >= 5) & ~common, "SemanticDisconnect")
        )

    def parsed(low: Column) -> Column:
        n_words, parts = F.size(low), sentences(summary)
        fours = F.when(n_words >= 4, F.transform(F.sequence(F.lit(0), F.greatest(n_words - 4, F.lit(0))), lambda i: F.array_join(F.slice(low, i + 1, 4), " "))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            low.alias("low"),
            parts.alias("parts"),
            F.filter(F.transform(parts, normalize_sentence), lambda s: (F.length(s) >= 10) & (F.size(words(s)) >= 3)).alias("norms"),
            fours.alias("fours"),
            F.transform(F.filter(parts, lambda s: F.size(words(s)) >= 6), lambda s: F.struct(F.size(words(s)).alias("n"), overlap_words(words(s)).alias("w"))).alias("long"),
            content_words(F.coalesce(summary, F.lit(""))).alias("mine"),
            content_words(F.coalesce(transcript, F.lit(""))).alias("theirs"),
        )

    reason = let(let(words(F.lower(F.coalesce(summary, F.lit("")))), parsed), judge)
    return F.when((end <= start) | (end <= summarized), "InvalidTimeRange").when(none_or_blank(summary), "EmptyOrTooShort").otherwise(reason)
