"""Text functions over columns; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as lists

SPACE = r"(?U)\s+"
# What ``SPACE`` matches, character by character.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def none_or_blank(x: Column) -> Column:
    return x.isNull() | ~x.rlike(r"(?U)\S")


def strip(x: Column) -> Column:
    """Without white space at both ends; no pattern looks through what is between."""
    return F.btrim(x, F.lit(SPACES))


def words(x: Column) -> Column:
    """Pieces between white space; an empty array for null."""
    return F.coalesce(F.filter(F.split(x, SPACE), lambda w: w != ""), F.array().cast("array<string>"))


def count_words(x: Column) -> Column:
    return F.size(words(x))


def one_of(x: Column, values: list[str]) -> Column:
    return F.lower(x).isin([v.lower() for v in values])


def sentence_incomplete(text: Column, following: Column) -> Column:
    """Whether the text stops before its sentence does; blank texts do not."""

    def judge(t: Column) -> Column:
        open_end = t.rlike(r"[,:;\-–]$") | ~t.rlike(r"[.?!…]$")
        continued = F.coalesce(strip(following).rlike(r"^\p{Ll}"), F.lit(False))
        last = F.try_element_at(words(F.regexp_replace(t, r"[.!?…,;:]+$", "")), F.lit(-1))
        return F.when(F.length(t) > 0, open_end | continued | F.coalesce(one_of(last, lists.INCOMPLETE_ENDINGS), F.lit(False))).otherwise(F.lit(False))

    return let(strip(text), judge)


def combine(first: Column, second: Column) -> Column:
    """Both texts in one line; a full stop within a sentence goes."""

    def joined(x: Column) -> Column:
        a, b = x["a"], x["b"]
        open_a = F.when(a.endswith(".") & sentence_incomplete(a, b), F.regexp_replace(a, r"\.+$", "")).otherwise(a)
        return F.when(a == "", b).when(b == "", a).otherwise(F.concat(open_a, F.lit(" "), b))

    return let(F.struct(F.coalesce(strip(first), F.lit("")).alias("a"), F.coalesce(strip(second), F.lit("")).alias("b")), joined)


def sanitize_asr(raw: Column) -> Column:
    """Recognised text without sound tags; hallucinated and empty ones become ''."""
    t = strip(raw)
    tag = t.rlike(r"(?s)^(\[.*\]|\(.*\))$") & (F.length(t) > 1)
    clean = strip(F.regexp_replace(F.regexp_replace(t, r"\[.*?\]|\(.*?\)", ""), r"(?U)\s{2,}", " "))

    def kept(x: Column) -> Column:
        imagined = F.exists(F.array(*[F.lit(p) for p in lists.HALLUCINATIONS]), lambda p: F.contains(F.lower(x), p))
        empty = x.rlike(r"^[\p{P}\s]*$") | (F.length(x) < 2)
        return F.when(imagined | empty, F.lit("")).otherwise(x)

    return F.when(none_or_blank(raw) | tag, F.lit("")).otherwise(let(clean, kept))


def replace_aliases(text: Column, vocabulary: list[tuple[str, str]]) -> Column:
    """Rewrites aliases to their words, longest alias first, each over the result of the one before."""
    for alias, word in sorted(((a, w) for a, w in vocabulary if a.strip()), key=lambda x: -len(x[0])):
        text = F.regexp_replace(text, rf"(?iu)(?<!\p{{L}}){_quoted(alias)}(?!\p{{L}})", word.replace("\\", "\\\\"))
    return text


def _quoted(literal: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-#&~])", r"\\\1", literal)


def first_spellings(items: Column) -> Column:
    """The array without later items that differ in case alone."""
    # sorted by spelling, equal ones are neighbours; sorted by place again, the first of each remain
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    firsts = let(placed, lambda a: F.filter(a, lambda y, i: (i == 0) | (y["low"] != F.get(a, i - 1)["low"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"])


def parse_aliases(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"[,;\n\r]"), strip), lambda x: x != "")
    return first_spellings(parts)


def glossary_prompt(terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.concat(F.lit("Glosario: "), F.array_join(terms, ", "), F.lit("."))).otherwise(F.lit(""))


def phonetic_aliases(word: Column, most: int = 6) -> Column:
    """Likely misspellings of a Basque or Spanish name, ``most`` at most."""

    def of(t: Column) -> Column:
        base = F.lower(t)
        letters = F.regexp_replace(t, r"\P{L}", "")
        capitals = (F.length(t) > 1) & (letters == F.upper(letters))
        made = F.array(base)

        def grown(made: Column, applies: Column, more: Callable[[Column], Column]) -> Column:
            return let(made, lambda m: F.when(applies, F.array_distinct(F.concat(m, more(m)))).otherwise(m))

        def replaced(sound: str, heard: tuple[str, ...]) -> Callable[[Column], Column]:
            return lambda m: F.flatten(F.transform(m, lambda v: F.array(*[F.replace(v, F.lit(sound), F.lit(h)) for h in heard])))

        # Sounds and how they are heard.
        for sound, heard in (("tz", ("ch", "z", "s")), ("ts", ("ch", "s", "tx")), ("tx", ("ch",)), ("x", ("ch", "s"))):
            made = grown(made, F.contains(base, F.lit(sound)), replaced(sound, heard))
        made = grown(made, base.startswith("h"), lambda m: F.transform(F.filter(m, lambda v: v.startswith("h")), lambda v: F.substring(v, 2, F.length(v))))
        hard = lambda v: F.array(F.regexp_replace(F.regexp_replace(v, r"k(?=[aou\s]|$)", "c"), "k(?=[ei])", "qu"), F.replace(v, F.lit("k"), F.lit("c")))
        made = grown(made, F.contains(base, F.lit("k")), lambda m: F.flatten(F.transform(m, hard)))
        made = grown(made, F.contains(base, F.lit("z")), replaced("z", ("s",)))
        title = lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, 2, F.length(v)))
        made = let(made, lambda m: F.when(~capitals & t.rlike(r"^\p{Lu}"), F.transform(m, title)).otherwise(m))
        with_h = F.when(base.rlike(r"^(?!h)\p{L}"), F.array(F.concat(F.lit("H"), F.substring(base, 2, F.length(base))))).otherwise(F.array().cast("array<string>"))
        kept = F.filter(first_spellings(F.concat(with_h, made)), lambda v: (F.lower(v) != base) & (F.length(v) >= 2))
        return F.slice(kept, 1, most)

    return F.when(none_or_blank(word), F.array().cast("array<string>")).otherwise(let(strip(word), of))


def asr_words(text: Column) -> Column:
    """Recognised words: cut at punctuation, begun by a letter or digit."""
    parts = F.split(text, r'[ \t\r\n,.;:!?()\[\]"«»]+')
    return F.coalesce(F.filter(parts, lambda w: w.rlike(r"^[\p{L}\p{Nd}]")), F.array().cast("array<string>"))


def normalize_sentence(sentence: Column) -> Column:
    clean = F.regexp_replace(F.lower(strip(sentence)), r"[^\p{L}\p{Nd}\s]", " ")
    clean = strip(F.regexp_replace(clean, SPACE, " "))

    def body(x: Column) -> Column:
        begins = F.filter(F.array(*[F.lit(p) for p in lists.PREAMBLES]), lambda p: x.startswith(p))
        return strip(F.substring(x, F.coalesce(F.length(F.get(begins, F.lit(0))), F.lit(0)) + 1, F.length(x)))

    return let(clean, body)


def content_words(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}\s]", " ")
    return F.array_distinct(F.filter(words(clean), lambda w: (F.length(w) >= 4) & ~w.isin(lists.STOP_WORDS)))


def overlap_words(tokens: Column) -> Column:
    cleaned = F.transform(tokens, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{Nd}\s]", ""))
    return F.array_distinct(F.filter(cleaned, lambda w: (F.length(w) >= 3) & ~w.isin(lists.STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word arrays; 0 if either is empty."""

    def share(x: Column) -> Column:
        none = (F.size(x["a"]) == 0) | (F.size(x["b"]) == 0)
        return F.when(none, F.lit(0.0)).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"])))

    return let(F.struct(a.alias("a"), b.alias("b")), share)
