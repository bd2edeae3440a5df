"""Benchmark decontamination over a distributed positional inverted index.

Words are the runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII
characters. Test phrases are the windows of ``width`` consecutive words of each
item; an item with fewer words, but not none, is one phrase.

1. Frequencies of all words that any item uses, over the whole corpus.
2. The index terms: of each phrase the two rarest words (ties: the smaller word).
   The index holds one posting list (term, document, positions) for each of them.
3. Lists are intersected after their offsets in the item are taken off: postings
   that agree on (document, item, position - offset) stand on one diagonal, and a
   diagonal goes on if two postings meet there (one, for phrases of one word).
4. The other words of each phrase are compared along the remaining diagonals, in
   the document itself: exact matches. ``proximity`` instead returns documents in
   which a phrase's rarest terms all lie within a span of words, in any order.

Defined results: null texts have no words and match nothing, null or empty items
give no phrases; an item id that occurs in several rows is matched if any of its
rows is; items with null id count as one item, which joined ids leave out; rows
that agree in id and text are one document and get the same result; an empty
corpus gives no rows, an empty benchmark leaves everything clean; other columns
pass through.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CASED_NON_WORD_CLASS, NON_WORD_CLASS, cut, lower_ascii, with_key

WIDTH = 13
BROADCAST_BYTES = 32 << 20


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """The words of an item, an empty array for null."""
    return F.coalesce(F.filter(F.split(lower_ascii(text), NON_WORD_CLASS), lambda w: w != ""), F.array().cast("array<string>"))


def lower_word(word: Column) -> Column:
    """As lower_ascii, at lower's price for words of ASCII alone."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(lower_ascii(word))


def word_count(text: Column) -> Column:
    """Pieces of the split without the empty ones, which stand at the ends alone."""
    pieces = F.split(text, CASED_NON_WORD_CLASS)
    first, last = F.get(pieces, F.lit(0)), F.get(pieces, F.size(pieces) - 1)
    empty = (first == "").cast("int") + ((last == "") & (F.size(pieces) > 1)).cast("int")
    return F.coalesce(F.size(pieces) - empty, F.lit(0)).cast("long")


def places(text: str) -> list[str]:
    """The pieces that Spark's split gives, lower-cased: all words, and empty pieces at the ends."""
    return re.split(NON_WORD_CLASS, text.translate(_LOWER))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words) of the rows that have words; ``item`` names the row's words, not its place."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return rows.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item", "item_id"])


def phrase_terms(items: DataFrame, frequencies: DataFrame, width: int, rarest: int) -> DataFrame:
    """(item, start, length, offset, term): the ``rarest`` words of each phrase at their first offset."""
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("start")
    phrases = items.select("item", "words", start).select("item", "start", F.slice("words", F.col("start") + 1, width).alias("phrase"))
    words = phrases.select("item", "start", F.size("phrase").alias("length"), F.posexplode("phrase").alias("at", "term"))
    words = words.groupBy("item", "start", "length", "term").agg(F.min("at").alias("at"))
    ranked = words.join(frequencies, "term", "left").withColumn("r", F.row_number().over(W.partitionBy("item", "start").orderBy(F.coalesce("n", F.lit(0)), "term")))
    return ranked.filter(F.col("r") <= rarest).select("item", "start", "length", (F.col("start") + F.col("at")).alias("offset"), "term")


def sized(terms: DataFrame) -> DataFrame:
    """The terms, to be broadcast if they take ``BROADCAST_BYTES`` at most; else the join shuffles."""
    taken = terms.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    return F.broadcast(terms) if taken <= BROADCAST_BYTES else terms


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the terms occurs in the whole corpus."""
    tokens = docs.select(F.explode(F.split("text", CASED_NON_WORD_CLASS)).alias("word")).select(lower_word(F.col("word")).alias("term"))
    return tokens.join(sized(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def posting_lists(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, doc_id, _k, positions), one row for each index term of a document."""
    tokens = keyed.select("doc_id", "_k", F.posexplode(F.split("text", CASED_NON_WORD_CLASS)).alias("pos", "word"))
    tokens = tokens.select("doc_id", "_k", "pos", lower_word(F.col("word")).alias("term"))
    return tokens.join(sized(terms), "term").groupBy("term", "doc_id", "_k").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def diagonals(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, _k, item, delta) where the posting lists of an item's index terms meet."""
    offsets = anchors.groupBy("term", "item").agg(F.collect_set("offset").alias("offsets"))
    met = index.join(offsets, "term").select("doc_id", "_k", "item", F.explode(F.flatten(F.transform("positions", lambda p: F.transform("offsets", lambda o: p - o)))).alias("delta"))
    return met.groupBy("doc_id", "_k", "item", "delta").agg(F.count("*").alias("terms"))


def _matches(width: int):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, key, text, many in zip(batch["doc_id"], batch["_k"], batch["text"], batch["lines"]):
                numbers = {w: i for i, w in enumerate({w for line in many for w in line["words"]})}
                words = np.fromiter((numbers.get(w, -1) for w in places(text)), np.int64)
                hit, found = np.zeros(len(words), bool), set()
                for line in many:
                    item, delta, n = np.fromiter((numbers[w] for w in line["words"]), np.int64), line["delta"], len(line["words"])
                    need = min(width, n)
                    low, high = max(0, -delta), min(n, len(words) - delta)
                    if high - low < need:
                        continue
                    same = words[low + delta : high + delta] == item[low:high]
                    sums = np.concatenate(([0], np.cumsum(same)))
                    whole = np.flatnonzero(sums[need:] - sums[:-need] == need)
                    for s in whole:
                        hit[low + delta + s : low + delta + s + need] = True
                    if len(whole):
                        found.add(line["item_id"])
                if found:
                    out.append((doc_id, key, int(hit.sum()), sorted(found - {None}) + [None] * (None in found)))
            yield pd.DataFrame(out, columns=["doc_id", "_k", "n_hit", "item_ids"])

    return match


def exact_matches(keyed: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, _k, n_hit, item_ids): words covered by any phrase, and the items with one."""
    items = cut(item_words(benchmark))
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    anchors = cut(phrase_terms(items, term_frequencies(keyed, cut(vocabulary)), width, 2))
    index = cut(posting_lists(keyed, cut(anchors.select("term").distinct())))
    needed = anchors.groupBy("item", "start").agg(F.count("*").alias("n")).groupBy("item").agg(F.min("n").alias("needed"))
    lines = diagonals(index, anchors).join(needed, "item").filter("terms >= needed").join(items.select("item", F.col("item_id").cast("string").alias("item_id"), "words"), "item")
    by_document = lines.groupBy("doc_id", "_k").agg(F.collect_list(F.struct("item_id", "words", "delta")).alias("lines"))
    by_document = by_document.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_k2"), "lines")
    texts = keyed.select("doc_id", "_k", "text").join(by_document, (F.col("_k") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    texts = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "_k", "text", "lines")
    found = texts.mapInPandas(_matches(width), "doc_id string, _k long, n_hit long, item_ids array<string>")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind)).dropDuplicates(["doc_id", "_k"])


def proximity(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, terms: int = 3, span: int = 2 * WIDTH) -> DataFrame:
    """(doc_id, item_id, start): a phrase's ``terms`` rarest words all within ``span`` words, in any order.

    Read from the posting lists alone: the list of the rarest term leads, and
    every other list must have a position within the span around it.
    """
    keyed = with_key(docs)
    items = cut(item_words(benchmark))
    vocabulary = cut(items.select(F.explode("words").alias("term")).distinct())
    rare = cut(phrase_terms(items, term_frequencies(keyed, vocabulary), width, terms))
    index = cut(posting_lists(keyed, cut(rare.select("term").distinct())))
    lists = rare.select("item", "start", "term").join(index, "term").groupBy("item", "start", "doc_id", "_k").agg(F.collect_list(F.struct(F.size("positions").alias("n"), "term", "positions")).alias("lists"))
    wanted = rare.groupBy("item", "start").agg(F.countDistinct("term").alias("wanted"))
    lists = lists.join(wanted, ["item", "start"]).filter(F.size("lists") == F.col("wanted")).withColumn("lists", F.array_sort("lists"))
    lead = F.element_at("lists", 1)["positions"]
    # A span that begins at one position of any list; the lead list's positions bound where it can begin.
    begins = F.array_distinct(F.flatten(F.transform("lists", lambda x: F.filter(x["positions"], lambda p: F.exists(lead, lambda q: (q >= p) & (q < p + span))))))
    near = F.exists(begins, lambda p: F.forall("lists", lambda x: F.exists(x["positions"], lambda q: (q >= p) & (q < p + span))))
    return lists.filter(near).join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "start").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_share: float = 0.05) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, n_items, item_ids, contaminated.

    A document is contaminated if it has a hit word and hit words make up
    ``least_share`` of its words at least.
    """
    made = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    own = [c for c in docs.columns if c not in made]
    # columns of the operator's own names are kept aside under others
    aside = {c: f"_own_{i}" for i, c in enumerate(own) if c not in ("doc_id", "text")}
    keyed = with_key(docs.select(*own).withColumnsRenamed(aside))
    found = exact_matches(keyed, benchmark, width).select(F.col("doc_id").alias("_d"), F.col("_k").alias("_k2"), F.col("n_hit").alias("_hit"), F.col("item_ids").alias("_ids"))
    counted = keyed.select(*[aside.get(c, c) for c in own], "_k", word_count(F.col("text")).alias("n_words"))
    joined = counted.join(found, (F.col("_k") == F.col("_k2")) & counted["doc_id"].eqNullSafe(F.col("_d")), "left")
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    bad = (n_hit > 0) & (n_hit * round(1 / least_share) >= F.col("n_words"))
    return joined.select(*[F.col(aside.get(c, c)).alias(c) for c in own], "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), bad.alias("contaminated"))


DECONTAMINATION_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {documents}),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT item_id, len(w[s + 1 : s + 13]) AS n, array_to_string(w[s + 1 : s + 13], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM phrases),
spans AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS s, w FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, s, h.n, item_id FROM (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS p FROM spans) h JOIN phrases USING (n, p)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id),
judged AS (
  SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
         coalesce(joined, '') AS joined, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
  FROM dw d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id))
"""
