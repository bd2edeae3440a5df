"""Interaction of filters: what each removes in every order, alone, and by its Shapley value.

Every document gets a mask of the filters it fails, and only the counts of masks
by part go on: a third of all rows in one part, or one text copied a third of
the rows, is a few counts for each task. From a part's counts comes its removal
polynomial, the multilinear extension of the number of documents that a set of
filters removes. Its value at a corner is what that set removes, so corners give
the survivors of any order's first steps; the integral of its partial derivative
along the diagonal, in exact rationals, is the filter's Shapley value, and 120
times that is what the filter removes summed over all orders.

Filters (words are maximal runs without white space, case-sensitive):

* A: fewer than 50 words;
* B: fewer than 65 % of the words differ;
* C: more than 5 % of the characters are A-Z;
* D: holds any of ``#$%&*|``;
* E: the text is that of a document with a smaller id, in any part, removed or not.

Defined results: a null text is empty, a null part is the empty string; a null
id is neither smaller than another nor larger, and has no labels; rows that
agree in id and text count each, none of them as the other's copy; an id
labelled more than once is good or toxic if any label says so; an empty table
gives no rows; other columns are not read. Equal texts are those of equal
SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D a text, never null, fails."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = F.struct(F.size(words).alias("all"), F.size(F.array_distinct(words)).alias("different"))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bit = lambda fails, i: F.when(fails, 1 << i).otherwise(0)
    by_words = F.element_at(F.transform(F.array(n), lambda x: bit(x["all"] < 50, 0) + bit(100 * x["different"] < 65 * x["all"], 1)), 1)
    return by_words + bit(100 * upper > 5 * F.length(text), 2) + bit(F.regexp_like(text, F.lit(r"[#$%&*|]")), 3)


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # what goes on is some 60 bytes a document
    rows = rows.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    any_of = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(any_of("quality"), any_of("toxic"))
    rows = rows.join(known, "doc_id", "left").fillna(0, ["quality", "toxic"])
    # by text and id, so that one text's copies are spread; each row of the least id is no copy
    ids = rows.groupBy("digest", "doc_id", "part", "mask", "quality", "toxic").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    ids = ids.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return ids.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).cast("int").alias("mask")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


class RemovalPolynomial:
    """R(x) = sum over masks of n * (1 - product of (1 - x_i) over the mask), by its coefficients of products of x_i."""

    def __init__(self, counts: dict[int, int], filters: int = len(FILTERS)):
        self.filters = filters
        self.total = sum(counts.values())
        self.coefficients: dict[int, int] = {}
        for product in range(1, 1 << filters):
            held = sum(n for mask, n in counts.items() if mask & product == product)
            if held:
                self.coefficients[product] = held if product.bit_count() % 2 else -held

    def corner(self, chosen: int) -> int:
        """How many documents this set of filters removes."""
        return sum(c for product, c in self.coefficients.items() if product & chosen == product)

    def shapley(self, i: int) -> Fraction:
        """The integral of the partial derivative by x_i along the diagonal from 0 to 1."""
        return sum((Fraction(c, product.bit_count()) for product, c in self.coefficients.items() if product >> i & 1), Fraction(0))


def audit_part(part: str, counts: dict[int, tuple[int, int, int]]) -> Iterator[tuple]:
    """The rows of one part from (n, good, toxic) by mask."""
    all_rows, good, toxic = (RemovalPolynomial({mask: c[i] for mask, c in counts.items()}) for i in range(3))
    k = len(FILTERS)
    every = (1 << k) - 1
    corners = [[p.corner(chosen) for chosen in range(1 << k)] for p in (all_rows, good, toxic)]
    fails = [corners[0][1 << i] for i in range(k)]
    alone = [corners[0][every] - corners[0][every ^ 1 << i] for i in range(k)]
    summed = [factorial(k) * all_rows.shapley(i) for i in range(k)]
    if any(s.denominator != 1 for s in summed):
        raise ArithmeticError("a Shapley value times the number of orders is whole")
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good_lost, toxic_lost = (c[after] - c[before] for c in corners)
            yield part, "".join(FILTERS[j] for j in order), step, all_rows.total - corners[0][after], removed, fails[i] - removed, alone[i], good_lost, toxic_lost, int(summed[i])
            before = after


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step; at most 32 counts of a part are in one place."""
    counts = mask_counts(docs, labels, part)
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OUT.split(", ")]
        for batch in batches:
            for name, counted in zip(batch["part"], batch["counts"]):
                yield pd.DataFrame(audit_part(name, {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counted}), columns=names)

    return by_part.mapInPandas(audit, OUT)


AUDIT_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS done UNION ALL SELECT done || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(done, c)),
s AS (SELECT done AS filter_order, step, done[step] AS own, done[:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(done) = 5),
r AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN translate(failed, before || own, '') = failed THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') <> failed THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
