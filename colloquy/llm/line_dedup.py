"""Line deduplication over overlapping windows of three lines.

Texts are cut at line feeds. Every three consecutive lines are a window, named
by two 64-bit hashes. A window that occurs more than once in the whole table is
kept where it comes first (by doc_id, then key, then position; null ids first);
every line that any later occurrence covers is removed. Overlapping and adjacent
covered positions merge by set difference over line numbers.

Defined results: null text gives null text and no lines; an empty text is one
empty line; texts of fewer than three lines have no window and stay whole;
windows of blank lines alone are no windows; rows that agree in id and text are
one document, so each of them keeps what the document keeps (its lines are not
later occurrences of themselves); other columns are passed through
(``n_lines`` and ``n_removed`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_key

WINDOW = 3
NOT_BLANK = r"[^\x09-\x0D\x20]"


def windows(keyed: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, _k, pos) of every window."""
    lines = keyed.filter(F.contains("text", F.lit("\n"))).select("doc_id", "_k", F.split("text", "\n", -1).alias("lines"))
    lines = lines.filter(F.size("lines") >= WINDOW)

    def window(i):
        parts = [F.get("lines", i + j) for j in range(WINDOW)]
        return F.struct(i.alias("pos"), F.xxhash64(*parts).alias("w1"), F.xxhash64(F.lit("2"), *reversed(parts)).alias("w2"), F.regexp_like(F.concat(*parts), F.lit(NOT_BLANK)).alias("real"))

    made = F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), window)
    return lines.select("doc_id", "_k", F.inline(made)).filter("real").drop("real")


def later_positions(keyed: DataFrame) -> DataFrame:
    """(doc_id, _k, later): the start positions of windows that came before."""
    all_windows = windows(keyed)
    firsts = all_windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_k", "pos")).alias("first")).filter("n > 1").drop("n")
    firsts = cut(firsts)  # small beside the windows; with its own exchange, skewed windows can be split
    later = all_windows.join(firsts, ["w1", "w2"]).filter(~F.struct("doc_id", "_k", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "_k").agg(F.collect_set("pos").alias("later"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the shortened ``text``, and ``n_lines``, ``n_removed``."""
    own = docs.columns
    # columns of the operator's own names are kept aside under others
    aside = {c: f"_own_{i}" for i, c in enumerate(own) if c not in ("doc_id", "text")}
    keyed = with_key(docs.withColumnsRenamed(aside))
    later = later_positions(keyed).select(F.col("doc_id").alias("_d"), F.col("_k").alias("_k2"), "later")
    joined = keyed.join(later, (F.col("_k") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    joined = joined.withColumn("_lines", F.split("text", "\n", -1))
    covered = F.flatten(F.transform("later", lambda p: F.sequence(p, p + WINDOW - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered)
    text = F.when(F.col("later").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    n_removed = F.when(F.col("later").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")
    return joined.select(*[text.alias(c) if c == "text" else F.col(aside.get(c, c)).alias(c) for c in own if c not in ("n_lines", "n_removed")], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


LINE_DEDUP_SQL = """
WITH lined AS (SELECT doc_id, k, text, string_split(text, chr(10)) AS lines FROM (SELECT DISTINCT doc_id, text, coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '') AS k FROM {documents})),
win AS (
  SELECT doc_id, k, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS w
  FROM (SELECT doc_id, k, lines, unnest(range(0, len(lines) - 2)) AS pos FROM lined WHERE len(lines) >= 3)),
later AS (
  SELECT k, pos FROM (
    SELECT k, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, k, pos) AS rn FROM win
    WHERE regexp_matches(w, '[^\\x09-\\x0D\\x20]'))
  WHERE rn > 1),
gone AS (SELECT DISTINCT k, pos + j AS pos FROM later, (SELECT unnest(range(0, 3)) AS j)),
parts AS (
  SELECT k, pos, lines[pos + 1] AS line FROM (SELECT k, lines, unnest(range(0, len(lines))) AS pos FROM lined)),
kept AS (
  SELECT p.k, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN p.line END, chr(10) ORDER BY p.pos) AS text
  FROM parts p LEFT JOIN gone g ON p.k = g.k AND p.pos = g.pos GROUP BY p.k)
"""
