"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 36-bit hash of its id and text. A source whose target is
``t`` words and whose size is ``s`` words is taken ``floor(t / s)`` times in
full; of the rest, the documents with a hash below the source's threshold are
taken once more. The threshold is found without sorting documents: a histogram
of words by the hash's first 12 bits, then of the next 12 bits within the
boundary bucket alone, then of the last 12. Thresholds of growing budgets nest.

Defined results: a null text has size 0 and takes 0 words; null is a source of
its own and ranks last; rows that agree in id and text share a hash and are
taken alike; an empty table gives no rows; other columns are not read.
The table of sources (one row each) is a dimension and is ranked by one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SIZE_PATTERN = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
LEVELS = 3
#: Up to so many sources their thresholds are broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def word_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """36 bits, uniform, the same in every run."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Targets of all sources: shares by weight, none above ``most`` times its size."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    # Fill sources in the order in which they reach their cap; the level is the first that the next source does not reach.
    order = W.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    total, weight_sum = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    full, full_weight = F.coalesce(F.sum("source_size").over(below), F.lit(0)), F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    levelled = ranked.select("*", ((total - full * most) / (weight_sum - full_weight)).alias("level"))
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * most
    levelled = levelled.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("source_size") * most / F.col("weight"))).over(everything))
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    out = levelled.select("source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return out.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def hash_thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """Adds to each source's row (``rest``: its budget) the ``threshold`` whose documents come nearest to it."""
    found = budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before"))
    by_source = W.partitionBy("source")
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        near = found.alias("f").join(sizes.alias("d"), F.col("f.source").eqNullSafe(F.col("d.source")) & (F.shiftright("d.h", shift + LEVEL_BITS) == F.col("f.prefix")))
        cells = near.groupBy("f.source", "f.rest", "f.before", F.shiftright("d.h", shift).alias("cell")).agg(F.sum("d.size").alias("mass"))
        upto = F.col("before") + F.sum("mass").over(by_source.orderBy("cell"))
        crossed = cells.withColumn("upto", upto).filter("upto > rest")
        found = crossed.groupBy("source", "rest").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("mass")).alias("before"), "upto"), "cell").alias("b")).select("source", "rest", F.col("b.cell").alias("prefix"), F.col("b.before").alias("before"), F.col("b.upto").alias("upto"))
        found = cut(found)
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("before"))
    return found.select("source", (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` of every document.

    ``weights`` repeat over the sources in code-point order, null last. No
    document is taken more than ``most`` times.
    """
    kept = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    measured = [F.col("source"), word_size(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("h")]
    narrow = "text" not in keep
    # the thresholds are found on a narrow table; texts that are kept are not written but read once more
    sizes = cut(docs.select(*(kept if narrow else []), *measured))
    targets = cut(source_targets(sizes, weights, most))
    edges = hash_thresholds(sizes, targets)
    plan = targets.join(edges.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    plan = F.broadcast(plan) if targets.count() <= BROADCAST_SOURCES else plan
    dealt = (sizes if narrow else docs.select(*kept, *measured)).join(plan, F.col("source").eqNullSafe(F.col("_s")), "left")
    copies = F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")
    named = [F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)]
    return dealt.select(*named, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: The same rows in DuckDB: one cumulative sum over all hash prefixes stands for the three levels.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 9))::BIGINT AS h
  FROM {documents}),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(source_size) OVER below, 0)::DOUBLE * 3)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS lvl,
         source_size::DOUBLE * 3 / weight AS ratio
  FROM ranked WINDOW below AS (ORDER BY source_size::DOUBLE * 3 / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(min_by(lvl, ratio), 0) AS lvl FROM filled WHERE lvl * weight <= source_size::DOUBLE * 3),
targets AS (SELECT source, source_size, least(source_size::DOUBLE * 3, l.lvl * weight) AS target FROM filled, level l),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
                target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM targets),
cells AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::DOUBLE AS upto, sum(size)::DOUBLE AS mass FROM sized GROUP BY source, h),
taken AS (
  SELECT c.source, c.h, (c.upto <= p.rest OR (c.upto - c.mass <= p.rest AND c.upto - p.rest < p.rest - (c.upto - c.mass))) AS once_more
  FROM cells c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source)
SELECT s.doc_id, s.size, p.source_size, p.target, ((p.whole + t.once_more::INT) * s.size)::BIGINT AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.h = t.h
"""
