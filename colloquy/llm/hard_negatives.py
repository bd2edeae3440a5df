"""Hard negatives by a pivot table.

A row's vector gets one more component, so that all rows have the same length M
and a larger inner product with an anchor (whose further component is zero) is a
smaller Euclidean distance: d^2 = M^2 + |anchor|^2 - 2 * score. The distances to
a few pivots are stored with every row. By the triangle inequality they bracket
a row's distance to an anchor, and so its score, without its vector. Only rows
whose bracket reaches what is asked for are scored, exactly, in integers:

* positives: rows of the anchor's label whose upper bound reaches the k-th best
  score among the rows with the best bounds;
* negatives: rows of other labels whose bracket meets a positive's band and
  whose upper bound reaches the band's k-th best score so far.

Rows are dealt out by hash in shards and anchors in blocks; a task holds one
shard and one block and sends on what may still be asked for, the first of its
own shard. So a hot label or a hot vector is spread like everything else, and
neither a label's rows nor all anchors are ever in one place.

Defined results: rows without an id or a label and vectors that are null or hold
null or non-finite components take no part; of rows with one id the smallest
vector and label counts; a shorter vector goes on with zeros, so an empty one
scores 0; equal scores go to the smaller id; an anchor without a positive, or a
positive without a negative in its band, gives no row, and neither does an empty
table; other columns are not read. Scores beyond 64 bits are outside the contract.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Rounding of double distances moves a bound by less than this share of M^2.
SLACK = 1e-9
#: Inner products below this are exact in doubles.
EXACT = 2.0**52


def integer_vectors(vectors: DataFrame, label: Column, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, label, x): one valid row of each id, components floor(256 * x)."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # doubles, in which whole numbers stay whole
    rows = rows.filter(finite).select("vec_id", "label", F.transform("v", lambda c: F.floor(c * 256).cast("double")).alias("x"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("r")).select("vec_id", "r.label", "r.x")


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def far_apart(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows, each the farthest from those chosen before; fewer if the sample has no more different rows."""
    chosen = [0]
    d = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < k and d.max() > 0:
        chosen.append(int(np.argmax(d)))
        d = np.minimum(d, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class PivotTable:
    """Pivots in the augmented space, where every row has length ``m``."""

    def __init__(self, pivots: np.ndarray, m2: float):
        self.m2 = m2
        self.pivots = np.concatenate((pivots, np.sqrt(np.maximum(m2 - (pivots**2).sum(axis=1), 0))[:, None]), axis=1)

    def distances(self, vectors: list, anchors: bool = False) -> np.ndarray:
        """Distances of rows, or of anchors, to the pivots."""
        width = max([self.pivots.shape[1] - 1, *map(len, vectors)])
        x = padded(vectors, width)
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.m2 - (x * x).sum(axis=1), 0))
        p = np.zeros((len(self.pivots), width))
        p[:, : self.pivots.shape[1] - 1] = self.pivots[:, :-1]
        d2 = (x * x).sum(axis=1)[:, None] + (last**2)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * (x @ p.T + np.outer(last, self.pivots[:, -1]))
        return np.sqrt(np.maximum(d2, 0))

    def bracket(self, square: float, anchor: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of rows with an anchor of this squared length, by their stored distances."""
        near, far = np.abs(rows - anchor).max(axis=1), (rows + anchor).min(axis=1)
        slack = SLACK * (self.m2 + square) + 1e-6
        # the root of a rounded d^2 near zero is off by more than d^2 itself
        off = 2 * np.sqrt(slack)
        return (self.m2 + square - (far + off) ** 2) / 2 - slack, (self.m2 + square - np.maximum(near - off, 0) ** 2) / 2 + slack


class Scores:
    """Exact inner products of one anchor with some rows of a shard."""

    def __init__(self, anchor: np.ndarray, rows: np.ndarray):
        bound = float(np.abs(anchor).max(initial=0) * np.abs(rows).max(initial=0) * max(rows.shape[1], 1))
        kind = np.float64 if bound < EXACT else np.int64
        self.anchor, self.rows = anchor.astype(kind), rows.astype(kind)

    def of(self, at: np.ndarray) -> np.ndarray:
        return (self.rows[at] @ self.anchor).astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _best_of_label(q: pd.DataFrame, p: pd.DataFrame, table: PivotTable, k: int, seeds: int) -> list[tuple[int, int, int]]:
    """(anchor, row, score): each anchor's first k other rows of its label in this shard."""
    made, (x, near, ids, labels) = [], _arrays(q, p)
    for anchor, label, v, d in zip(q["vec_id"], q["label"], q["x"], q["d"]):
        own = np.flatnonzero((labels == label) & (ids != anchor))
        if not len(own):
            continue
        a = padded([v], x.shape[1])[0]
        scores, upper = Scores(a, x), table.bracket(float(a @ a), np.asarray(d), near[own])[1]
        if len(own) > seeds:
            seed = own[np.argpartition(-upper, seeds)[:seeds]]
            found = scores.of(seed)
            if len(found) > k:
                own = own[upper >= np.partition(found, -k)[-k]]
        found = scores.of(own)
        for i in _first(found, ids[own], k):
            made.append((anchor, int(ids[own[i]]), int(found[i])))
    return made


def _best_in_bands(q: pd.DataFrame, p: pd.DataFrame, table: PivotTable, k: int, low: int, high: int, seeds: int) -> list[tuple[int, int, int, int]]:
    """(anchor, positive, row, score): the first k rows of other labels in each positive's band in this shard."""
    made, (x, near, ids, labels) = [], _arrays(q, p)
    for anchor, label, v, d, positives in zip(q["vec_id"], q["label"], q["x"], q["d"], q["positives"]):
        other = np.flatnonzero((labels != label) & (ids != anchor))
        if not len(other):
            continue
        a = padded([v], x.shape[1])[0]
        scores = Scores(a, x)
        least, upper = table.bracket(float(a @ a), np.asarray(d), near[other])
        known, seen = np.zeros(len(other), np.int64), np.zeros(len(other), bool)
        for positive in positives:
            score = int(positive["score"])
            if low * score > high * score:
                continue
            meets = (100 * upper >= low * score) & (100 * least <= high * score)
            for stage in range(2):
                new = np.flatnonzero(meets & ~seen)
                if stage == 0 and len(new) > seeds:
                    new = new[np.argpartition(-upper[new], seeds)[:seeds]]
                known[new], seen[new] = scores.of(other[new]), True
                inside = np.flatnonzero(seen & (low * score <= 100 * known) & (100 * known <= high * score))
                best = inside[_first(known[inside], ids[other[inside]], k)]
                if len(best) == k:  # below the k-th nothing counts
                    meets &= upper >= known[best[-1]]
            for i in best:
                made.append((anchor, int(positive["vec_id"]), int(ids[other[i]]), int(known[i])))
    return made


def _arrays(q: pd.DataFrame, p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    width = max([0, *map(len, p["x"]), *map(len, q["x"])])
    return padded(list(p["x"]), width), np.stack([np.asarray(d) for d in p["d"]]) if len(p) else np.zeros((0, 1)), p["vec_id"].to_numpy(), p["label"].to_numpy()


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = 16, sample: int = 2000, shards: int = 16, shard_rows: int = 65_536, block_rows: int = 2048, seeds: int = 64) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row that ``is_anchor`` (over vec_id).

    A negative of a positive scores ``low`` to ``high`` per cent of it. Pivots are
    chosen from the ``sample`` rows of the smallest hashes; all rows are searched,
    in ``shards`` shards, or more where these would hold over ``shard_rows``.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = cut(integer_vectors(vectors, F.col("label") if label is None else label, vec_id, embedding))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    n, m2 = rows.agg(F.count("*"), F.max(square)).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    chosen = [r["x"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").collect()]
    table = PivotTable(far_apart(padded(chosen, max(map(len, chosen))), pivots), float(m2))

    @F.pandas_udf("array<double>")
    def stored(x: pd.Series) -> pd.Series:
        return pd.Series(list(table.distances(list(x))))

    @F.pandas_udf("array<double>")
    def asked(x: pd.Series) -> pd.Series:
        return pd.Series(list(table.distances(list(x), anchors=True)))

    spread = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")
    upto = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    anchors = rows.filter(is_anchor)
    shards, blocks = max(min(shards, n // 256), -(-n // shard_rows)), max(-(-anchors.count() // block_rows), 1)
    pivoted = cut(rows.withColumn("d", stored("x"))).select("*", spread(shards).alias("shard"), upto(blocks).alias("block"))
    anchors = cut(anchors.withColumn("d", asked("x")))
    dealt = lambda q: q.toDF(*q.columns).select("*", upto(shards).alias("shard"), spread(blocks).alias("block"))
    met = lambda q, p, schema: lambda made: q.groupBy("shard", "block").cogroup(p.groupBy("shard", "block")).applyInPandas(made, schema)

    def best_of_label(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        made = _best_of_label(q, p, table, positives, seeds) if len(q) and len(p) else []
        return pd.DataFrame(made, columns=["anchor", "vec_id", "score"], dtype="int64")

    def best_in_bands(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        made = _best_in_bands(q, p, table, negatives, low, high, seeds) if len(q) and len(p) else []
        return pd.DataFrame(made, columns=["anchor", "positive", "vec_id", "score"], dtype="int64")

    near = met(dealt(anchors), pivoted, "anchor long, vec_id long, score long")(best_of_label)
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("place", place).filter(F.col("place") <= positives).drop("place")
    near = cut(near.groupBy("anchor").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives")))
    wanted = anchors.join(near.withColumnRenamed("anchor", "vec_id"), "vec_id")
    found = met(dealt(wanted), pivoted, "anchor long, positive long, vec_id long, score long")(best_in_bands)
    rank = F.row_number().over(W.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    paired = near.select("anchor", F.explode("positives").alias("p")).select("anchor", F.col("p.vec_id").alias("positive"), F.col("p.score").alias("positive_score"))
    done = found.join(paired, ["anchor", "positive"])
    return done.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


HARD_NEGATIVES_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= 10"""
