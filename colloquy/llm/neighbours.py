"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced k-means on a bounded sample (``sample`` vectors, or
eight for each list, those with the smallest hashes). There is a list for every
``list_size`` vectors up to ``LISTS`` lists, beyond that as many as the root of
the number of vectors, so a query's work grows with that root. Every vector goes to its
nearest centroid's posting list, and boundary vectors also to others at most
``1 + spread`` times as far, ``replicas`` at most. Centroids are searched by
best-first search on their neighbour graph, in memory. A query reads the lists
whose centroid is at most ``1 + reach`` times as far as the nearest one; nothing
else limits how many: a search whose whole beam is that near is made again with
a wider one. Lists longer than ``list_limit`` are dealt out in shards, and so are
the queries that read one.

Equal vectors are one entry that carries its ``k + 1`` smallest ids: by the tie
rule no other of them can be an answer. So neither a hot vector nor the queries
that share it multiply the work.

Defined results: vectors that are null, empty, zero, of another length than the
most common one, or that hold null or non-finite components take no part, nor do
rows without id; of rows with one id the smallest vector counts; ties go to the
smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Up to so many lists their number is in proportion to the vectors.
LISTS = 2048
#: So many vectors are compared with all centroids at once.
BLOCK = 512


def unit(v: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that very small and very large vectors keep their direction
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def balanced_centroids(vectors: np.ndarray, k: int, rounds: int = 12, weight: float = 0.02) -> np.ndarray:
    """k-means on the sphere; a list above its share of the sample gets farther from round to round."""
    rng = np.random.default_rng(7)
    c = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    penalty = np.zeros(len(c))
    for _ in range(rounds):
        own = np.concatenate([np.argmax(vectors[i : i + BLOCK] @ c.T - penalty, axis=1) for i in range(0, len(vectors), BLOCK)])
        sizes = np.bincount(own, minlength=len(c))
        penalty = np.clip(penalty + weight * (sizes * len(c) / len(vectors) - 1), 0, 0.5)
        sums = np.zeros_like(c)
        np.add.at(sums, own, vectors)
        empty = sizes == 0
        sums[empty] = vectors[rng.choice(len(vectors), int(empty.sum()))]
        c = unit(sums + 1e-12)
    return c


class CentroidGraph:
    """Each centroid's nearest centroids, and best-first search along them."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, entries: int = 16):
        self.c, n = centroids, len(centroids)
        degree = min(degree, n - 1)
        self.links = np.empty((n, degree), np.int64)
        for start in range(0, n, BLOCK):
            near = centroids[start : start + BLOCK] @ centroids.T
            near[np.arange(len(near)), np.arange(start, start + len(near))] = -2
            self.links[start : start + BLOCK] = np.argsort(-near, axis=1)[:, :degree]
        self.entries = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(int))

    def search(self, v: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of about the ``beam`` nearest centroids of each row, nearest first; -2 for none."""
        n, beam = len(v), min(beam, len(self.c))
        ids, cosines, opened = np.zeros((n, beam), np.int64), np.full((n, beam), -2.0), np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.c)), bool)

        def put(rows: np.ndarray, links: np.ndarray) -> None:
            """The nearest of what the rows hold and of these centroids stay."""
            found = np.einsum("nd,nkd->nk", v[rows], self.c[links])
            found[seen[rows[:, None], links]] = -2
            seen[rows[:, None], links] = True
            all_cosines = np.concatenate((cosines[rows], found), axis=1)
            best = np.argsort(-all_cosines, axis=1, kind="stable")[:, :beam]
            ids[rows] = np.take_along_axis(np.concatenate((ids[rows], links), axis=1), best, axis=1)
            opened[rows] = np.take_along_axis(np.concatenate((opened[rows], np.zeros(links.shape, bool)), axis=1), best, axis=1)
            cosines[rows] = np.take_along_axis(all_cosines, best, axis=1)

        active = np.arange(n)
        put(active, np.broadcast_to(self.entries, (n, len(self.entries))))
        while len(active):
            left = np.where(opened[active], -2.0, cosines[active])
            at = np.argmax(left, axis=1)
            going = left[np.arange(len(active)), at] > -2
            active, at = active[going], at[going]
            opened[active, at] = True
            if len(active) and self.links.shape[1]:
                put(active, self.links[ids[active, at]])
        return ids, cosines


def _distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def routes(graph: CentroidGraph, v: np.ndarray, ratio: float, most: int | None, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists within the distance ratio of each row's nearest, the ``most`` nearest of them."""
    out_row, out_list = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at_once = max(1, min(1000, 20_000_000 // len(graph.c)))
    waiting = [(np.arange(start, min(start + at_once, len(v))), beam) for start in range(0, len(v), at_once)]
    while waiting:
        rows, wide = waiting.pop()
        ids, cosines = graph.search(v[rows], wide)
        d = _distances(cosines)
        take = (d <= (1 + ratio) * d[:, :1] + 1e-12) & (cosines > -2)
        take[:, 0] = True
        if most is not None:
            take[:, most:] = False
        elif wide < len(graph.c):
            full = take.all(axis=1)
            if full.any():  # there may be more as near
                waiting.append((rows[full], 2 * wide))
            rows, ids, take = rows[~full], ids[~full], take[~full]
        r, j = np.nonzero(take)
        out_row.append(rows[r])
        out_list.append(ids[r, j])
    return np.concatenate(out_row), np.concatenate(out_list)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): one valid vector of each id."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["n"] if lengths else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each different vector once, with the smallest k + 1 ids that have it."""
    r = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("r", r).filter(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", *, list_size: int = 256, sample: int = 20_000, replicas: int = 4, spread: float = 0.08, reach: float = 0.25, beam: int = 256, list_limit: int = 2048, query_limit: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` (over vec_id)."""
    rows = cut(usable(vectors, vec_id, embedding))
    entries = cut(entries_of(rows, k))
    n = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    n_lists = int(np.clip(n // list_size, 1, max(LISTS, n**0.5)))
    chosen = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(max(sample, 8 * n_lists)).toPandas()
    centroids = balanced_centroids(unit(np.stack(chosen["v"])), n_lists)
    graph = CentroidGraph(centroids)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                r, lists = routes(graph, unit(np.stack(batch["v"])), spread, replicas, 16)
                yield batch.iloc[r].assign(list=lists.astype("int32"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                r, lists = routes(graph, unit(np.stack(batch["v"])), reach, None, beam)
                yield batch.iloc[r].assign(list=lists.astype("int32"))

    posted = cut(entries.mapInPandas(post, "v array<double>, ids array<long>, list int"))
    shards = cut(posted.groupBy("list").agg(F.ceil(F.count("*") / list_limit).cast("int").alias("shards")))
    shard = F.pmod(F.xxhash64("v"), F.col("of")).cast("int")
    queries = rows.filter(is_query)
    asked = cut(queries.groupBy("v").agg(F.min("vec_id").alias("asked")))
    wanted = cut(asked.mapInPandas(route, "v array<double>, asked long, list int"))
    readers = wanted.groupBy("list").agg(F.ceil(F.count("*") / query_limit).cast("int").alias("readers"))
    parts = cut(shards.join(readers, "list"))
    shard, reader = F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"), F.pmod(F.xxhash64("v"), F.col("readers")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posted = posted.join(parts, "list").select("v", "ids", "list", shard.alias("shard"), upto("readers").alias("reader"))
    wanted = wanted.join(parts, "list").select("v", "asked", "list", upto("shards").alias("shard"), reader.alias("reader"))

    def score(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        made = [np.empty(0, int), np.empty(0, int), np.empty(0)]
        if len(q) and len(p):
            a, b, found = unit(np.stack(q["v"])), unit(np.stack(p["v"])), []
            for start in range(0, len(a), 512):
                s = a[start : start + 512] @ b.T
                # each query's k + 1 nearest entries of this shard, and what ties with the last of them
                last = -np.partition(-s, k, axis=1)[:, k : k + 1] if s.shape[1] > k + 1 else np.full((len(s), 1), -2.0)
                i, j = np.nonzero(s >= last - 1e-9)
                found.append((i + start, j, np.clip(np.einsum("nd,nd->n", a[i + start], b[j]), -1, 1)))
            made = [np.concatenate(x) for x in zip(*found)]
        i, j, cosines = made
        return pd.DataFrame({"asked": q["asked"].to_numpy()[i], "ids": p["ids"].to_numpy()[j], "score": cosines})

    found = wanted.groupBy("list", "shard", "reader").cogroup(posted.groupBy("list", "shard", "reader")).applyInPandas(score, "asked long, ids array<long>, score double")
    # an entry that several lists hold is found several times
    found = found.groupBy("asked", F.get("ids", F.lit(0)).alias("entry")).agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    found = found.select("asked", F.explode("ids").alias("vec_id"), "score")
    best = W.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    pairs = queries.select(F.col("vec_id").alias("query_id"), "v").join(asked.toDF("v", "asked"), "v").drop("v").join(found, "asked").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
