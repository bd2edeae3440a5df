"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of ``n``-word shingles (words by the fixed word rule, A-Z
lower-cased; a text of fewer words is one shingle). Texts with equal sets form a
class and go on as one. MinHash values of each class are cut into bands; only
classes that share a band are compared. Classes that bands connect form a cluster,
whose blocks are compared inside tasks, where no pair is ever written out. A pair's
MinHash values are compared ``STEP`` at a time; as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold falls below
``tolerance``, the pair is dropped. Pairs that stay are verified on the exact sets.
Tasks return link counts and the links of a spanning forest, never all pairs.

Clusters that are too large for a task are split into blocks of about
``BLOCK_SHINGLES`` shingles by hash, and each pair of blocks is a task's work of its own.

With 32 bands of 5 values a pair of similarity 0.8 is missed as a candidate with
probability 3e-6, and pruning loses it with at most about 1e-6 a step.

Defined results: null texts and texts without words have no links and are their
own class; rows that agree in id and text are one document and get the same
result (they are not links of one another); an empty table gives no rows; columns
beside doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, cut, orderable, rewritten, with_key

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 5
HASHES = BANDS * BAND_ROWS
STEP = 32
TOLERANCE = 1e-6
#: A block's shingles; each text counts as ROW_SHINGLES more, which bounds its rows too.
BLOCK_SHINGLES, ROW_SHINGLES = 400_000, 100
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_WORD = re.compile(WORD_CLASS)
_rng = np.random.default_rng(11)
_A = _rng.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, np.uint32)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles."""
    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    # a shingle's hash combines its words' hashes in their order
    ids: dict[str, int] = {}
    h = np.fromiter((ids.get(w) or ids.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - n + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(29)))


def minhashes(s: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), 512):
        part = h[None, i : i + 512] * _A[:, None]
        part += _B[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A hash of each band's values, different from band to band: (rows, HASHES) to (rows, BANDS)."""
    values = values.reshape(len(values), BANDS, BAND_ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), BANDS)).copy()
    for i in range(BAND_ROWS):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + values[:, :, i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(compared, least): a pair goes on after so many values only with so many equal.

    With m of c values equal, the posterior of similarity s is Beta(1+m, 1+c-m);
    its mass above t equals P(Binomial(c + 1, t) <= m).
    """
    out = []
    for c in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(c + 1, m) * threshold**m * (1 - threshold) ** (c + 1 - m)
        out.append((c, m))
    return out


SKETCH = "doc_id string, _k long, c1 long, c2 long, n int, bands array<long>, values binary"


def _sketch(n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, n) for text in batch.column("text").to_pylist()]
            some = [len(s) > 0 for s in sets]
            values = np.stack([minhashes(s) for s in sets]) if sets else np.empty((0, HASHES), np.uint32)
            keys = band_keys(values).view(np.int64)
            short = values.astype(np.uint16)
            hashed = [[xxhash.xxh3_64_intdigest(s.tobytes(), seed=seed) if len(s) else 0 for s in sets] for seed in (0, 1)]
            columns = [
                *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in hashed),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([k if has else [] for k, has in zip(keys, some)], pa.list_(pa.int64())),
                pa.array([v.tobytes() if has else b"" for v, has in zip(short, some)], pa.binary()),
            ]
            yield pa.record_batch([batch.column("doc_id"), batch.column("_k"), *columns], names=["doc_id", "_k", "c1", "c2", "n", "bands", "values"])

    return sketch


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is one of its nodes.

    Each round every node joins the least of its neighbours and itself, and links
    go on between what they joined; links that fall together are one. Stars around
    their least node, which most links make, take one round. From the third round
    on the order is drawn anew each time, which leaves a constant share of the
    nodes on average, however long the chains and whatever the hubs.
    """
    edges, levels = rewritten(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), []
    while not edges.isEmpty():

        def place(node: str) -> Column:
            return F.col(node) if len(levels) < 2 else F.struct(F.xxhash64(F.col(node), F.lit(len(levels))).alias("h"), F.col(node).alias("node"))

        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(place("b")).alias("near"))
        least = F.least("near", place("a"))
        joined = rewritten(near.select(F.col("a").alias("node"), (least if len(levels) < 2 else least["node"]).alias("component")))
        ends = [joined.select(F.col("node").alias(end), F.col("component").alias(f"new_{end}")) for end in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").filter("new_a <> new_b")
        edges = rewritten(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct())
        levels.append(joined)
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = levels.pop()
    while levels:
        upper = labels.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        labels = rewritten(levels.pop().join(upper, "component", "left").select("node", F.coalesce("upper", "component").alias("component")))
    return labels


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that share a band with another one.

    A class stands for its bands' buckets by their first classes; it joins the
    least of them, and only the different links between such first classes go on.
    """
    bands = classes.filter("n > 0").select("node", F.explode("bands").alias("value"))
    firsts = cut(bands.groupBy("value").agg(F.min("node").alias("first"), F.count("*").alias("m")).filter("m > 1").select("value", "first"))
    heads = cut(bands.join(firsts, "value").groupBy("node").agg(F.min("first").alias("head"), F.collect_set("first").alias("firsts")))  # BANDS firsts at most
    links = heads.select(F.col("head").alias("a"), F.explode("firsts").alias("b"))
    upper = connected(links).select(F.col("node").alias("head"), "component")
    return cut(heads.select("node", "head").join(upper, "head", "left").select("node", F.coalesce("component", "head").alias("component")))


def _sharing(keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of either list that share a band's key with some place of the other one."""
    l, r = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for band in range(BANDS):
        l |= np.isin(keys[left, band], keys[right, band])
        r |= np.isin(keys[right, band], keys[left, band])
    return left[l], right[r]


class _Sets:
    """Sets of shingles of one block, and what two of them share."""

    #: Entries of the dense table, which stands for the sets where many pairs are asked for.
    DENSE = 32_000_000

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.empty(0, int)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        self.mark = np.zeros(int(self.ids.max(initial=-1)) + 1, bool)
        several = np.bincount(self.ids) > 1  # no other shingle is shared
        self.columns = int(several.sum())
        self.column = np.where(several, np.cumsum(several) - 1, -1)
        self.table: np.ndarray | None = None

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many shingles the pairs (i, j) share; i in order."""
        rows, others = np.unique(i), np.unique(j)
        sparse, dense = self.sizes[j].sum() * 5e-9, len(rows) * len(others) * self.columns * 2e-10
        if dense < sparse and len(self.sizes) * self.columns <= self.DENSE:
            if self.table is None:
                self.table = np.zeros((len(self.sizes), self.columns), np.float32)
                at = self.column[self.ids]
                self.table[np.repeat(np.arange(len(self.sizes)), self.sizes)[at >= 0], at[at >= 0]] = 1
            return (self.table[rows] @ self.table[others].T)[np.searchsorted(rows, i), np.searchsorted(others, j)].astype(np.int64)
        out = [np.empty(0, np.int64)]
        for row in rows:
            with_row = j[i == row]
            own = self.ids[self.bounds[row] : self.bounds[row + 1]]
            self.mark[own] = True
            flat = np.concatenate([self.ids[self.bounds[o] : self.bounds[o + 1]] for o in with_row])
            out.append(np.add.reduceat(self.mark[flat].astype(np.int64), np.concatenate(([0], np.cumsum(self.sizes[with_row])[:-1]))))
            self.mark[own] = False
        return np.concatenate(out)


def _links_within(sets: list[np.ndarray], values: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i, j) between two lists of places that share a band; same: the lists are one."""
    held = _Sets(sets)
    sizes = held.sizes
    # the values are cut to 16 bits, so keys agree where the whole bands do
    keys = band_keys(values)
    if not same:
        left, right = _sharing(keys, left, right)
    out_i, out_j = [np.empty(0, int)], [np.empty(0, int)]
    columns = np.ascontiguousarray(keys[right].T)
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        a = sizes[rows][:, None]
        b = sizes[right][None]
        near = np.zeros((len(rows), len(right)), bool)
        for band in range(BANDS):
            near |= keys[rows, band][:, None] == columns[band][None]
        i, j = np.nonzero(near & (np.minimum(a, b) >= threshold * np.maximum(a, b)) & ((rows[:, None] < right[None]) if same else True))
        i, j = rows[i], right[j]
        matched, done = np.zeros(len(i), np.int32), 0
        for compared, least in steps:
            for at in range(0, len(i), 200_000):
                part = slice(at, at + 200_000)
                matched[part] += (values[i[part], done:compared] == values[j[part], done:compared]).sum(axis=1, dtype=np.int32)
            keep = matched >= least
            i, j, matched, done = i[keep], j[keep], matched[keep], compared
        if len(i):  # the exact sets decide
            shared = held.shared(i, j)
            hit = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
            out_i.append(i[hit])
            out_j.append(j[hit])
    return np.concatenate(out_i), np.concatenate(out_j)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (node, root) that connect what the links connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return [(x, int(r)) for x, r in enumerate(label) if r != x]
        label = new


def _compare(n: int, threshold: float, tolerance: float):
    steps = least_matches(threshold, tolerance)

    def block(rows: list[tuple], first: int, second: int) -> tuple[list, list, list]:
        nodes = [r[0] for r in rows]
        sets = [shingles(r[2], n) for r in rows]
        values = np.stack([np.frombuffer(r[3], np.uint16) for r in rows])
        part = np.array([r[4] for r in rows])
        left, right = np.flatnonzero(part == first), np.flatnonzero(part == second)
        i, j = _links_within(sets, values, left, right, first == second, threshold, steps)
        times = np.array([r[1] for r in rows])
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        some = np.flatnonzero(links)
        forest = _forest(len(rows), i, j)
        a = [nodes[x] for x in some] + [nodes[x] for x, _ in forest]
        b = [None] * len(some) + [nodes[r] for _, r in forest]
        return a, b, [int(links[x]) for x in some] + [0] * len(forest)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, work = [], None
        a, b, links = [], [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "part_a", "part_b", "node", "times", "text", "values", "part")]
            for component, x, y, *row in zip(*columns):
                if (component, x, y) != work:
                    if len(held) > 1:
                        for whole, part in zip((a, b, links), block(held, work[1], work[2])):
                            whole += part
                    held, work = [], (component, x, y)
                if not held or held[-1][0] != row[0]:  # a row written twice is one document
                    held.append(row)
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])
                a, b, links = [], [], []
        if len(held) > 1:
            for whole, part in zip((a, b, links), block(held, work[1], work[2])):
                whole += part
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    return compare


def _same_id(a: Column, b: Column) -> Column:
    """Whether ids agree, null ids too; a condition beside the key of a join, which deals rows out by that key alone.

    So rows are grouped by key and id where the join left them, without another shuffle.
    """
    return F.coalesce(a == b, a.isNull() & b.isNull())


def join_similar(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, _k, class_id, class_k, n_links) of every document; ``_k`` as in with_key.

    A class holds what links connect; its id is its first document's (null ids
    first), ``class_k`` that document's key. ``n_links`` counts the other
    documents of similarity ``threshold`` or more, exact copies included.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = with_key(docs.select("doc_id", "text"))
    text_of = keyed.select(F.col("doc_id").cast("string").alias("doc_id"), "_k", "text")
    sketches = cut(text_of.mapInArrow(_sketch(n), SKETCH).withColumn("doc_id", F.col("doc_id").cast(kind)))
    # rows that agree in id and text are one document
    members = sketches.filter("n > 0").select("doc_id", "_k", "c1", "c2").distinct()
    first = members.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "_k")).alias("first"), F.count("*").alias("times"))
    # the class's number is drawn before the rows are written, so it stays what it is
    heads = cut(first.select("c1", "c2", "times", F.col("first.doc_id").alias("doc_id"), F.col("first._k").alias("_k"), F.monotonically_increasing_id().alias("node")))
    same = (F.col("s._k") == F.col("h._k")) & _same_id(F.col("s.doc_id"), F.col("h.doc_id"))
    chosen = sketches.alias("s").join(heads.alias("h"), same).select("h.doc_id", "h._k", "h.node", "h.times", "h.c1", "h.c2", "s.n", "s.bands", "s.values")
    classes = cut(chosen.dropDuplicates(["doc_id", "_k"]))

    clusters = candidate_clusters(classes)
    weights = clusters.join(classes.select("node", "n"), "node").groupBy("component").agg(F.ceil(F.sum(F.col("n") + ROW_SHINGLES) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    work = classes.select("doc_id", "_k", "node", "times", "values").join(clusters, "node").join(weights, "component")
    work = work.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    same = (F.col("t._k") == F.col("w._k")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    work = keyed.alias("t").join(work.alias("w"), same).select("w.component", "w.node", "w.times", "w.part", "w.blocks", "w.values", "t.text")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    work = work.select("*", others).withColumns({"part_a": F.least("part", "other"), "part_b": F.greatest("part", "other")})
    work = work.repartition("component", "part_a", "part_b").sortWithinPartitions("component", "part_a", "part_b", "node")
    work = work.select("component", "part_a", "part_b", "node", "times", "text", "values", "part")
    found = cut(work.mapInArrow(_compare(n, threshold, tolerance), "a long, b long, links long"))

    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    components = connected(found.filter("b IS NOT NULL").select("a", "b"))
    named = classes.select("node", "times", "c1", "c2", "doc_id", "_k").join(counts, "node", "left").join(components, "node", "left")
    named = cut(named.withColumns({"component": F.coalesce("component", "node"), "links": F.coalesce("links", F.lit(0)) + F.col("times") - 1}))
    heads_of = named.groupBy("component").agg(F.min(F.struct("doc_id", "_k")).alias("head"))
    named = named.select("c1", "c2", "links", "component").join(heads_of, "component").select("c1", "c2", "links", "head")
    placed = sketches.select("doc_id", "_k", "n", "c1", "c2").join(named, ["c1", "c2"], "left").withColumns({"head": F.when(F.col("n") > 0, F.col("head")), "links": F.when(F.col("n") > 0, F.col("links"))})
    alone = F.struct("doc_id", "_k")
    head = F.coalesce("head", alone)
    return placed.select("doc_id", "_k", head["doc_id"].alias("class_id"), head["_k"].alias("class_k"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class: its first document's."""
    keyed = with_key(docs)
    joined = join_similar(docs, **how)
    first = (F.col("_k") == F.col("class_k")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    heads = joined.filter(first).select(F.col("class_id").alias("_d"), F.col("class_k").alias("_k2"))
    kept = keyed.join(heads, (F.col("_k") == F.col("_k2")) & _same_id(F.col("doc_id"), F.col("_d")), "left_semi")
    rows = [F.col(c) for c in docs.columns]
    # maps have no order, their JSON has
    order = [c if orderable(docs.schema[c].dataType) else F.to_json(F.struct(c)) for c in docs.columns]
    one = kept.groupBy("_k", F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*rows), F.struct(*order)).alias("row"))
    return one.select("row.*")
