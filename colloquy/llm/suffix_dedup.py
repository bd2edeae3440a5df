"""Suffix-array dedup: a depth-limited radix sort of the byte suffixes of all texts.

Suffixes are ordered only through ``depth`` bytes; a group of suffixes that are
equal that far is a repeated window, and every byte of it goes. The passes take
the most significant digit first, and suffixes that are alone in their group
never reach the next pass:

1. The digit of ``depth // 2`` bytes at anchor suffixes: those chosen by their
   content so that any two equal windows hold the same anchor at the same place
   (smallest hash in a sliding range). An anchor stands for all windows around it.
   If its digit is unique, so are they. If all bytes that they cover repeat, they
   all do, and are settled at once.
2. What is left, the edges of copies and one copy beside each of them, is cut to
   blocks of ``BLOCK`` windows. Their digit is what the windows of a block share;
   again a unique one ends a block and a repeated whole block settles it.
3. All ``depth`` bytes of each window in the blocks that are still left.

A pass deals suffixes out by their digit, as a radix sort does, and its task
sorts what it got; digits are compared by two independent 64-bit hashes, so two
different windows meet with a probability of about 1e-11 among 1e14. Hot groups are combined in the tasks
that make them: a key that several rows of a batch share is settled there, and
one row of it goes on. A digit with more than ``WIDE`` contexts in one batch is
an edge at once and sends one marked row on.

Defined results: null and empty texts have no bytes and the hash of nothing;
texts shorter than ``depth`` stay whole; repeated rows are separate documents
and remove one another; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import with_key
from .suffixes import Digits, anchors, owned

DEPTH = 200
BLOCK = 10
WIDE = 16
#: So many rows of a pass are combined and sent on at a time, whatever an Arrow batch holds.
HELD_ROWS = 150_000
#: What is known of a row when it leaves its task: nothing; its context repeats; its digit repeats.
OPEN, COPY, EDGE = 0, 1, 2
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: A place stands for the windows that start from hi - width to hi.
GROUPED = "g long, c long, _k long, n int, hi int, width int, state byte, done boolean, mixed boolean"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed, for the one exchange that holds them."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at = batch.schema.get_field_index("bytes")
        yield batch.set_column(at, "bytes", pa.array([pack(b) for b in batch.column(at).to_pylist()], pa.binary()))


def _unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (np.frombuffer(unpack(b.as_buffer()), np.uint8) for b in column)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds of each row's list, and all values."""
    return column.offsets.to_numpy(), column.values


def _places(column: pa.Array, wanted: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row (lo, hi) of its places with that mark."""
    bounds, values = _lists(column)
    hi, width, mark = (values.field(x).to_numpy(zero_copy_only=False) for x in ("hi", "width", wanted))
    for i, j in zip(bounds[:-1], bounds[1:]):
        chosen = hi[i:j][mark[i:j]].astype(np.int64)
        yield chosen - width[i:j][mark[i:j]], chosen


def _run_lengths(new: np.ndarray) -> np.ndarray:
    """For each row, how many rows its run has; new: where a run begins."""
    sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
    return np.repeat(sizes, sizes)


def _begins(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _combined(g: np.ndarray, c: np.ndarray, k: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """One task's rows of a pass, with what can be settled among them."""
    order = np.lexsort((c, g))
    sg, sc = g[order], c[order]
    new, digits = _begins(sg, sc), _begins(sg)
    state = np.where(_run_lengths(new) > 1, COPY, OPEN)
    done = ~new  # a context's first row goes on for all of them
    sizes = np.diff(np.append(np.flatnonzero(digits), len(sg)))
    wide = np.repeat(np.add.reduceat(new, np.flatnonzero(digits)) > WIDE, sizes) if len(sg) else np.zeros(0, bool)
    state = np.where(wide & (state == OPEN), EDGE, state)
    done |= wide & (state == EDGE) & ~digits
    mixed = wide & ~done
    state_, done_, mixed_ = np.empty(len(g), np.int8), np.empty(len(g), bool), np.empty(len(g), bool)
    state_[order], done_[order], mixed_[order] = state, done, mixed
    g = np.where(done_, (k.view(np.uint64) + hi.astype(np.uint64)) * _SPREAD, g)
    made = [g.view(np.int64), c.view(np.int64), k, n.astype(np.int32), hi.astype(np.int32), (hi - lo).astype(np.int32), state_, done_, mixed_]
    return pa.record_batch([pa.array(x) for x in made], names=[x.split()[0] for x in GROUPED.split(", ")])


def _sent(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of a task's documents, combined ``HELD_ROWS`` or a document at a time; freed memory goes back to the system."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD_ROWS:
            yield _combined(*map(np.concatenate, zip(*held)))
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    if n:
        yield _combined(*map(np.concatenate, zip(*held)))


def _places_of_pass(depth: int, digit: int, in_blocks: bool):
    """The rows of pass 1 (anchors), or of pass 2 (blocks around the anchors that probe)."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            if in_blocks:
                texts, found = _unpacked(batch.column("bytes")), _places(batch.column("found"), "probe")
            else:
                texts, found = (np.frombuffer(b.as_buffer(), np.uint8) for b in batch.column("bytes")), [None] * len(batch)
            for key, data, chosen in zip(batch.column("_k").to_numpy(), texts, found):
                d = Digits(data)
                if in_blocks:
                    at, p = owned(d, digit, depth, np.unique(chosen[1]))
                    block = np.unique(np.stack((at, (at - p) // BLOCK)), axis=1)
                    lo, hi = np.maximum(block[0] - block[1] * BLOCK - (BLOCK - 1), block[0] - (depth - digit)), block[0] - block[1] * BLOCK
                    g = d.at(0, hi, lo + depth) + block[1].astype(np.uint64) * _SPREAD
                else:
                    at, g = anchors(d, digit, depth)
                    lo, hi = at - (depth - digit), at
                left = np.maximum(lo, 0)
                c = d.at(1, left, np.minimum(hi + depth, d.n)) ^ ((hi - left).astype(np.uint64) * _SPREAD)
                yield g, c, np.full(len(g), key, np.int64), np.full(len(g), d.n, np.int64), lo, hi

    return lambda batches: _sent(places(batches))


def survivors(rows: DataFrame) -> DataFrame:
    """(_k, n, found): the places of each document whose digit repeats; copies are settled, the rest probes on."""
    same_context, same_digit = W.partitionBy("g", "done", "c"), W.partitionBy("g", "done")
    seen = rows.repartition("g", "done").withColumns({"n_context": F.count("*").over(same_context), "first": F.min(F.struct("_k", "hi")).over(same_context)})
    seen = seen.withColumns({"n_digit": F.count("*").over(same_digit), "several": (F.min("c").over(same_digit) != F.max("c").over(same_digit)) | F.max("mixed").over(same_digit)})
    copy = (F.col("state") == COPY) | (~F.col("done") & (F.col("n_context") > 1))
    alive = copy | (F.col("state") == EDGE) | (~F.col("done") & (F.col("n_digit") > 1))
    # Beside another context, one copy of a context goes on as a partner.
    probe = ~copy | (~F.col("done") & F.col("several") & (F.struct("_k", "hi") == F.col("first")))
    place = F.struct("hi", "width", copy.alias("copy"), probe.alias("probe"))
    return seen.filter(alive).groupBy("_k", "n").agg(F.collect_list(place).alias("found"))


def _paint(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    start, stop = np.clip(start, 0, n), np.clip(stop, 0, n)
    np.add.at(edge, start[start < stop], 1)
    np.add.at(edge, stop[start < stop], -1)
    return np.cumsum(edge)[:n] > 0


def _window_rows(depth: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, data, (lo, hi) in zip(batch.column("_k").to_numpy(), _unpacked(batch.column("bytes")), _places(batch.column("found"), "probe")):
                d = Digits(data)
                p = np.flatnonzero(_paint(d.n - depth + 1, lo, hi + 1))
                yield d.at(0, p, p + depth), d.at(1, p, p + depth), np.full(len(p), key, np.int64), np.full(len(p), d.n, np.int64), p, p

    return lambda batches: _sent(rows(batches))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """Pass 3: (_k, n, starts) of the windows that occur twice or more."""
    times = F.count("*").over(W.partitionBy("g", "c", "done"))
    again = rows.withColumn("times", times).filter((F.col("state") == COPY) | (~F.col("done") & (F.col("times") > 1)))
    return again.groupBy("_k", "n").agg(F.collect_set("hi").alias("starts"))


RESULT = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _cut_out(depth: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [i for i, name in enumerate(batch.schema.names) if name.startswith("_own_")]
            out: list[tuple] = []
            bounds, starts = _lists(batch.column("starts"))
            starts = starts.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (data, *found) in enumerate(zip(_unpacked(batch.column("bytes")), *[_places(batch.column(c), "copy") for c in ("found_1", "found_2")])):
                p = starts[bounds[i] : bounds[i + 1]]
                lo, hi = map(np.concatenate, zip((p, p), *found))
                gone = _paint(len(data), lo, np.minimum(hi, len(data) - depth) + depth)
                kept = data[~gone].tobytes()
                spans = int(gone.sum() and gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
            made = [pa.array([row[i] for row in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]
            yield pa.record_batch([*[batch.column(i) for i in own], *made], names=[*[batch.schema.names[i] for i in own], *[x.split()[0] for x in RESULT.split(", ")]])

    return cut


def dedup_substrings(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """All columns but ``text``, and n_bytes, n_removed, n_spans, kept (bytes), kept_sha256.

    One plan: the documents are dealt out by key once, and all passes read that exchange.
    """
    digit = depth // 2
    made = [x.split()[0] for x in RESULT.split(", ")]
    own = [c for c in docs.columns if c != "text" and c not in made]
    held = [f"_own_{i}" for i in range(len(own))]
    keyed = with_key(docs).select(*[F.col(c).alias(h) for c, h in zip(own, held)], "_k", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))
    sized = keyed.withColumn("n", F.octet_length("bytes"))
    sized = sized.mapInArrow(_packed, sized.schema)

    def beside(left: DataFrame, found: DataFrame, column: str, name: str, how: str = "left") -> DataFrame:
        right = found.select(F.col("_k").alias(f"_k_{name}"), F.col("n").alias(f"_n_{name}"), F.col(column).alias(name))
        return left.join(right, (F.col("_k") == F.col(f"_k_{name}")) & (F.col("n") == F.col(f"_n_{name}")), how).drop(f"_k_{name}", f"_n_{name}")

    def probing(found: DataFrame) -> DataFrame:
        return beside(sized, found, "found", "found").filter(F.exists("found", lambda x: x["probe"]))

    first = survivors(keyed.select("_k", "bytes").mapInArrow(_places_of_pass(depth, digit, False), GROUPED))
    second = survivors(probing(first).mapInArrow(_places_of_pass(depth, digit, True), GROUPED))
    third = repeated_windows(probing(second).mapInArrow(_window_rows(depth), GROUPED))
    known = beside(beside(beside(sized, first, "found", "found_1"), second, "found", "found_2"), third, "starts", "starts")
    schema = StructType([StructField(h, docs.schema[c].dataType) for c, h in zip(own, held)] + StructType.fromDDL(RESULT).fields)
    done = known.mapInArrow(_cut_out(depth), schema)
    return done.select(*[F.col(h).alias(c) for c, h in zip(own, held)], *made)
