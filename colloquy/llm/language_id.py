"""Language ID: nearest of several TF-IDF centroids per language, with rejection by distance.

A text becomes lower-cased letters and single spaces; its 1- to 3-grams are
hashed to ``DIMS`` counts, damped by a square root, weighed by inverse document
frequency and normalised. Document frequencies cover every training row; the
centroids come from a bounded sample of them: the ``per_language`` rows of each
language with the smallest hashes, ``max_sample`` rows in all. Three quarters of
each language's sample are clustered by spherical k-means into ``centroids``
centres. A text gets the language of the centre with the largest cosine.

The quarter left out tells how near texts are to their nearest centre. Cosines
grow with the length, so this is taken by length (powers of two of the n-grams),
and for a length never higher than for longer texts. A text is rejected if its
cosine is below ``slack`` times the ``quantile`` of its length.

Defined results: a null text, or one without a letter, is ``und``, score 0 and
rejected; rows with null language are predicted but never learned from; repeated
rows count once in the sample; of equally near centres the first counts, by
language in order; without training rows everything is ``und``; an empty table
gives no rows; other columns pass through, but for those of the operator's own
names, which are replaced.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_ends

DIMS = 4096
NGRAMS = 3
UNDETERMINED = "und"
PREDICTION = "lang_pred string, score double, rejected boolean"
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate(([32], codes[letter | np.concatenate(([True], letter[:-1]))], [32])).astype(np.uint32)
    counts = np.zeros(DIMS, np.int64)
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(NGRAMS):
        mixed = (mixed[: len(codes) - n] ^ codes[n:]) * _MULTIPLIERS[n]
        mixed ^= mixed >> np.uint32(15)
        counts += np.bincount((mixed * _MULTIPLIERS[0]) >> np.uint32(20), minlength=DIMS)
    return counts


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram bucket occurs, over all rows, and how many texts have any."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                if (c := ngram_counts(text)) is not None:
                    df += c > 0
                    n += 1
        yield pd.DataFrame({"bucket": np.arange(-1, DIMS), "n": np.concatenate(([n], df))})

    rows = texts.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = {r["bucket"]: r["n"] for r in rows}
    return np.array([out.get(b, 0) for b in range(DIMS)]), out.get(-1, 0)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    return (v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32)


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun from the rows that are farthest apart."""
    centres = [vectors.mean(axis=0)]
    for _ in range(min(k, len(vectors)) - 1):
        centres.append(vectors[np.argmin(np.max(vectors @ np.stack(centres).T, axis=1))])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(vectors @ c.T, axis=1)
        c = np.stack([vectors[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


#: Texts are told apart by length up to 2 ** LENGTHS n-grams.
LENGTHS = 20


def _length(counts: np.ndarray) -> int:
    return min(int(counts.sum()).bit_length(), LENGTHS)


def floors_of(lengths: np.ndarray, cosines: np.ndarray, quantile: float, slack: float, least: int = 20) -> np.ndarray:
    """The smallest cosine that is accepted at each length, from left-out texts; where fewer than ``least`` are near that length, shorter ones count, too."""
    out = np.zeros(LENGTHS + 1)
    for length in range(LENGTHS + 1):
        near = cosines[np.abs(lengths - length) <= 1]
        shorter = length - 1
        while len(near) < least and shorter > 0:
            shorter -= 1
            near = cosines[(lengths >= shorter) & (lengths <= length + 1)]
        out[length] = slack * np.quantile(near, quantile) if len(near) else 0.0
    return np.minimum.accumulate(out[::-1])[::-1]


class LanguageModel:
    def __init__(self, idf: np.ndarray, centres: np.ndarray, languages: list[str], floors: np.ndarray):
        self.idf, self.centres, self.languages, self.floors = idf, centres, languages, floors

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNDETERMINED, 0.0, True
        cosines = self.centres @ _weigh(counts, self.idf)
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(max(cosines[best], 0.0), 1.0)), bool(cosines[best] < self.floors[_length(counts)])


def training_sample(train: DataFrame, per_language: int, max_sample: int) -> list:
    """At most ``max_sample`` rows (lang, counts): of each language those with the smallest hashes.

    Of more languages than ``max_sample`` the most frequent are learned. The hash
    at which each one's sample ends is found on hashes alone; texts are read once
    more and only those below it are dealt out.
    """
    languages = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_sample).select("lang")
    share = max(1, min(per_language, max_sample // max(languages.count(), 1)))
    hashed = train.select("lang", F.xxhash64("doc_id", "text").alias("h")).join(F.broadcast(languages), "lang")
    ends = F.broadcast(sample_ends(hashed, "lang", share))
    chosen = train.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").join(ends, "lang").filter(F.col("h") <= F.col("upto")).dropDuplicates(["lang", "h"])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [ngram_counts(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": [lang for lang, c in zip(batch["lang"], made) if c is not None], "h": [h for h, c in zip(batch["h"], made) if c is not None], "counts": [zlib.compress(c.astype(np.int32).tobytes(), 1) for c in made if c is not None]})

    return chosen.select("lang", "h", "text").mapInPandas(features, "lang string, h long, counts binary").orderBy("lang", "h", "counts").collect()


def fit(train: DataFrame, centroids: int = 4, per_language: int = 400, max_sample: int = 4000, quantile: float = 0.01, slack: float = 0.5) -> LanguageModel:
    """A model of the rows of ``train`` (doc_id, text, lang) that have a language."""
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 0.1  # in nearly every text: little weight, not none
    by_language: dict[str, list[np.ndarray]] = {}
    for row in training_sample(train, per_language, max_sample):
        by_language.setdefault(row["lang"], []).append(np.frombuffer(zlib.decompress(row["counts"]), np.int32))
    if not by_language:
        return LanguageModel(idf, np.zeros((0, DIMS)), [], np.zeros(LENGTHS + 1))
    centres, languages, left_out = [], [], []
    for lang, many in sorted(by_language.items()):
        vectors = np.stack([_weigh(c, idf) for c in many])
        out = np.arange(len(many)) % 4 == 3
        c = _clusters(vectors[~out], centroids)
        centres.append(c)
        languages += [lang] * len(c)
        left_out += list(zip(map(_length, compress(many, out)), vectors[out]))
    all_centres = np.concatenate(centres)
    lengths, cosines = np.array([n for n, _ in left_out]), np.array([float((all_centres @ v).max()) for _, v in left_out])
    return LanguageModel(idf, all_centres, languages, floors_of(lengths, cosines, quantile, slack))


def predictor(model: LanguageModel):
    """A column function text -> struct of lang_pred, score and rejected."""

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict.asNondeterministic()  # keeps Spark from running it once more below a filter


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, **how) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred``, ``score``, ``rejected``, learned from the other folds."""
    train = docs.filter(fold(F.col("doc_id"), folds) != held_out)
    predict = predictor(fit(train.select("doc_id", "text", "lang"), **how))
    made = ("held_out", "lang_pred", "score", "rejected")
    done = docs.select(*[c for c in docs.columns if c not in made], (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), predict("text").alias("_p"))
    return done.select(*[c for c in done.columns if c != "_p"], "_p.lang_pred", "_p.score", "_p.rejected")
