"""Token counts under a unigram model, by dynamic programming over a trie.

Texts are cut at white space; each pre-token gets the word mark in front. The
distinct pre-tokens of a batch are sorted into a trie (a node is a prefix shared
by neighbouring rows), and the best score and token count of each prefix are
computed once per node: depth by depth, and along each path for long pre-tokens. A pre-token's count stands at its
terminal node. Characters that no piece covers cost ``UNKNOWN`` below the least
piece and count as their UTF-8 bytes (byte fallback).

The vocabulary is a public file and a parameter; nothing is trained. Its pieces
are ranked, and a piece of rank r scores -log(r + 2.7).

Defined results: null and empty texts have no tokens; of equal scores the
segmentation with fewer tokens counts; repeated rows count alike; an empty table
gives no rows; other columns pass through, but for those named ``n_pretokens``
or ``n_tokens``, which are replaced.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
#: The trie is walked level by level for pre-tokens up to this length, path by path for longer ones, which would pad all others.
LONG = 64
ROWS = 100_000
#: So many pre-tokens up to that length are remembered.
KNOWN = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TIE = 1e-9


def read_vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece file in rank order, without control, byte and white-space pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    ids = range(model.get_piece_size())
    pieces = [(-model.get_score(i), i, model.id_to_piece(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p for _, _, p in sorted(pieces) if MARK not in p[1:]]


def piece_scores(pieces: list[str]) -> dict[str, float]:
    scores: dict[str, float] = {}
    for rank, piece in enumerate(pieces):
        scores.setdefault(piece, -math.log(rank + 2.7))
    return scores


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix_hashes(matrix: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix of every row."""
    out = np.zeros((matrix.shape[1] + 1, matrix.shape[0]), np.uint64)
    for d in range(matrix.shape[1]):
        out[d + 1] = out[d] * _BASE + matrix[:, d].astype(np.uint64) + np.uint64(1)
    return out


def _shared(a: str, b: str) -> int:
    """How many characters two strings begin with alike."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


class UnigramTrie:
    """Counts of pre-tokens; those counted before are remembered."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.counts: dict[str, int] = {}
        self.passing: list[str] = []
        hashes = {}
        for piece, score in scores.items():
            hashes[int(_prefix_hashes(_codes(piece)[None])[-1, 0])] = score
        self.keys = np.array(sorted(hashes), np.uint64)
        self.values = np.array([hashes[int(k)] for k in self.keys])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.powers = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Scores of the pieces with these hashes, -inf for none."""
        out = np.full(len(hashes), -np.inf)
        near = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[near]
        out[near[hit]] = self.values[at[hit]]
        return out

    def _paths(self, words: list[str]) -> Iterator[int]:
        """Counts of sorted pre-tokens, one path of the trie after the other; a path goes on from what it shares with the one before."""
        best, count, before = array("d", [0.0]), array("q", [0]), ""
        for word in words:
            shared = _shared(before, word)
            del best[shared + 1 :], count[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                score, n = best[d - 1] + self.unknown, count[d - 1] + len(word[d - 1].encode("utf-8", "surrogatepass"))
                for length in range(1, min(d, self.longest) + 1):
                    piece = self.scores.get(word[d - length : d])
                    if piece is not None:
                        s, c = best[d - length] + piece, count[d - length] + 1
                        if s > score + _TIE or (s > score - _TIE and c < n):
                            score, n = s, c
                best.append(score)
                count.append(n)
            before = word
            yield count[-1]

    def grow(self, words: list[str]) -> None:
        """Counts the pre-tokens that are not known yet; long ones are forgotten with the next words."""
        for w in self.passing:
            self.counts.pop(w, None)
        if len(self.counts) > KNOWN:
            self.counts.clear()
        new = sorted(w for w in set(words) if w not in self.counts)
        self.passing = [w for w in new if len(w) > LONG]
        self.counts.update(zip(self.passing, self._paths(self.passing)))
        short = [w for w in new if len(w) <= LONG]
        for i in range(0, len(short), ROWS):
            rows = short[i : i + ROWS]
            self.counts.update(zip(rows, self._trie(rows).tolist()))

    def _trie(self, rows: list[str]) -> np.ndarray:
        lengths = np.array([len(w) for w in rows])
        depth = int(lengths.max())
        matrix = _codes("".join(w.ljust(depth, "\0") for w in rows)).reshape(len(rows), depth)
        hashes = _prefix_hashes(matrix)
        shared = np.zeros(len(rows), np.int64)  # how much of its prefix a row has in common with the row above
        shared[1:] = np.argmax(np.concatenate((matrix[1:] != matrix[:-1], np.ones((len(rows) - 1, 1), bool)), axis=1), axis=1)
        wide = np.array([1, 1, 2, 3, 4])[1:]
        best, count = np.zeros((depth + 1, len(rows))), np.zeros((depth + 1, len(rows)), np.int32)
        index = np.arange(len(rows))
        for d in range(1, depth + 1):
            begins = shared < d
            node = np.flatnonzero(begins & (lengths >= d))
            char = matrix[node, d - 1]
            score = best[d - 1, node] + self.unknown
            n = count[d - 1, node] + wide[np.searchsorted([0x80, 0x800, 0x10000], char, side="right")]
            for length in range(1, min(d, self.longest) + 1):
                piece = self.lookup(hashes[d, node] - hashes[d - length, node] * self.powers[length])
                s, c = best[d - length, node] + piece, count[d - length, node] + 1
                better = (s > score + _TIE) | ((s > score - _TIE) & (c < n))
                score, n = np.where(better, s, score), np.where(better, c, n)
            best[d, node], count[d, node] = score, n
            owner = np.maximum.accumulate(np.where(begins, index, 0))  # rows below share the node
            best[d], count[d] = best[d, owner], count[d, owner]
        return count[lengths, index]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_pretokens, n_tokens."""
    scores = piece_scores(read_vocabulary(vocabulary))  # a vocabulary file has a fixed size

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = UnigramTrie(scores)
        for texts in batches:
            split = [[MARK + w for w in t.split()] if t else [] for t in texts]
            trie.grow([w for words in split for w in words])
            known = trie.counts
            yield pd.DataFrame({"n_pretokens": [len(words) for words in split], "n_tokens": [sum(map(known.__getitem__, words)) for words in split]}, dtype="int64")

    made = ("n_pretokens", "n_tokens")
    done = docs.select(*[c for c in docs.columns if c not in made], counted(text).alias("_c"))
    return done.select(*[c for c in done.columns if c != "_c"], "_c.*")
