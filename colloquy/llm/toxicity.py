"""Toxicity: noisy-channel deobfuscation, then a classifier over the restored words.

A character trigram model is counted over all documents. Suspicious segments
(a digit or sign beside a letter, a letter twice in a row, separators between
letters, single characters with white space between them) become lattices: a sign
may stand for letters, a repeated letter or a separator may be dropped. Viterbi
decoding finds the most likely text under channel and character model; it also
decides which white space beside a piece of up to ``PIECE`` letters, restored or not, is
dropped. Scores come from the words of the
text and of the restored segments: whole words and their first 4 to 8 letters,
chosen and weighed by logistic regression on a bounded sample of labelled rows
(``per_class`` rows of either label, those with the smallest hashes).

Defined results: null and empty texts score what a text without any feature
scores; an id labelled more than once is toxic if any label says so, labels but 0
and 1 are left out; rows with null ids are never learned from; of an id with several texts one
counts; features that tell equally much go by name; without both labels the
score is 0.5 for a text without features and nothing is learned; repeated rows
score alike; an empty table gives no rows; other columns pass through, but for
those of the operator's own names, which are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_ends
from .language_id import fold

# Letters that a sign commonly stands for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "+": "t", "|": "li", "*": "aeiou"}
SEPARATORS = " .-_*,:;/\\~'’`´·•\""
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûü"
#: Symbol 0 is the space (and all that is no letter), the last symbol any other letter.
SYMBOLS = len(ALPHABET) + 2
SIGN_COST, GAP_COST, DROP_COST, DOUBLE_COST, TRIPLE_COST = -1.0, -1.5, -0.1, -2.0, -6.0

SIGN, BETWEEN = "[" + re.escape("".join(SIGNS)) + "]", "[" + re.escape(SEPARATORS.replace(" ", "")) + "]"
#: A sign next to a letter, letters with separators between them; or a letter twice.
NOISY = re.compile(rf"{SIGN}[^\W\d_]|[^\W\d_]{SIGN}|[^\W\d_](?:{BETWEEN}|{SIGN})+[^\W\d_]")
DOUBLED = re.compile(r"([^\W\d_])\1")
SUSPICIOUS = re.compile(rf"{NOISY.pattern}|{DOUBLED.pattern}")
#: Where a word may be noisy: a sign, or something between letters.
SIGNED = re.compile(rf"(?:{BETWEEN}|{SIGN})+(?=[^\W\d_])|{SIGN}")
#: Single characters with white space between them; the decoder sees one space for each.
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
#: White space is between whole words where both have more letters than this.
PIECE = 3
#: Beginnings of words have this many letters at most.
LONGEST = 8
#: Longer segments are decoded in blocks, each from the end of the best path of the one before.
BLOCK = 4096
#: A cache's entries, and the length up to which a segment gets into one.
CACHED, CACHED_LENGTH = 200_000, 64
REPEATED = re.compile(r"(.)\1+")
WORD = re.compile(r"[^\W\d_]+")


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.int64)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = SYMBOLS - 1
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 1
    return table


def character_model(texts: DataFrame) -> np.ndarray:
    """log P(symbol | two symbols before), counted over every text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch["text"]:
                if text:
                    s = table[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)]
                    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "n": total[seen]})

    counts = np.zeros(SYMBOLS**3)
    for row in texts.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[row["gram"]] = row["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = counts.sum(axis=0) + 0.1
    backed = pairs / pairs.sum(axis=1, keepdims=True)
    return np.log((counts + 2.0 * backed[None]) / (counts.sum(axis=2, keepdims=True) + 2.0))


class Decoder:
    """Viterbi over a segment's lattice; with ``only``, what cannot give one of these features need not be restored."""

    def __init__(self, model: np.ndarray, only: Iterable[str] | None = None):
        self.only = None if only is None else frozenset(only)
        self.wholes = {_once(f.lstrip("=")) for f in only or ()}
        self.starts = {w[:k] for w in self.wholes for k in range(1, len(w) + 1)}
        self.begin = _beginning_like(self.wholes)
        self.model = model.tolist()
        self.index = {c: i + 1 for i, c in enumerate(ALPHABET)}
        self.known: dict[str, str] = {}
        self.gaps: dict[str, list[bool]] = {}
        self.tokens: dict[str, _Token] = {}

    def options(self, segment: str) -> list[list[tuple[str, float]]]:
        """What each character may stand for; a sign that a segment begins with is a letter, as a space would cost nothing there."""
        out, run, begun = [], 0, False
        for i, c in enumerate(segment):
            leads, begun = not begun and c in SIGNS and c not in SEPARATORS, begun or c.isalpha() or c in SIGNS
            run = run + 1 if i and segment[i - 1] == c else 0
            if c.isalpha():
                own = [(c, 0.0 if run < 1 else DOUBLE_COST if run == 1 else TRIPLE_COST)]
                out.append(own + [("", DROP_COST)] * (run > 0))
                continue
            own = [(letter, SIGN_COST) for letter in SIGNS.get(c, "")]
            if c in SEPARATORS:
                own += [("", DROP_COST), (" ", GAP_COST)]
            out.append(own + [(" ", GAP_COST)] * (c not in SEPARATORS and not leads))
        return out

    def decode(self, segment: str) -> str:
        """The restored segment; ends count as spaces."""
        if segment in self.known:
            return self.known[segment]
        out, state = [], (0, 0)
        for start in range(0, len(segment), BLOCK):
            last = start + BLOCK >= len(segment)
            letters, state = self._best(self.options(segment[max(start - 1, 0) : start + BLOCK])[min(start, 1) :], state, last)
            out += letters
        return self._kept(self.known, segment, "".join(out))

    def _best(self, lattice: list[list[tuple[str, float]]], state: tuple[int, int], last: bool) -> tuple[list[str], tuple[int, int]]:
        """The letters of the best path from a state, and the state in which it ends; ``last``: a space follows."""
        index, model, other = self.index, self.model, SYMBOLS - 1
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {state: (0.0, None)}
        for options in lattice:
            reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                row = model[a][b]
                for letter, cost in options:
                    if not letter:
                        state, total, way = (a, b), score + cost, path
                    else:
                        s = 0 if letter == " " else index.get(letter, other)
                        state, total, way = (b, s), score + cost + (row[s] if s or b else 0.0), (letter, path)
                    if state not in reached or reached[state][0] < total:
                        reached[state] = (total, way)
            states = reached
        _, path, state = max(((score + (model[a][b][0] if last else 0.0), path, (a, b)) for (a, b), (score, path) in states.items()), key=lambda x: x[0])
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return letters[::-1], state

    @staticmethod
    def _kept(cache: dict, key: str, value):
        if len(key) <= CACHED_LENGTH:
            if len(cache) >= CACHED:
                cache.clear()
            cache[key] = value
        return value

    def closed(self, around: str) -> list[bool]:
        """For each space in ``around`` whether it is dropped."""
        if around in self.gaps:
            return self.gaps[around]
        out, at, restored = [], 0, self.decode(around)
        for piece in around.split(" ")[:-1]:
            at += len(piece)
            out.append(not restored.startswith(" ", at))
            at += not out[-1]
        return self._kept(self.gaps, around, out)

    def joined(self, pieces: list[str]) -> list[str]:
        """What neighbouring words make where the space between them is dropped.

        A trigram sees two letters on either side, so these (and whole runs of
        single letters) decide as the whole text would. Each piece of a chain begins
        forms, which end with the chain or beyond the longest beginning that counts.
        """
        out, i, n = [], 0, len(pieces) - 1
        chain = [pieces[0]] if pieces else []
        while i < n:
            j = i + 1
            while j < n and len(pieces[j]) == 1 and pieces[j].isalpha():
                j += 1
            around = [pieces[i][-2:], *pieces[i + 1 : j], pieces[j][:2]]
            if j > i + 1 and not around[-1].isalpha():
                around, j = around[:-1], j - 1
            whole = len(pieces[i]) > PIECE and len(pieces[i + 1]) > PIECE
            dropped = [False] if whole else self.closed(" ".join(around)) if all(map(str.isalpha, around)) else [False] * (j - i)
            for k, drop in enumerate(dropped, i + 1):
                if not drop:
                    self._forms(chain, out)
                    chain = []
                chain.append(pieces[k])
            i = j
        self._forms(chain, out)
        return out

    @staticmethod
    def _forms(chain: list[str], out: list[str]) -> None:
        for i in range(len(chain) - 1):
            form = chain[i]
            for piece in chain[i + 1 :][: LONGEST + 1]:
                form += piece
                out.append(form)
                if len(form) > LONGEST:
                    break

    def token(self, t: str) -> _Token:
        """What a word between white space gives by itself and may give with its neighbours, for the ``only`` features."""
        found = self.tokens.get(t)
        if found is not None:
            return found
        words, noisy = WORD.findall(t), NOISY.search(t) is not None
        if noisy:
            pieces = self.decode(t).split()
            made = words + WORD.findall(" ".join(pieces))
            begins = any(self._may_begin(w) for p in pieces for w in WORD.findall(p)[-1:])
            first = WORD.match(pieces[0]) if pieces else None
            found = _Token(self._features(made), begins, None, first.group() if first else "")
        elif DOUBLED.search(t):
            found = _Token(self._features(words + WORD.findall(self.decode(t))), self._may_begin(words[-1]), words[-1], words[0])
        else:
            tail = words[-1] if words and t.endswith(words[-1]) else ""
            head = words[0] if words and t.startswith(words[0]) else ""
            found = _Token(self._features(words), bool(tail) and self._may_begin(tail), tail, head)
        return self._kept(self.tokens, t, found)

    def _features(self, words: Iterable[str]) -> frozenset[str]:
        return frozenset(word_features(words) & self.only) if words else frozenset()

    def _may_begin(self, word: str) -> bool:
        own = _once(word[:4])
        return own in self.starts or any(own[:k] in self.wholes for k in range(1, len(own)))

    def _may_go_on(self, tail: str, head: str) -> bool:
        """Whether a form of a word's end and the next one's beginning can begin like a feature, for all that repeats."""
        own = len(_once(tail))
        if not head or (own > PIECE and len(_once(head)) > PIECE):
            return False
        both = _once(tail + head[:LONGEST])
        return both in self.starts or any(both[:k] in self.wholes for k in range(own, len(both)))

    def pieces(self, tokens: list[str]) -> list[str]:
        """Words between white space, restored where they are suspicious."""
        out: list[str] = []
        for t in tokens:
            if SUSPICIOUS.search(t):
                out += self.decode(t).split()
            else:
                out.append(t)
        return out

    def found(self, text: str) -> set[str]:
        """The ``only`` features of a lower-cased text and of all that is restored of it.

        A feature can only be where letters, for all that repeats or stands between
        them, begin like one, or where a sign stands for a letter; only there words are looked at.
        """
        out: set[str] = set()
        if self.begin is None:
            return out
        for m in SPACED.finditer(text):
            out |= self._features(WORD.findall(self.decode(" ".join(m.group().split()))))
        near, signs = [m.start() for m in self.begin.finditer(text)], [m.start() for m in SIGNED.finditer(text)]
        if not near and not signs:
            return out
        places = [m.span() for m in re.finditer(r"\S+", text)]
        starts = [a for a, _ in places]
        word = lambda i: text[places[i][0] : places[i][1]]
        at = {bisect_right(starts, c) - 1 for c in near}
        for i in {bisect_right(starts, c) - 1 for c in signs}:
            if NOISY.search(word(i)):
                at.add(i)
                letters = 0
                for j in range(i - 1, -1, -1):  # what it is restored to may go on from the words before, too
                    letters += sum(map(str.isalpha, _once(word(j))))
                    if letters > LONGEST:
                        break
                    at.add(j)
        spans: list[tuple[int, int]] = []
        for i in sorted(at):
            note = self.token(word(i))
            out |= note.features
            if not note.begins or (note.tail is not None and not (i + 1 < len(places) and self._may_go_on(note.tail, self.token(word(i + 1)).head))):
                continue
            # with all that decides on the spaces around it
            first, last = max(i - 1, 0), min(i + LONGEST + 2, len(places))
            while first and places[first][1] - places[first][0] < 3 and not (spans and first <= spans[-1][1]):
                first -= 1
            while last < len(places) and places[last - 1][1] - places[last - 1][0] < 3:
                last += 1
            if spans and first <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
            else:
                spans.append((first, last))
        for first, last in spans:
            out |= self._features([w for form in self.joined(self.pieces([word(i) for i in range(first, last)])) for w in WORD.findall(form)])
        return out

    def restored(self, text: str) -> list[str]:
        """The restored forms of the suspicious segments of a lower-cased text."""
        tokens = text.split()
        out = [self.decode(" ".join(m.group().split())) for m in SPACED.finditer(text)]
        out += [self.decode(t) for t in tokens if SUSPICIOUS.search(t)]
        return out + self.joined(self.pieces(tokens))


@dataclass
class _Token:
    features: frozenset[str]
    #: Whether a feature may begin in its last word and go on in the next one.
    begins: bool
    #: Its last word, None where it was restored to several; its first word.
    tail: str | None
    head: str


def _once(word: str) -> str:
    return REPEATED.sub(r"\1", word)


def _beginning_like(words: Iterable[str], letters: int = LONGEST) -> re.Pattern | None:
    """Finds where a word begins with the first letters of one of these, each once or repeated, with anything but letters between them."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w[:letters]:
            node = node.setdefault(c, {})
        node[""] = {}

    def branches(node: dict) -> str:
        if "" in node:
            return ""
        made = [rf"{c}(?:[\W\d_]*{c})*" + (rf"[\W\d_]*{below}" if (below := branches(n)) else "") for c, n in sorted(node.items())]
        return made[0] if len(made) == 1 else f"(?:{'|'.join(made)})"

    return re.compile(rf"(?<![^\W\d_])(?={branches(tree)})") if tree and "" not in tree else None


def word_features(words: Iterable[str]) -> set[str]:
    """Whole words (in ``=``) and beginnings of words."""
    words = set(words)
    made = {f"={w}" for w in words}
    for n in range(4, LONGEST + 1):
        made.update(w[:n] for w in words if len(w) >= n)
    return made


def features(decoder: Decoder, text: str | None) -> set[str]:
    """The features of the text's words and of what was restored; of a decoder's ``only`` ones all that are there."""
    if not text:
        return set()
    text = text.lower()
    if decoder.only is not None:
        return decoder.found(text)
    return word_features(WORD.findall(text) + [w for segment in decoder.restored(text) for w in WORD.findall(segment)])


class ToxicityModel:
    """Weights of the features, and of a text's length, which offsets that long texts hold more of everything."""

    def __init__(self, character_model: np.ndarray, weights: dict[str, float], bias: float, length: float = 0.0):
        self.character_model, self.weights, self.bias, self.length = character_model, weights, bias, length

    def scorer(self):
        decoder, weights, bias, length = Decoder(self.character_model, self.weights), self.weights, self.bias, self.length

        def score(text: str | None) -> float:
            # summed in one order, so that equal texts score alike in every process
            total = bias + length * _length(text) + sum(weights[f] for f in sorted(features(decoder, text)))
            return 1.0 / (1.0 + float(np.exp(-np.clip(total, -500, 500))))

        return score


def _length(text: str | None) -> float:
    return float(np.log1p(len(text.split()))) / 10 if text else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 600, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights by gradient descent, those of all columns but the last not below zero; either label has half the weight of the sample."""
    w, b = np.zeros(x.shape[1]), 0.0
    least = np.zeros(x.shape[1])
    least[-1] = -np.inf
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * share
        w, b = np.maximum(w - rate * 20 * (x.T @ error + ridge * w), least), b - rate * 5 * error.sum()
    return w, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, n_features: int = 600, folds: int = 5, held_out: int = 0) -> ToxicityModel:
    """The model; ``docs`` (doc_id, text) all count for the character model, labels only outside the held-out fold."""
    grams = character_model(docs)
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    labels = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = labels.filter("toxic IN (0, 1)").withColumn("h", F.xxhash64("doc_id"))
    # two rows, one for each label
    ends = F.broadcast(sample_ends(labels.select("toxic", "h"), "toxic", per_class))
    chosen = labels.join(ends, "toxic").filter(F.col("h") <= F.col("upto")).select("doc_id", "toxic")
    # at most 2 * per_class ids by the filter above, as their hashes differ
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, seen = Decoder(grams), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[toxic].update(features(decoder, text))
        yield pd.DataFrame([(f, n, seen[0][f]) for f, n in seen[1].items()] + [(f, 0, n) for f, n in seen[0].items() if f not in seen[1]], columns=["feature", "toxic", "clean"])

    counted = sample.mapInPandas(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5))
    best = counted.filter((F.col("t") >= 3) & (odds > 1)).orderBy(F.desc(F.col("t") * odds), "feature").limit(n_features)
    names = [r["feature"] for r in best.collect()]
    place = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(grams, names)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "toxic": batch["toxic"], "length": [_length(t) for t in batch["text"]], "at": [sorted(place[f] for f in features(decoder, t)) for t in batch["text"]]})

    rows = sample.mapInPandas(present, "doc_id string, toxic int, length double, at array<int>")
    # of an id with several texts one counts, the same in every run
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "length", "at")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if not names or len(set(y)) < 2:
        return ToxicityModel(grams, {}, 0.0)
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
        x[i, -1] = r["length"]
    w, b = _logistic(x, y)
    return ToxicityModel(grams, {f: float(v) for f, v in zip(names, w) if v > 0}, float(b), float(w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score``."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", scored("text"))


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **how) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), folds=folds, held_out=held_out, **how)
    done = score_toxicity(docs.drop("held_out", "score", "predicted"), model)
    return done.withColumns({"held_out": fold(F.col("doc_id"), folds) == held_out, "predicted": (F.col("score") >= 0.5).cast("int")})
