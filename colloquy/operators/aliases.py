"""Aliases of a vocabulary table rewritten to their words, by one automaton over all of them.

The rule is sequential: aliases from the longest to the shortest (equal lengths in
the table's order), each wherever no letter stands before or behind it, case
ignored, over what the ones before have left. An Aho-Corasick automaton finds in one
pass where aliases occur; only there they are applied, each in its turn, to a text of linked characters.
After each only the surroundings of what it has put in are searched again, as a later alias may
occur there. So a text costs its length and its replacements, not their product.

A vocabulary of any size is taken: in the order of the rule it is cut into shards
of ``shard`` aliases, each an automaton of its own; one after the other they
make the same result.

Defined results: a null text stays null; blank aliases, aliases that equal their
word but for case, and aliases without a word have no effect; of an alias that
several words have each applies in its turn. In a word, ``$0`` and ``$&`` stand for what was found and ``$$`` for a dollar sign.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import none_or_blank

_MARK = re.compile(r"\$(\$|&|0|\{0\})")


class _Folds(dict):
    """One character for each character, the same for all its cases."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        upper = c.upper()
        lower = (upper if len(upper) == 1 else c).lower()
        self[code] = ord(lower) if len(lower) == 1 else code
        return self[code]


_FOLDS = _Folds()


def folded(text: str) -> str:
    """The text without case, of the same length."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


class AliasRewriter:
    """``pairs`` (alias, word) in the order in which they apply."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = [(folded(alias), word) for alias, word in pairs]
        self.longest = max((len(a) for a, _ in self.pairs), default=0)
        self.signs = {c for a, _ in self.pairs for c in a}
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, (alias, _) in enumerate(self.pairs):
            places.setdefault(alias, []).append(i)
        for alias, at in places.items():
            self.automaton.add_word(alias, (len(alias), at))
        self.automaton.make_automaton()

    def occurrences(self, low: str) -> Iterator[tuple[int, int, list[int]]]:
        """(begin, end, numbers) of the aliases that stand between no letters."""
        for last, (size, at) in self.automaton.iter(low):
            begin, end = last + 1 - size, last + 1
            if not (begin and low[begin - 1].isalpha()) and not low[end : end + 1].isalpha():
                yield begin, end, at

    def rewrite(self, text: str | None) -> str | None:
        if not text or not self.pairs:
            return text
        low = folded(text)
        waiting: dict[int, list[int]] = {}
        for begin, _, at in self.occurrences(low):
            waiting.setdefault(at[0], []).append(begin)
        if not waiting:
            return text
        edited, turns = _Edited(text, low), list(waiting)
        heapq.heapify(turns)
        while turns:
            i = heapq.heappop(turns)
            alias, word = self.pairs[i]
            for places in _apart([p for p in (edited.standing(k, alias) for k in dict.fromkeys(waiting.pop(i))) if p]):
                shown = _MARK.sub(lambda m: "$" if m[1] == "$" else edited.cased(places), word) if "$" in word else word  # noqa: B023
                left, right = edited.replace(places, shown)
                before, behind = edited.beside(left, right, self.longest + 1, self.signs)
                put = edited.size() - len(shown)
                numbers = [*before, *range(put, put + len(shown)), *behind]
                for begin, end, at in self.occurrences("".join(map(edited.letter, numbers))):
                    # of an alias that several words have, only the next turn is noted: it leaves nothing to the others
                    if end >= len(before) and begin <= len(numbers) - len(behind) and (turn := bisect_right(at, i)) < len(at):
                        if at[turn] not in waiting:
                            heapq.heappush(turns, at[turn])
                        waiting.setdefault(at[turn], []).append(numbers[begin])
        return edited.text()


class _Edited:
    """A text under replacements that each cost what they touch, however long it is.

    Its characters have numbers, those put in go on behind its own. Each is followed by the next number
    but where ``after`` and ``before`` say otherwise; -1 stands for both ends.
    """

    def __init__(self, text: str, low: str):
        self.own, self.low, self.n = text, low, len(text)
        self.put: list[str] = []
        self.put_low: list[str] = []
        self.gone = bytearray(self.n)
        self.after, self.before = {self.n - 1: -1}, {-1: self.n - 1}

    def size(self) -> int:
        return self.n + len(self.put)

    def letter(self, k: int) -> str:
        return self.low[k] if k < self.n else self.put_low[k - self.n]

    def cased(self, places: Sequence[int]) -> str:
        return "".join(self.own[k] if k < self.n else self.put[k - self.n] for k in places)

    def standing(self, begin: int, alias: str) -> Sequence[int] | None:
        """The numbers of the alias's characters if it still begins here, between no letters."""
        if self.gone[begin]:
            return None
        end = begin + len(alias)
        if end <= self.n and self.gone.find(1, begin, end) < 0:
            if not self.low.startswith(alias, begin):
                return None
            places, follows = range(begin, end), self.after.get(end - 1, end)
        else:
            places, follows = [], begin
            for c in alias:
                if follows < 0 or self.letter(follows) != c:
                    return None
                places.append(follows)
                follows = self.after.get(follows, follows + 1)
        leads = self.before.get(begin, begin - 1)
        return None if leads >= 0 and self.letter(leads).isalpha() or follows >= 0 and self.letter(follows).isalpha() else places

    def replace(self, places: Sequence[int], shown: str) -> tuple[int, int]:
        """Puts ``shown`` in their place; the numbers of its neighbours."""
        left, right = self.before.get(places[0], places[0] - 1), self.after.get(places[-1], places[-1] + 1)
        for k in places:
            self.gone[k] = 1
        first = self.size()
        self.put.extend(shown)
        self.put_low.extend(folded(shown))
        self.gone.extend(bytes(len(shown)))
        last = self.size() - 1
        if not shown:
            first, last = right, left
        else:
            self.before[first], self.after[last] = left, right
        self.after[left], self.before[right] = first, last
        return left, right

    def beside(self, left: int, right: int, count: int, signs: set[str]) -> tuple[list[int], list[int]]:
        """Up to ``count`` numbers up to the one and from the other; a character that is none of ``signs`` is the last."""
        before, behind = [], []
        while left >= 0 and len(before) < count:
            before.append(left)
            if self.letter(left) not in signs:
                break
            left = self.before.get(left, left - 1)
        while right >= 0 and len(behind) < count:
            behind.append(right)
            if self.letter(right) not in signs:
                break
            right = self.after.get(right, right + 1)
        return before[::-1], behind

    def text(self) -> str:
        both, ends = self.own + "".join(self.put), sorted(self.after)
        parts, at = [], self.after.get(-1, 0)
        while at >= 0:
            end = ends[bisect_left(ends, at)]
            parts.append(both[at : end + 1])
            at = self.after[end]
        return "".join(parts)


def _apart(found: list[Sequence[int]]) -> list[Sequence[int]]:
    """One alias's occurrences, from the left, without those that share a character with one before."""
    begins = {places[0]: places for places in found}
    follower = {begin: next((k for k in places[1:] if k in begins), None) for begin, places in begins.items()} if len(begins) > 1 else {}
    inner = set(follower.values()) - {None}
    if not inner:
        return found
    out = []
    for begin in begins.keys() - inner:
        taken = ()
        while begin is not None:
            if begin not in taken:
                taken = begins[begin]
                out.append(taken)
            begin = follower[begin]
    return out


def alias_pairs(vocabulary: DataFrame) -> DataFrame:
    """(alias, word) of (ord, word, aliases), in the order in which they apply."""
    rows = vocabulary.filter(F.col("word").isNotNull()).select("ord", "word", F.posexplode("aliases").alias("i", "alias"))
    kept = rows.filter(~none_or_blank(F.col("alias")) & (F.lower("alias") != F.lower("word")))
    return kept.orderBy(F.desc(F.length("alias")), "ord", "i").select("alias", "word")


def replace_vocabulary(texts: DataFrame, vocabulary: DataFrame, text: str = "text", shard: int = 100_000) -> DataFrame:
    """``texts`` with the aliases in ``text`` rewritten; vocabulary (ord, word, aliases)."""
    done, pairs = F.col(text), []

    def through(done: Column, pairs: list[tuple[str, str]]) -> Column:
        @F.pandas_udf("string")
        def rewritten(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            rewriter = AliasRewriter(pairs)
            for batch in batches:
                yield pd.Series([rewriter.rewrite(t) for t in batch], dtype="object")

        return rewritten(done)

    for row in alias_pairs(vocabulary).toLocalIterator():
        pairs.append((row["alias"], row["word"]))
        if len(pairs) == shard:
            done, pairs = through(done, pairs), []
    if pairs:
        done = through(done, pairs)
    return texts.withColumn(text, done)
