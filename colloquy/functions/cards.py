"""The checks of ``quality.validate_card`` for one card, for operators that keep state and see cards one by one."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from .words import PREAMBLES, STOP_WORDS

_STOP = frozenset(STOP_WORDS)


def _letters(text: str, other: str) -> str:
    """Without what is no letter, digit or white space; ``other`` stands for it."""
    return "".join(c if c.isalpha() or c.isdecimal() or c.isspace() else other for c in text)


def _sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, re.split(r"(?<=[.!?])\s+|\n+", text)) if s]


def _normal(sentence: str) -> str:
    clean = " ".join(_letters(sentence.strip().lower(), " ").split())
    begins = [p for p in PREAMBLES if clean.startswith(p)]
    return clean[len(begins[0]) :].strip() if begins else clean


def _content(text: str) -> set[str]:
    return {w for w in _letters(text.lower(), " ").split() if len(w) >= 4 and w not in _STOP}


def _overlap_words(words: Iterable[str]) -> set[str]:
    return {w for w in (_letters(x.lower(), "") for x in words) if len(w) >= 3 and w not in _STOP}


def _jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _looped(low: list[str]) -> bool:
    fours = Counter(zip(low, low[1:], low[2:], low[3:]))
    return max(fours.values(), default=0) >= 3 or any(low[i : i + 2] == low[i + 2 : i + 4] == low[i + 4 : i + 6] for i in range(0, len(low) - 5, 2))


def _dominated(parts: list[str], n_words: int) -> bool:
    """Whether sentences that say the same make up two fifths of the words."""
    long = [(len(s.split()), _overlap_words(s.split())) for s in parts if len(s.split()) >= 6]
    for n, own in long:
        alike = sum(_jaccard(own, other) >= 0.70 for _, other in long) - bool(own)
        if alike >= 1 and n * (alike + 1) >= n_words * 0.40:
            return True
    return False


def card_fault(card: str | None, window: str | None, previous: str | None, start_us: int, end_us: int, summarized_us: int) -> str | None:
    """The first reason against a summary card, None if it is good."""
    if end_us <= start_us or end_us <= summarized_us:
        return "InvalidTimeRange"
    card, low, parts = card or "", (card or "").lower().split(), _sentences(card or "")
    if len(card.strip()) < 12 or len(low) < 4:
        return "EmptyOrTooShort"
    normal = [s for s in map(_normal, parts) if len(s) >= 10 and len(s.split()) >= 3]
    if len(set(normal)) < len(normal):
        return "RepeatedSentence"
    if _looped(low):
        return "DegenerativeLoop"
    if len(low) >= 25 and len(parts) >= 2 and _dominated(parts, len(low)):
        return "SentenceDominance"
    if len(low) > 95 or len(card) > 650:
        return "ExcessiveLength"
    before = (previous or "").split()
    if len(before) >= 8 and _jaccard(_overlap_words(low), _overlap_words(before)) >= 0.82:
        return "DuplicateOfPreviousCard"
    mine, theirs = _content(card), _content(window or "")
    stems = {w[:5] for w in theirs if len(w) >= 5}
    if len(mine) >= 5 and len(theirs) >= 5 and not any(w in theirs or (len(w) >= 5 and w[:5] in stems) for w in mine):
        return "SemanticDisconnect"
    return None
