"""Live meetings as stateful streams: mixing, speech sessions, utterances, segments and summary cards.

Every operator keeps its state by key in a ``StatefulProcessor`` for
``transformWithStateInPandas``; state is bounded by what a meeting has open: less
than three chunks of samples, one utterance, one segment, the segments that no
card covers yet. Rows of a key must arrive in order of ``seq``; within a
micro-batch they are sorted by it.

A model is a plain function; without weights the default is a fake that is the
same in every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import quality, text
from ..functions.cards import card_fault
from ..operators.folds import SECOND, belongs, taken_up

CHUNK, FRAME, RATE = 1600, 512, 16_000


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = [b for b in batches if len(b)]
    return pd.concat(parts).sort_values("seq", kind="stable") if parts else pd.DataFrame(columns=["seq"])


class _Keyed(StatefulProcessor):
    """One value of state for each key, as a tuple after ``SCHEMA``."""

    SCHEMA = ""
    OUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.SCHEMA)

    def close(self) -> None:
        pass

    def first(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        """The state after the rows, and what they make (without the key)."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        state = tuple(self.state.get()) if self.state.exists() else self.first()
        state, made = self.step(state, _rows(rows))
        self.state.update(state)
        names = [c.split()[0] for c in self.OUT.split(", ")]
        yield pd.DataFrame([(key[0], *m) for m in made], columns=names)


def run(rows: DataFrame, key: str, processor: StatefulProcessor, mode: str = "Append", time: str = "None") -> DataFrame:
    """``processor`` over a stream (or a table) by key; ``time`` is what its timers go by."""
    rows.sparkSession.streams.active  # over a table, too, state needs the session's streaming side begun
    return rows.groupBy(key).transformWithStateInPandas(processor, outputStructType=processor.OUT, outputMode=mode, timeMode=time)


class Mixer(_Keyed):
    """Rows (meeting_id, seq, source ``mic`` or ``sys``, samples) to mixed chunks of 1600 samples.

    A chunk goes out when both sides have one, or either has three; what is
    missing counts as silence. A row of source ``flush`` sends all whole chunks and one last, partial one.
    """

    SCHEMA = "mic binary, sys binary, n long"
    OUT = "meeting_id string, chunk long, samples array<double>, dominant string, mic_rms double, sys_rms double"

    def first(self):
        return b"", b"", 0

    def step(self, state, rows):
        mic, sys, n = _Ring(state[0]), _Ring(state[1]), state[2]
        made = []

        def ready() -> bool:
            return min(mic.n, sys.n) >= CHUNK or max(mic.n, sys.n) >= 3 * CHUNK

        def send() -> None:
            nonlocal n
            a, b = mic.take(CHUNK), sys.take(CHUNK)
            both = a + b
            loud = np.abs(both) > 0.90
            if loud.any():
                both = np.where(loud, np.sign(both) * (0.90 + 0.10 * np.tanh((np.abs(both) - 0.90) / 0.10)), both)
            both = np.clip(both, -1, 1)
            left, right = np.sqrt((a * a).mean()), np.sqrt((b * b).mean())
            made.append((n, both, "mic" if left >= right else "sys", float(left), float(right)))
            n += 1

        for source, samples in zip(rows["source"], rows["samples"]) if len(rows) else ():
            if source != "flush":
                (mic if source == "mic" else sys).put(samples)
            while ready():
                send()
            if source == "flush" and (mic.n or sys.n):
                send()
        return (mic.packed(), sys.packed(), n), made


class MixedLevels(Mixer):
    """The same mixed chunks without their samples, for readers of levels: an array of a chunk costs more on its way to the JVM than its mixing."""

    OUT = "meeting_id string, chunk long, dominant string, mic_rms double, sys_rms double"

    def step(self, state, rows):
        state, made = super().step(state, rows)
        return state, [(n, *levels) for n, _, *levels in made]


class _Ring:
    """Samples that wait, as blocks; packed as bytes in state."""

    def __init__(self, packed: bytes):
        self.blocks, self.n = [], 0
        self.put(np.frombuffer(bytes(packed), "<f8"))

    def put(self, samples) -> None:
        block = np.asarray(samples, "<f8")
        if len(block):
            self.blocks.append(block)
            self.n += len(block)

    def take(self, size: int) -> np.ndarray:
        """The first samples; what is missing is silence."""
        out, at = np.zeros(size), 0
        while self.blocks and at < size:
            part = self.blocks[0][: size - at]
            out[at : at + len(part)] = part
            at += len(part)
            rest = self.blocks[0][len(part) :]
            self.blocks[:1] = [rest] if len(rest) else []
        self.n -= at
        return out

    def packed(self) -> bytes:
        return np.concatenate(self.blocks).tobytes() if self.blocks else b""


class SpeechSessions(_Keyed):
    """Frames (meeting_id, seq, prob) to events: speech starts at 0.50 and ends after 1.3 s below 0.35; between the two nothing changes."""

    SCHEMA = "speaking boolean, quiet_since long, sample long"
    OUT = "meeting_id string, event string, sample long, prob double"
    SILENCE = int(1.3 * RATE)

    def first(self):
        return False, 0, 0

    def step(self, state, rows):
        speaking, quiet, at = state
        made = []
        for r in rows.itertuples():
            at += FRAME
            if r.prob >= 0.50:
                quiet = 0
                if not speaking:
                    speaking = True
                    made.append(("start", at, float(r.prob)))
            elif r.prob < 0.35 and speaking:
                quiet = quiet or at
                if at - quiet >= self.SILENCE:
                    speaking, quiet = False, 0
                    made.append(("end", at, float(r.prob)))
        return (speaking, quiet, at), made


class Utterances(_Keyed):
    """Chunks (meeting_id, seq, n_samples, rms, mic_rms, sys_rms, event) to utterances.

    An utterance holds up to 200 ms from before its ``start``, is cut at 15 s and
    goes out at its ``end`` if it lasts 250 ms and is louder than 0.003. It is the
    microphone's alone if the system is silent (below 0.005) and the microphone is not (0.012).
    """

    SCHEMA = "speaking boolean, start long, total long, held array<struct<n:long,square:double>>, n long, square double, mic double, sys double, weighed long"
    OUT = "meeting_id string, start_us long, end_us long, n_samples long, rms double, mic_only boolean"
    BEFORE, LONGEST = int(0.2 * RATE), 15 * RATE

    def first(self):
        return False, 0, 0, [], 0, 0.0, 0.0, 0.0, 0

    def step(self, state, rows):
        speaking, start, total, held, n, square, mic, sys, weighed = state
        held = [(h[0], h[1]) for h in held]
        made = []

        def flush(end: int) -> None:
            nonlocal n, square, mic, sys, weighed
            if n:
                rms = (square / n) ** 0.5
                only = sys / max(weighed, 1) < 0.005 and mic / max(weighed, 1) >= 0.012
                stop = end if end > start else start + n
                if n / RATE >= 0.25 and rms >= 0.003:
                    made.append((start * SECOND // RATE, stop * SECOND // RATE, n, rms, only))
            n, square, mic, sys, weighed = 0, 0.0, 0.0, 0.0, 0

        for r in rows.itertuples():
            size, energy = int(r.n_samples), float(r.rms) ** 2 * int(r.n_samples)
            if r.event == "start" and not speaking:
                speaking, start = True, max(0, total - sum(h[0] for h in held))
                n, square, held = sum(h[0] for h in held), sum(h[1] for h in held), []
            elif r.event == "end" and speaking:
                flush(total + size)
                speaking = False
            if speaking:
                n, square, weighed = n + size, square + energy, weighed + size
                mic, sys = mic + float(r.mic_rms) * size, sys + float(r.sys_rms) * size
                if n >= self.LONGEST:
                    flush(total + size)
                    start = total + size
            else:
                held.append((size, energy))
                while sum(h[0] for h in held) > self.BEFORE:
                    held.pop(0)
            total += size
        return (speaking, start, total, held, n, square, mic, sys, weighed), made


def clean_live(segments: DataFrame, vocabulary: list[tuple[str, str]]) -> DataFrame:
    """Live segments without bursts, spilled glossaries and imagined phrases, aliases rewritten, speakers blank. Stateless."""
    official = F.array(*[F.lit(w) for w in dict.fromkeys(w for _, w in vocabulary)]) if vocabulary else F.array().cast("array<string>")
    seconds = (F.col("end_us") - F.col("start_us")) / SECOND
    kept = segments.filter(~quality.live_anomaly(F.col("text"), seconds, official))
    kept = kept.withColumn("text", text.sanitize_asr(F.col("text"))).filter(F.col("text") != "")
    return kept.withColumns({"text": text.replace_aliases(F.col("text"), vocabulary), "speaker_id": F.lit(""), "speaker_name": F.lit("")})


class Transcript(_Keyed):
    """Segments (meeting_id, seq, seg_id, speaker_id, speaker_name, text, start_us, end_us) to changes of the transcript.

    A segment that goes on with the last one updates it (``updated``), else it is
    appended. A speaker whose name a participant has already becomes that
    participant, now and for all later segments.
    """

    SCHEMA = "seg_id string, speaker_id string, text string, start_us long, end_us long, people array<struct<id:string,name:string>>, aliases array<struct<id:string,target:string>>"
    OUT = "meeting_id string, change string, seg_id string, speaker_id string, speaker_name string, text string, start_us long, end_us long"

    def first(self):
        return None, None, None, None, None, [], []

    def step(self, state, rows):
        seg_id, speaker, said, start, end, people, aliases = state
        last = None if said is None else {"seg_id": seg_id, "speaker_id": speaker, "text": said, "start_us": start, "end_us": end}
        names, links = [(p[0], p[1]) for p in people], {a[0].lower(): a[1] for a in aliases}
        made = []
        for r in rows.itertuples():
            own, shown = ((x or "").strip() if isinstance(x, str) else "" for x in (r.speaker_id, r.speaker_name))
            if own:
                seen = set()
                while own.lower() in links and own.lower() not in seen:
                    seen.add(own.lower())
                    own = links[own.lower()]
                known = next((p for p in names if p[0].lower() == own.lower() or (shown and p[1].lower() == shown.lower())), None)
                if known is None:
                    known = (own, shown or own)
                    names.append(known)
                elif known[0].lower() != own.lower():
                    links[own.lower()] = known[0]
                own, shown = known
            else:
                shown = ""
            row = {"seg_id": r.seg_id, "speaker_id": own, "text": r.text, "start_us": int(r.start_us), "end_us": int(r.end_us)}
            change = "updated" if last is not None and belongs(last, row) else "appended"
            last = taken_up(last, row) if change == "updated" else row
            made.append((change, last["seg_id"], own, shown, last["text"], last["start_us"], last["end_us"]))
        held = (None,) * 5 if last is None else (last["seg_id"], last["speaker_id"], last["text"], last["start_us"], last["end_us"])
        return (*held, names, list(links.items())), made


def first_words(window: str, attempt: int) -> str:
    """The fake summary model: the window's first thirty words as a sentence."""
    return " ".join(window.split()[:30]).rstrip(".,;:") + "."


class Cards(_Keyed):
    """Segments (meeting_id, seq, seg_id, text, start_us, end_us) to summary cards; a row of seg_id ``stop`` finishes a meeting.

    Segments are put in by id (the last with that id is replaced). A card is tried
    when its time has come (45 s for the first, then 60 s, by segment ends), and
    the segments that end after the last card have 25 words, 8 of them different;
    at the stop 10 and 4 are enough. ``model`` is asked again once if ``check``
    (a reason against a card, or None) finds a repetition; a card that fails
    leaves its segments for the next one.
    """

    SCHEMA = "segments array<struct<id:string,text:string,start_us:long,end_us:long>>, last_end long, last_card long, n long, previous string"
    OUT = "meeting_id string, card long, start_us long, end_us long, text string"
    AGAIN = ("RepeatedSentence", "DegenerativeLoop")

    def __init__(self, model: Callable[[str, int], str] = first_words, check: Callable[[str, str, str | None, int, int, int], str | None] = card_fault):
        self.model, self.check = model, check

    def first(self):
        return [], 0, 0, 0, None

    def step(self, state, rows):
        segments, last_end, last_card, n, previous = [tuple(s) for s in state[0]], *state[1:]
        made = []

        def attempt(now: int, words: int, different: int) -> None:
            nonlocal last_end, last_card, n, previous, segments
            said = [w for s in segments for w in (s[1] or "").split()]
            if not segments or len(said) < words or len({w.lower() for w in said if len(w) >= 2}) < different:
                return
            window, end = " ".join(s[1] for s in segments), segments[-1][3]
            for again in range(2):
                card = self.model(window, again)
                fault = self.check(card, window, previous, last_end, end, last_end)
                if fault is None:
                    made.append((n, last_end, end, card.strip()))
                    last_end, last_card, n, previous = end, now, n + 1, card
                    segments = [s for s in segments if s[3] > last_end]
                    return
                if fault not in self.AGAIN:
                    return

        for r in rows.itertuples():
            if r.seg_id == "stop":
                attempt(last_card, 10, 4)
                continue
            if not isinstance(r.text, str) or not r.text.strip():
                continue
            row = (r.seg_id, r.text, int(r.start_us), int(r.end_us))
            same = [i for i, s in enumerate(segments) if s[0] == row[0]]
            if same:
                segments[same[-1]] = row
            elif row[3] > last_end:  # what ended before the last card is never summarised
                segments.append(row)
            if row[3] - last_card >= (60 if n else 45) * SECOND:
                attempt(row[3], 25, 8)
        return (segments, last_end, last_card, n, previous), made


class TimedCards(Cards):
    """``Cards`` that are tried by the clock, too: every ``tick_us`` from a meeting's start, whether or not a segment comes.

    Over a table the clock is where a segment ends. On a stream with
    ``wall=True`` and processing-time timers it is the time since the meeting's first
    row, and a meeting without rows for ``idle_us`` is finished: what is left makes a
    last card under the rule of the stop, and the state goes. A card is asked for
    when it is tried and there ``latency_us`` later; until then nothing else is
    tried. A row of seg_id ``start`` begins a new session: segments, cards and
    what was asked for are forgotten, so a card of the old session never comes.
    """

    SCHEMA = Cards.SCHEMA + ", clock long, due long, asked long, upto long, window string, began long, heard long"

    def __init__(self, model=first_words, check=card_fault, *, first_us: int = 45 * SECOND, then_us: int = 60 * SECOND, tick_us: int = 5 * SECOND, latency_us: int = 0, wall: bool = False, idle_us: int = 300 * SECOND):
        super().__init__(model, check)
        self.first_us, self.then_us, self.tick_us, self.latency_us, self.wall, self.idle_us = first_us, then_us, tick_us, latency_us, wall, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def first(self):
        return *super().first(), 0, None, None, None, None, None, None

    def step(self, state, rows):
        m = _Meeting(self, state)
        for r in rows.itertuples():
            if r.seg_id == "start":
                m.restart()
            elif r.seg_id == "stop":
                m.finish()
            elif isinstance(r.text, str) and r.text.strip():
                if not self.wall:
                    m.advance(int(r.end_us))
                m.put((r.seg_id, r.text, int(r.start_us), int(r.end_us)))
                m.attempt(m.clock)
                m.settle(m.clock)
        return m.state(), m.made

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        if not self.wall:
            yield from super().handleInputRows(key, rows, timerValues)
            return
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        yield self._live(key, now, lambda m: self.step(m.state(), _rows(rows)), heard=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        yield self._live(key, timerValues.getCurrentProcessingTimeInMs() * 1000, None, heard=False)

    def _live(self, key, now: int, more, heard: bool) -> pd.DataFrame:
        """What the clock has brought and what the rows bring; sets the next timer, or ends a meeting that has become silent."""
        m = _Meeting(self, tuple(self.state.get()) if self.state.exists() else self.first())
        m.began = now if m.began is None else m.began
        m.heard = now if heard or m.heard is None else m.heard
        m.advance(now - m.began)
        made = m.made
        if more is not None:
            state, rest = more(m)
            m, made = _Meeting(self, state), made + rest
        over = now - m.heard >= self.idle_us
        if over:
            m.finish()
            made = made + m.made
            self.state.clear()
        else:
            self.state.update(m.state())
        for timer in [t[0] if isinstance(t, (list, tuple)) else t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if not over:
            self.handle.registerTimer((now + self.tick_us) // 1000)
        return pd.DataFrame([(key[0], *x) for x in made], columns=[c.split()[0] for c in self.OUT.split(", ")])


class _Meeting:
    """One meeting's segments and cards while rows and ticks are handled."""

    def __init__(self, rules: TimedCards, state: tuple):
        self.rules, self.made = rules, []
        self.segments = [tuple(s) for s in state[0]]
        self.last_end, self.last_card, self.n, self.previous = state[1:5]
        self.clock, self.due, self.asked, self.upto, self.window, self.began, self.heard = state[5:]

    def state(self) -> tuple:
        return self.segments, self.last_end, self.last_card, self.n, self.previous, self.clock, self.due, self.asked, self.upto, self.window, self.began, self.heard

    def restart(self) -> None:
        self.segments, self.last_end, self.last_card, self.n, self.previous = [], 0, 0, 0, None
        self.clock, self.due, self.asked, self.upto, self.window = 0, None, None, None, None

    def put(self, row: tuple) -> None:
        same = [i for i, s in enumerate(self.segments) if s[0] == row[0]]
        if same:
            self.segments[same[-1]] = row
        elif row[3] > self.last_end:  # what ended before the last card is never summarised
            self.segments.append(row)

    def advance(self, now: int) -> None:
        """All ticks up to now; those at which nothing can have changed are skipped."""
        tick = self.rules.tick_us
        while True:
            ready = max(self.due or 0, self.last_card + (self.rules.then_us if self.n else self.rules.first_us), self.clock + 1)
            at = -(-ready // tick) * tick
            if at > now or not (self.segments or self.due is not None):
                break
            self.clock = at
            self.settle(at)
            self.attempt(at)
        self.settle(now)
        self.clock = max(self.clock, now)

    def _enough(self, words: int, different: int) -> bool:
        said = [w for s in self.segments for w in (s[1] or "").split()]
        return len(said) >= words and len({w.lower() for w in said if len(w) >= 2}) >= different

    def attempt(self, now: int, words: int = 25, different: int = 8, forced: bool = False) -> None:
        if self.due is not None or not self.segments or not self._enough(words, different):
            return
        if forced or now - self.last_card >= (self.rules.then_us if self.n else self.rules.first_us):
            self.window, self.upto = " ".join(s[1] for s in self.segments), max(s[3] for s in self.segments)
            self.asked, self.due = now, now + self.rules.latency_us

    def settle(self, now: int) -> None:
        """Takes the card that was asked for, if it is there by now."""
        if self.due is None or self.due > now:
            return
        for again in range(2):
            card = self.rules.model(self.window, again)
            fault = self.rules.check(card, self.window, self.previous, self.last_end, self.upto, self.last_end)
            if fault is None:
                self.made.append((self.n, self.last_end, self.upto, card.strip()))
                self.last_end, self.last_card, self.n, self.previous = self.upto, self.asked, self.n + 1, card
                self.segments = [s for s in self.segments if s[3] > self.last_end]
                break
            if fault not in self.rules.AGAIN:
                break
        self.due = self.asked = self.upto = self.window = None

    def finish(self) -> None:
        self.settle(self.due or 0)
        self.attempt(self.clock, 10, 4, forced=True)
        self.settle(self.due or 0)


class Segments(StatefulProcessor):
    """Rows (meeting_id, seq, seg_id, text, start_us, end_us) to changes: the segment with that id is updated, else one is appended.

    Each segment is an entry of its own in a map in state, so an update reads and
    writes one segment, however many the meeting has; within a micro-batch each segment is
    read and written once, however often it changes. ``version`` counts a segment's changes.
    """

    OUT = "meeting_id string, seq long, seg_id string, change string, version long, text string, start_us long, end_us long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.segments = handle.getMapState("segments", "seg_id string", "version long, text string, start_us long, end_us long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        rows = _rows(rows)
        seen, held, made, changed = self.segments.exists(), {}, [], {}
        for seq, seg_id, text, start, end in zip(*(rows[c].tolist() for c in ("seq", "seg_id", "text", "start_us", "end_us"))) if len(rows) else ():
            if seg_id not in held:
                held[seg_id] = self.segments.getValue((seg_id,))[0] if seen and self.segments.containsKey((seg_id,)) else -1
            known = held[seg_id]
            held[seg_id] = known + 1
            changed[seg_id] = row = (known + 1, text, int(start), int(end))
            made.append((key[0], int(seq), seg_id, "updated" if known >= 0 else "appended", *row))
        for seg_id, row in changed.items():
            self.segments.updateValue((seg_id,), row)
        yield pd.DataFrame(made, columns=[c.split()[0] for c in self.OUT.split(", ")])


class Arrivals(StatefulProcessor):
    """Rows (meeting_id, seq, seg_id, end_us) with ``late``: whether a segment ends more than ``delay_us`` before the latest end so far.

    State is one number a meeting. On a stream with a watermark and event-time
    timers it goes once the watermark has passed ``forget_us`` beyond that end; rows
    older than the watermark itself are dropped, and counted, by Spark.
    """

    OUT = "meeting_id string, seq long, seg_id string, end_us long, late boolean"

    def __init__(self, delay_us: int = 10 * SECOND, forget_us: int | None = None):
        self.delay_us, self.forget_us = delay_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.newest = handle, handle.getValueState("newest", "end_us long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        newest = self.newest.get()[0] if self.newest.exists() else None
        made = []
        for r in _rows(rows).itertuples():
            end = int(r.end_us)
            made.append((key[0], int(r.seq), r.seg_id, end, newest is not None and end < newest - self.delay_us))
            newest = end if newest is None else max(newest, end)
        self.newest.update((newest,))
        if self.forget_us is not None:
            for timer in [t[0] if isinstance(t, (list, tuple)) else t for t in self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((newest + self.forget_us) // 1000)
        yield pd.DataFrame(made, columns=[c.split()[0] for c in self.OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        self.newest.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in self.OUT.split(", ")])


def on_time(arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What came in time, and the side output of what came too late."""
    return arrivals.filter(~F.col("late")), arrivals.filter("late")


def latest(segments: DataFrame, key: Column, order: Column) -> DataFrame:
    """The last row of each key: upserts by id within a micro-batch or a table."""
    rows = F.struct(*segments.columns)
    return segments.groupBy(key.alias("_key")).agg(F.max_by(rows, order).alias("_row")).select("_row.*")
