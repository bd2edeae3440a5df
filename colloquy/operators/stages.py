"""Minutes in stages: notes of each chunk of a transcript, syntheses of notes as a tree, and a draft from the last one.

The model is a function from a prompt column to an answer column, so a stage is one
pass over all meetings' prompts at once. A short meeting, one chunk long, has
one stage, the full prompt. A synthesis takes as many notes, in order, as its tokens
allow, two at least; rounds go on until every meeting has one note, and as each
halves the longest list at least, there are few.

Defined results: meetings without segments have no stages; tokens are estimated where the model reports none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.minutes import prompt, transcript_line
from ..functions.times import hms
from ..sources.shared import cut
from .budgets import token_estimate
from .folds import chunk, ordered_fold

OUT = ("meeting_id", "stage", "level", "ord", "prompt", "answer", "prompt_tokens", "completion_tokens")


def first_words(asked: Column, words: int = 40) -> Column:
    """The fake model: the first words of what the prompt's last part holds."""
    last = F.element_at(F.split(asked, r"\n\n[^\n]*:\n"), -1)
    return F.array_join(F.slice(F.filter(F.split(last, r"\s+"), lambda w: w != ""), 1, words), " ")


def _asked(rows: DataFrame, stage: Column | str, model: Callable[[Column], Column]) -> DataFrame:
    """``rows`` (meeting_id, level, ord, prompt) with the stage's name, the answer and the tokens of both."""
    done = rows.withColumns({"stage": F.lit(stage) if isinstance(stage, str) else stage, "answer": model(F.col("prompt"))})
    done = done.withColumns({"prompt_tokens": token_estimate(F.col("prompt")), "completion_tokens": token_estimate(F.col("answer"))})
    return cut(done.select(*OUT))


def _packed(notes: DataFrame, most_tokens: int) -> DataFrame:
    """(meeting_id, ord, group): which notes, in order, go into one synthesis."""

    def fold(rows: list[dict]):
        out, group, tokens, held = [], 0, 0, 0
        for r in rows:
            if held >= 2 and tokens + r["completion_tokens"] > most_tokens:
                group, tokens, held = group + 1, 0, 0
            tokens, held = tokens + r["completion_tokens"], held + 1
            out.append((r["ord"], group))
        return out

    return ordered_fold(notes.select("meeting_id", "ord", "completion_tokens"), "meeting_id", ["ord"], fold, "ord long, group long")


def minutes_in_stages(meetings: DataFrame, segments: DataFrame, model: Callable[[Column], Column] = first_words, *, target_tokens: int = 5000, target_us: int = 1_500_000_000, synthesis_tokens: int = 6000, full: str = "Redacta el acta.", notes: str = "Analiza el fragmento.", synthesis: str = "Reúne las notas.", draft: str = "Redacta el acta con la síntesis.") -> DataFrame:
    """(meeting_id, stage, level, ord, prompt, answer, prompt_tokens, completion_tokens), one row a prompt.

    meetings (meeting_id, title), segments (meeting_id, ord, speaker_id,
    speaker_name, text, start_us, end_us). Stages are ``full``, or ``chunk``, ``synthesis`` (by levels) and ``draft``.
    """
    held = chunk(segments, target_tokens, target_us).select("meeting_id", "chunk", "ord")
    lines = segments.withColumn("line", transcript_line(F.col("start_us"), F.coalesce("speaker_name", F.lit("")), F.coalesce("text", F.lit("")))).select("meeting_id", "ord", "line", "start_us", "end_us")
    parts = held.join(lines, ["meeting_id", "ord"]).groupBy("meeting_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("lines"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    count = parts.groupBy("meeting_id").agg(F.count("*").alias("chunks"))
    parts = parts.join(count, "meeting_id").join(meetings.select("meeting_id", "title"), "meeting_id")
    alone = F.col("chunks") == 1
    title = F.coalesce("title", F.lit(""))
    where = F.concat(title, F.lit(" ("), hms(F.col("start_us")), F.lit(" - "), hms(F.col("end_us")), F.lit("), fragmento "), (F.col("chunk") + 1).cast("string"))
    asked = prompt(F.when(alone, full).otherwise(notes), F.when(alone, title).otherwise(where), F.transform("lines", lambda x: x["line"]))
    first = _asked(parts.select("meeting_id", F.lit(0).alias("level"), F.col("chunk").cast("long").alias("ord"), asked.alias("prompt"), "chunks"), F.when(alone, "full").otherwise("chunk"), model)
    done, left, level = [first], first.filter("stage = 'chunk'"), 0
    titles = meetings.select("meeting_id", title.alias("title"))
    # after level n a meeting has at most one note for every 2^n chunks
    while not left.isEmpty():
        level += 1
        packed = left.join(_packed(left, synthesis_tokens), ["meeting_id", "ord"])
        together = ordered_notes(packed).join(titles, "meeting_id")
        text = F.concat(F.lit(synthesis + "\n\nReunión: "), "title", F.lit("\n\nNotas:\n"), F.array_join("notes", "\n"))
        made = _asked(together.select("meeting_id", F.lit(level).alias("level"), F.col("group").alias("ord"), text.alias("prompt")), "synthesis", model)
        done.append(made)
        sizes = made.groupBy("meeting_id").agg(F.count("*").alias("n"))
        sized = made.join(sizes, "meeting_id")
        last = sized.filter("n = 1").join(titles, "meeting_id")
        text = F.concat(F.lit(draft + "\n\nReunión: "), "title", F.lit("\n\nSíntesis:\n"), "answer")
        done.append(_asked(last.select("meeting_id", F.lit(level + 1).alias("level"), F.lit(0).cast("long").alias("ord"), text.alias("prompt")), "draft", model))
        left = sized.filter("n > 1").drop("n")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ordered_notes(packed: DataFrame) -> DataFrame:
    """(meeting_id, group, notes): the answers of each group in order."""
    rows = packed.groupBy("meeting_id", "group").agg(F.array_sort(F.collect_list(F.struct("ord", "answer"))).alias("a"))
    return rows.select("meeting_id", "group", F.transform("a", lambda x: x["answer"]).alias("notes"))


def token_totals(used: DataFrame, *keys: str) -> DataFrame:
    """Sums of prompt, completion and reasoning tokens (null counts as none) and the number of stages by ``keys``."""
    return used.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt", "completion", "reasoning")], F.count("*").alias("stages"))
