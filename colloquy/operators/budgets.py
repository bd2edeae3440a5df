"""Token estimates and budgets of document generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output tokens by level of detail, and by reasoning effort.
DETAIL_TOKENS = {"Breve": 4000, "Normal": 8000, "Detallada": 12000, "Exhaustiva": 16000}
EFFORT_TOKENS = {"low": 2000, "medium": 4000, "high": 8000}
# Limits of model families by a part of their name, first match; and the limit of all others.
COMPLETION = (("claude", 8192), ("qwen", 16384), ("gpt-6", 32768), ("o1", 32768), ("o3", 32768), ("deepseek", 8192))
OTHER_COMPLETION, OTHER_CONTEXT = 16384, 128000
CONTEXT = (("claude", 200000),)


def token_estimate(text: Column, chars: float = 3.8) -> Column:
    return F.coalesce(F.ceil(F.length(text) / chars), F.lit(0)).cast("long")


def segment_chars(name: Column, speaker: Column, text: Column) -> Column:
    """Characters that a segment takes in a prompt: mark, speaker and text."""
    return 15 + F.coalesce(F.length(name), F.length(speaker), F.lit(10)) + 2 + F.coalesce(F.length(text), F.lit(0)) + 2


def _by_name(model: Column, table: tuple, other: int) -> Column:
    out = None
    for part, tokens in table:
        hit = F.contains(F.lower(model), F.lit(part))
        out = F.when(hit, tokens) if out is None else out.when(hit, tokens)
    return out.otherwise(other)


def _of(level: Column, table: dict[str, int], other: int) -> Column:
    out = None
    for name, tokens in table.items():
        out = F.when(level == name, tokens) if out is None else out.when(level == name, tokens)
    return out.otherwise(other)


def is_reasoning(model: Column) -> Column:
    m = F.lower(model)
    return F.coalesce((m == "openai/gpt-6-luna") | m.startswith("openai/o1") | m.startswith("openai/o3") | F.contains(m, F.lit("deepseek-r1")), F.lit(False))


def token_budget(model: Column, detail: Column, effort: Column, prompt_tokens: Column, explicit: Column | None = None, reasoning: Column | None = None, router: bool = False) -> Column:
    """Tokens to ask for: detail's base within the model's limit, reasoning on top, within the context.

    ``router``: any effort but none reserves, the margin is 1000 and deepseek has no limit of its own.
    """
    explicit = F.lit(None).cast("int") if explicit is None else explicit
    reasoning = F.lit(None).cast("int") if reasoning is None else reasoning
    base = F.when(explicit > 0, explicit).otherwise(_of(detail, DETAIL_TOKENS, 8000))
    capped = F.least(base, _by_name(model, COMPLETION[:-1] if router else COMPLETION, OTHER_COMPLETION))
    some_effort = F.coalesce((F.trim(effort) != "") & (F.lower(effort) != "none"), F.lit(False))
    reserves = (is_reasoning(model) | reasoning.isNotNull() | some_effort) if router else (is_reasoning(model) & some_effort)
    reserved = F.when(reasoning > 0, reasoning).when(reserves, _of(F.lower(effort), EFFORT_TOKENS, 4000)).otherwise(0)
    room = F.greatest(F.lit(2000), _by_name(model, CONTEXT, OTHER_CONTEXT) - prompt_tokens - (1000 if router else 1500))
    return F.least(capped + reserved, room)


def hierarchical(duration_us: Column, tokens: Column, detail: Column, n_segments: Column, disable: Column | None = None, force: Column | None = None) -> Column:
    """Whether a transcript is generated chunk by chunk."""
    off = F.lit(False) if disable is None else F.coalesce(disable, F.lit(False))
    on = F.lit(False) if force is None else F.coalesce(force, F.lit(False))
    rich = detail.isin("Detallada", "Exhaustiva")
    minute = 60_000_000
    large = (duration_us >= 60 * minute) | ((duration_us >= 45 * minute) & rich) | (tokens >= 12000) | ((tokens >= 8000) & rich)
    return F.when(off, False).when(on, True).when(n_segments == 0, False).otherwise(large)
