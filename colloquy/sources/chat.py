"""Chat responses in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_chat(body: Column) -> Column:
    """id, model, content (text, parts, or reasoning for want of either), refusal, finish reason, truncated and tokens."""
    at = lambda path: F.get_json_object(body, path)
    message = "$.choices[0].message"
    raw = at(f"{message}.content")
    parts = F.from_json(raw, "array<struct<type:string,text:string>>", {"mode": "PERMISSIVE"})
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    content = F.when(raw.startswith("["), joined).otherwise(raw)
    reasoning = F.coalesce(at(f"{message}.reasoning"), at(f"{message}.reasoning_content"))
    finish = at("$.choices[0].finish_reason")
    prompt, completion = at("$.usage.prompt_tokens").try_cast("long"), at("$.usage.completion_tokens").try_cast("long")
    total = F.coalesce(at("$.usage.total_tokens").try_cast("long"), prompt + completion)
    return F.struct(
        at("$.id").alias("id"),
        at("$.model").alias("model"),
        F.coalesce(F.nullif(content, F.lit("")), reasoning).alias("content"),
        at(f"{message}.refusal").alias("refusal"),
        finish.alias("finish_reason"),
        F.coalesce(F.lower(finish) == "length", F.lit(False)).alias("truncated"),
        prompt.alias("prompt"),
        completion.alias("completion"),
        total.alias("total"),
    )
