"""The registered queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip
from .common import table
from .decontamination import DECONTAMINATION_SQL, find_contamination
from .filter_audit import AUDIT_SQL, audit_filters
from .hard_negatives import HARD_NEGATIVES_SQL, mine
from .language_id import identify
from .line_dedup import LINE_DEDUP_SQL, dedup_lines
from .mixing import MIX_SQL, mix_sources
from .neighbours import nearest
from .ngram_join import join_similar
from .suffix_dedup import dedup_substrings
from .token_counts import count_tokens
from .toxicity import judge
from .url_filter import URL_RULES, URL_SQL, filter_urls


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    done = find_contamination(docs, benchmark)
    return done.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return done.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_token_counts": op2_token_counts, "op3_line_dedup": op3_line_dedup, "op4_decontamination": op4_decontamination, "op5_url_filters": op5_url_filters, "op6_neighbours": op6_neighbours, "op7_language_id": op7_language_id, "op8_mixing": op8_mixing, "op9_ngram_join": op9_ngram_join, "op10_suffix_dedup": op10_suffix_dedup, "op11_byte_bpe": op11_byte_bpe, "op12_filter_audit": op12_filter_audit, "op13_hard_negatives": op13_hard_negatives}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": LINE_DEDUP_SQL.format(documents="documents")
        + "SELECT l.doc_id, coalesce(len(l.lines), 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d JOIN lined l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.text IS NOT DISTINCT FROM l.text LEFT JOIN kept k ON l.k = k.k",
        "op4_decontamination": DECONTAMINATION_SQL.format(documents="documents") + "SELECT doc_id, n_words, n_hit, n_items, sha256(joined) AS items_sha256, contaminated FROM judged",
        "op5_url_filters": URL_SQL,
        "op8_mixing": MIX_SQL.format(documents="documents"),
        "op12_filter_audit": AUDIT_SQL,
        "op13_hard_negatives": HARD_NEGATIVES_SQL,
    }
