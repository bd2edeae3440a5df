"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. The last adds how often the mix takes each document.

In every stage rows that agree in id and text are one document, null ids stay
ids of their own, and columns beside doc_id, text, lang and source pass through
untouched, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import shared_checkpoints, table
from colloquy.llm.decontamination import find_contamination
from colloquy.llm.language_id import identify
from colloquy.llm.line_dedup import dedup_lines
from colloquy.llm.mixing import mix_sources
from colloquy.llm.ngram_join import keep_first


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises; null texts and texts without a letter go. Equally near languages: the first in order."""
    own = docs.columns
    judged = identify(docs.withColumnsRenamed({c: f"_own_{i}" for i, c in enumerate(own) if c not in ("doc_id", "text", "lang")}))
    kept = judged.filter(~F.col("rejected"))
    return kept.select(*[F.col(c if c in ("doc_id", "text", "lang") else f"_own_{i}").alias(c) for i, c in enumerate(own)])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat; one that has nothing else left goes.

    Of equal windows the first by doc_id, then by a hash of the text, stays. Null and empty texts stay as they are; ``n_chars`` follows the text.
    """
    done = dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.regexp_like("text", F.lit(r"[^\x09-\x0D\x20]"))
    kept = done.filter(left)
    counted = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return kept.select(*[counted.get(c, F.col(c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, by doc_id, then by a hash of the text; of repeated rows one.

    Null texts and texts without words are groups of their own.
    """
    return keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; texts without words are clean."""
    judged = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies`` and the words taken.

    Which ones is decided by hashes of id and text, so reruns agree; documents without words are never taken; null sources are one source.
    """
    done = mix_sources(docs, keep=tuple(docs.columns))
    return done.filter("copies > 0").select(*docs.columns, "size", "copies", "taken", "target")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed),
]

#: The learned language model and the similarity join are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    shared_checkpoints(spark)
    # a folder for each run: an earlier result may still be read
    place = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}-{name}")
        docs = spark.read.parquet(f"{place}/{i}-{name}")
    return docs
