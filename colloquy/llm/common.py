"""What the training-data operators share: document keys, checkpoints, word rules."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: A word of the fixed word rule: ASCII letters and digits, and every non-ASCII character.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts that are not lower-cased yet.
CASED_NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z only, as the fixed word rule asks."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def shared_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's spark.checkpoint.dir; sets a folder only where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="colloquy-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and reads on from there."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """As ``cut``, for the rounds of a loop of joins: what is read again has the size of its files.

    A checkpoint keeps the size that was estimated for its plan, and a join's is the
    product of its sides', so its digits would treble with each round, until they fill the
    driver. Files are not compressed, lest many rows pass for few that can be broadcast.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def orderable(kind: DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def with_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``_k``, a never-null hash of id and text.

    Joins back to the documents use ``_k`` and the id together, so that two
    documents meet only if they share the id and a 64-bit hash. Rows that agree
    in both id and text are one document that was written more than once.
    """
    return docs.withColumn("_k", F.xxhash64(F.col(doc_id), F.col(text)))


def sample_ends(hashed: DataFrame, by: str, share: int) -> DataFrame:
    """(by, upto): the hash at which each group's ``share`` smallest different hashes end, for rows (by, h).

    Counts by the hash's first 16 bits find the cell, a ranking within that cell
    alone finds the end, so no group is sorted as a whole. The groups' number must
    be bounded by the caller, as their ends are broadcast.
    """
    cell = F.shiftright("h", 48)
    cells = hashed.groupBy(by, cell.alias("cell")).agg(F.countDistinct("h").alias("n"))
    before = F.sum("n").over(W.partitionBy(by).orderBy("cell")) - F.col("n")
    last = cells.withColumn("before", before).filter(F.col("before") < share).groupBy(by).agg(F.max_by(F.struct("cell", "before"), "cell").alias("last"))
    edge = hashed.join(F.broadcast(last), by).filter(cell == F.col("last.cell")).select(by, "h", "last.before").distinct()
    place = F.col("before") + F.row_number().over(W.partitionBy(by).orderBy("h"))
    return edge.withColumn("place", place).filter(F.col("place") <= share).groupBy(by).agg(F.max("h").alias("upto"))
