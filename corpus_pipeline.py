"""From raw documents to packed sequences, stage by stage.

Every stage but the last takes documents and returns documents: doc_id, text,
lang, source and n_chars.  Stages are written as Parquet to the shared folder
and read again before the next one starts.  Each first gives back what the
driver has freed outside its heap since the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.llm import langid, linededup, minhash, mixing, packing
from panelsmith.plans.registry import Query
from panelsmith.session import return_memory
from panelsmith.storage import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters or below the calibrated floors go.

    So null and empty texts go, and nothing stays if no row has a language to
    learn from.  Rows that repeat id or text are judged each by itself and alike.
    """
    return_memory(spark)
    docs = docs.select(*COLUMNS)
    return langid.identify(docs).filter(~F.col("rejected")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds.

    Every row stays, with an empty text if its text is null or nothing is left
    of it.  Rows that repeat an id are one document: they do not take lines from
    each other.  A row without an id keeps all its lines.
    """
    return_memory(spark)
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    return kept.select(
        "row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source",
        F.length("kept_text").cast("long").alias("n_chars"),
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that of the smallest id.

    Rows that repeat an id with different texts are documents of their own, as
    are rows without an id, which come last.  Of rows that repeat id and text
    one stays.  Texts without words are near copies of nothing.
    """
    return_memory(spark)
    return minhash.one_of_each(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of all tokens, mixed to the target weights in one epoch.

    Null languages and sources are leaves of their own; texts without tokens are
    not taken.  Rows that repeat id and text count with all their tokens, and as
    many of them are taken as the budget reaches.  Documents stay whole.
    """
    return_memory(spark)
    return mixing.mixed(docs.select(*COLUMNS), mixing.levels(), mixing.WEIGHTS, share=(4, 5))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2,048 tokens.

    Every row is a document of its own, whether its id is null or repeated; a
    null or empty text is one end id.
    """
    return_memory(spark)
    return packing.pack(docs.select(*COLUMNS)).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # predicted languages, confirmed near copies and byte-pair ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


PIPELINE = {"pipeline": Query("pipeline", run, ORACLE_SQL)}
