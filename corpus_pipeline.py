"""The corpus pipeline: filter by language, deduplicate, decontaminate, mix and shard documents.

Each stage works on all that its predecessor kept and returns the columns of
``documents``; the last one adds each document's slot and shard.  Rows that repeat
are rows of their own until near-dedup; an empty table gives an empty one in every
stage; columns beside ``documents``' are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondera.llm import decontamination, langid, mixing, near_dup, sharding
from pondera.plans.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS, SLOTS = 64, 65537


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has a language; its prediction replaces a missing ``lang``.

    Null and empty texts and texts without a letter go.  With no ``lang`` at all there
    is nothing to learn from and to reject by: all documents stay.
    """
    model = langid.train(docs)
    if model is None:
        return docs.select(*COLUMNS)
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group.

    Rows are judged, not ids: one row of a group stays, though an id may repeat with the
    same or another text.  A row with a null id stays if its group has no other; a text without
    words is in no group, so its rows all stay.
    """
    rows = Scratch(spark, "near_dedup").keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows", compression="zstd")
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row").alias("doc_id"), "text")
    kept = near_dup.near_duplicates(named).where("kept").select("doc_id.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window of a benchmark item; null texts have none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs.select(*COLUMNS), items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as its source's target asks for; a null source is one, rows of one id are taken alike."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document by its id, or by its text where that is null; copies go to one shard."""
    return sharding.place(docs.select(*COLUMNS), shards=SHARDS, slots=SLOTS).select(*COLUMNS, "slot", "shard")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: Language ID is not expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
