"""From raw documents to packed sequences: every stage works on all that the one before kept.

What holds for each stage: columns other than those of ``documents`` are dropped, whatever their names; a null text
counts as empty; nulls in lang, source and n_chars are carried along; an empty table gives an empty one. Rows
that repeat an id share its fate in the stages that drop by id (exact dedup, Jaccard join) and are judged singly
in the others; a row without an id is never dropped by id. Texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindwell.llm.decontam import decontaminate
from bindwell.llm.dedup_exact import exact_dedup
from bindwell.llm.jaccard import jaccard_join
from bindwell.llm.langid import UNKNOWN, identify, train
from bindwell.llm.packing import pack
from bindwell.llm.queries import held_out
from bindwell.llm.store import bounded, cut, fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Calibrated probability below which a text is in none of the learnt languages.
LEAST_SCORE = 0.5


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``dropped``; texts are not moved while those are few."""
    ids = bounded(cut(dropped.select(F.col("doc_id").alias("_dropped")).distinct()))
    return docs.select(COLUMNS).join(ids, F.col("doc_id") == F.col("_dropped"), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones too) or in no learnt language go; without a labelled row all do."""
    model = train(docs, ~F.coalesce(held_out(), F.lit(False)))
    judged = identify(docs, model, carry=tuple(COLUMNS[1:]))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; all rows of an id stay if one of them does."""
    judged = cut(exact_dedup(docs).select("doc_id", "kept"))
    return without(docs, judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each linked group stays; texts without words are in no group and stay."""
    return without(docs, jaccard_join(docs).where("doc_id <> component_id"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; those without words stay."""
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(COLUMNS[1:]))
    return judged.where("not contaminated").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; an empty text is one token, the end id."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language id", known_language),
    ("exact dedup", exact),
    ("n-gram jaccard join", near),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]

#: SQL can't express language identification or tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
