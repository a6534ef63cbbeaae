"""A corpus pipeline over the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it and reads it back as the next
stage's docs. ``run`` does the same in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.llm.byte_bpe import digests, round_trip_bpe
from brandlens.llm.language_id import UND, predict_language, train_language_model
from brandlens.llm.near_duplicates import keep_one_of_each_class
from brandlens.llm.source_mix import mix_sources
from brandlens.llm.spark_files import with_checkpoint_dir
from brandlens.llm.toxicity import score_toxicity, train_toxicity_model
from brandlens.shipping import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows whose language no kernel is at least this sure of are rejected. The best of K scores is 1/K at least, so with few
#: languages this alone rejects nothing: texts in none of them are told by their unusual 3-grams and come as UND, score 0.
LEAST_LANGUAGE_SCORE = 0.1
#: Ranges of positions that the mix is written in.
MIX_FILES = 64


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay: those without letters, in none of the learned languages or of gibberish go; lang is set to the prediction."""
    ship_package(spark)
    judged = predict_language(docs, train_language_model(docs), reject_unfamiliar=True)
    kept = judged.where((F.col("lang_pred") != UND) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay; the model learns from the labels of the documents that are left."""
    ship_package(spark)
    model = train_toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("toxic_score < 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    ship_package(spark)
    return keep_one_of_each_class(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with mix_position, in its order: each file is a range of positions, and files follow each other in it."""
    ship_package(spark)
    return mix_sources(docs).repartitionByRange(MIX_FILES, "mix_position").sortWithinPartitions("mix_position").select(*COLUMNS, "mix_position")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, mix_position, ids, n_tokens and the digests of the ids and of their decoded bytes."""
    ship_package(spark)
    return digests(round_trip_bpe(docs.select("doc_id", "lang", "source", "mix_position", "text")), "lang", "source", "mix_position", "ids")


STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: Trained models decide in two stages, which SQL can't express: the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir/documents.parquet, each written as Parquet in the shared folder and read again."""
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
