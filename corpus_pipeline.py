"""A corpus pipeline of five operators: reject toxic texts, keep known languages, drop
recurring lines, keep one of each group of near duplicates, pack into sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, line_templates, near_duplicates, packing, toxicity
from graphloom.llm.common import checkpoint_root, documents
from graphloom.llm.queries import BYTE_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose toxicity score is below one half; a model learned from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(docs, labels, F.lit(True), keep=COLUMNS)
    return scored.where("score < 0.5").select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with letters whose leading language holds more than a third of the words' probability: short
    texts and texts in two languages are clean and stay."""
    found = language.label(docs, language.learn(docs, F.lit(True)), keep=COLUMNS)
    return found.where("lang_pred <> 'und' and score > 0.34").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without recurring lines, similar ones included; n_chars follows."""
    return line_templates.drop_recurring_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.one_of_each(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of docs in sequences of 1024 tokens."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("toxicity", drop_toxic), ("language ID", keep_languages), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_duplicates), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again below the shared checkpoint folder."""
    docs = documents(spark, sf_dir)
    root = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs


#: Training and byte-level encoding can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None
