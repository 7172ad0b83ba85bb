"""Quality on documents that nothing was learned from."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import queries

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = queries.op1_toxicity_nnpu(spark, SF).where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    y, score, said = (np.array([r[k] for r in rows]) for k in range(3))
    rank = np.argsort(np.argsort(score))
    n, m = (y == 1).sum(), (y == 0).sum()
    auc = (rank[y == 1].sum() - n * (n - 1) / 2) / (n * m)
    assert ((score >= 0.5) == (said == 1)).all() and auc > 0.92
    assert y[said == 1].mean() > 0.9 and said[y == 1].mean() > 0.6  # labels are partly wrong


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    rows = queries.op10_crf_language_id(spark, SF).where("held_out and lang_pred <> 'und'").join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert len(rows) > 2000 and np.mean([a == b for a, b in rows]) > 0.99
