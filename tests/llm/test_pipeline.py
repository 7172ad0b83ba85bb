"""The queries and the pipeline over the smallest tables."""

import collections
import importlib
import re
import sys

import corpus_pipeline
import duckdb
from graphloom.llm import queries
from graphloom.llm.common import settled

SF = "/root/testdata/sf0.001"


def test_queries_agree_with_sql(spark):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = c.execute(sql)
        names = [d[0] for d in want.description]
        got = queries.QUERIES[name](spark, SF).select(*names).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())), name


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"read": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        docs = settled(stage(spark, docs, SF))
        seen[name] = docs.count()
        if name != "best-fit packing":
            assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        if name == "toxicity":
            toxic = re.compile(r"(?i)\b(idiot|scum|moron|loser)\b")
            left = sum(bool(toxic.search(r["text"])) for r in docs.collect())
            assert left <= 0.2 * sum(bool(toxic.search(r["text"])) for r in before.collect())
    assert seen["read"] > seen["toxicity"] >= 0.85 * seen["read"] and seen["language ID"] >= 0.97 * seen["toxicity"]
    assert seen["line dedup"] == seen["language ID"]
    fill = collections.Counter()
    for r in docs.collect():
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024


def test_entry_lives_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("graphloom.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "select_exact" in entry.queries() and not any(q.startswith("op") or q == "pipeline" for q in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
