"""Findings of round 3: queries do the whole job, on as many machines as there are."""

import pytest  # noqa: F401
from pyspark.sql import functions as F  # noqa: F401

from graphloom import store_queries  # noqa: F401 (registers its queries)
from graphloom.functions import vector
from graphloom.queries import ORACLE_SQL, QUERIES, project
from graphloom.sources import files, transcripts

SF = "/root/testdata/sf0.001"


def test_vector_index_finds_as_many_as_the_ranking(spark):
    """the index' answer is as long as that of the search which ranks all vectors."""
    told = [tuple(r) for r in QUERIES["vector_index"](spark, SF).collect()]
    assert len(told) == 25 and sorted(told) == sorted(tuple(r) for r in QUERIES["ann_top_k"](spark, SF).collect())
    assert ORACLE_SQL["vector_index"] == ORACLE_SQL["ann_top_k"]


def test_python_texts_are_parsed_by_all_cores(spark, tmp_path):
    """F2, F7, F8: parts of one row group are dealt to more tasks than read them, each to one."""
    parts = spark.range(400).select(F.col("id").alias("p_partkey")).coalesce(1)
    parts.write.parquet(f"{tmp_path}/part.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    for made in (project(spark, str(tmp_path)).where("language = 'python'"), QUERIES["python_symbols_lateral"](spark, str(tmp_path))):
        rows = made.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(rows) >= 2 * cores and max(r["count"] for r in rows) < sum(r["count"] for r in rows) / cores
    assert QUERIES["python_symbols_lateral"](spark, str(tmp_path)).select("p_partkey").distinct().count() == 240


def test_table_function_makes_no_table_for_each_row(spark):
    """rows of a lateral join reach Python in batches."""
    made = QUERIES["python_symbols_lateral"](spark, SF)
    assert "BatchEvalPythonUDTF" in made._jdf.queryExecution().executedPlan().toString()


def test_endings_are_dealt_over_all_cores(spark):
    """the endings of all paths are grouped by more tasks than there are cores, without those that name no module."""
    n = 3000
    found = spark.range(n).select(F.concat(F.lit("pkg/module"), "id", F.lit(".py")).alias("path"), F.lit("python").alias("language"))
    symbols = spark.range(n).select(F.lit("a.py").alias("path"), F.lit("import").alias("kind"), F.concat(F.lit("x.ule"), "id").alias("name"))
    made = files.imports(symbols, found)
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert "hashpartitioning(ending" in (plan := made._jdf.queryExecution().executedPlan().toString()) and f", {tasks}), REPARTITION_BY_NUM" in plan
    assert sorted(r["target"] for r in made.collect()) == sorted(f"file:pkg/module{i}.py" for i in range(n))


def test_a_walk_reads_its_files_once(spark):
    """one scan of the files, which were written by all cores."""
    made = QUERIES["directory_walk"](spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and "Join" not in plan


def test_transcripts_are_read_once(spark, tmp_path):
    """one scan of the transcripts gives what the two summaries give; a kind without text counts for the context."""
    (tmp_path / "a").write_text('{"type":"user","message":{"content":"one"}}\n{"type":"assistant","message":{"content":"","usage":{"input_tokens":30}}}\n{"message":{"content":"x","usage":{"input_tokens":60}}}\n{"type":"user","message":{"content":"two"}}\n')
    (tmp_path / "b").write_text('{"type":"user","message":{"content":"three"}}\n')
    m = transcripts.read_messages(spark, str(tmp_path))
    both = transcripts.last_messages(m).join(transcripts.context_in_use(m, 100), "file").select("kind", "text", "percent")
    told = transcripts.last_messages_in_context(m, 100).select("kind", "text", "percent")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, both.collect())) == [("user", "three", 0), ("user", "two", 60)]
    plan = QUERIES["transcript_messages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_names_are_compared_only_where_places_are_equal(spark):
    """of equal places the smaller id is older, a later place never is."""
    rows = [("b", 1, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("c", 0, [1.0, 0.0]), ("d", 2, [1.0, 0.0])]
    near = vector.nearest_older(spark.createDataFrame(rows, "id string, seq long, embedding array<float>"), 3, 0.5)
    assert {(r["id"], r["older"]) for r in near.collect()} == {("b", "a"), ("b", "c"), ("a", "c"), ("d", "a"), ("d", "b"), ("d", "c")}
