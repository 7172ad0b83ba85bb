"""The graph as it was, table functions in SQL, and statistics that are merged."""

import bisect
import random
import subprocess
import sys
from datetime import date, datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_graph import edge, graph, node

from graphloom.functions import tables
from graphloom.operators import asof, statistics
from graphloom.sources import files

T0 = datetime(2024, 1, 1)


def plain(rows, versions):
    """As-of by looking for each row among its key's versions."""
    by_key = {}
    for k, since, n, value in versions:
        if k is not None and since is not None:
            by_key.setdefault(k, []).append((since, n, value))
    out = []
    for i, k, at in rows:
        found = sorted(by_key.get(k, [])) if at is not None else []
        nth = bisect.bisect_right([f[0] for f in found], at) if found else 0
        out.append((i, k, at, *(found[nth - 1] if nth else (None, None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_asof_join_is_the_plain_one(spark, slices):
    """One hot key, ties in time, rows before all versions, nulls."""
    rng = random.Random(6)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c", None])
    at = lambda: T0 + timedelta(minutes=rng.randrange(400)) if rng.random() < 0.97 else None
    rows = [(i, key(), at()) for i in range(600)] + [(999, "never", T0)]
    versions = [(key(), at(), n, f"v{n}") for n in range(150)]
    left, right = spark.createDataFrame(rows, "i int, k string, at timestamp_ntz").repartition(4), spark.createDataFrame(versions, "k string, since timestamp_ntz, n int, value string").repartition(3)
    got = asof.asof_join(left, right, "k", "at", "since", "n", slices)
    assert got.columns == ["i", "k", "at", "since", "n", "value"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, versions)
    assert asof.asof_join(left, right.limit(0), "k", "at", "since", "n", slices).where("value is null").count() == len(rows)
    assert asof.asof_join(left.limit(0), right, "k", "at", "since", "n", slices).count() == 0
    with pytest.raises(ValueError, match="own"):
        asof.asof_join(left, right.withColumn("at", F.col("since")), "k", "at", "since")


def test_a_hot_key_is_split(spark):
    """No slice of the one key holds more than a fraction of its rows."""
    rows = spark.range(4000).select(F.lit("hot").alias("_key"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("_at"))
    cuts = asof.cuts_of(rows, 16)
    sizes = [r["n"] for r in rows.groupBy(asof.slice_of(F.col("_at"), cuts)).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 600


def test_asof_versions_is_the_first_query_of_its_session(tmp_path):
    """Column ids start at 0 in a new session, where a lambda that captures the time made the plan fail."""
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", {str(tmp_path)!r}).getOrCreate()
import __spark_entry__
__spark_entry__.queries()["asof_versions"](spark, "/root/testdata/sf0.001").write.parquet({str(tmp_path / "out")!r})
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    events = duckdb.sql("select event_id, ts, user_id, event_type, value from '/root/testdata/sf0.001/events.parquet'").fetchall()
    want = plain([(i, user, at) for i, at, user, kind, _ in events if kind != "purchase"], [(user, at, i, value) for i, at, user, kind, value in events if kind == "purchase"])
    got = duckdb.sql(f"select event_id, user_id, ts, since, version_event, balance from '{tmp_path}/out/*.parquet'").fetchall()
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("n", [0, 1, 2, 7, 63])
def test_slices_of_times(spark, n):
    """How many cuts aren't after a time, by branches; null times lie in the first slice."""
    cuts = [3 * i for i in range(n)]
    rows = spark.range(-2, 3 * n + 2).select("id", asof.slice_of(F.col("id"), [F.lit(c) for c in cuts]).alias("s")).collect()
    assert [r["s"] for r in rows] == [bisect.bisect_right(cuts, r["id"]) for r in rows]
    assert spark.range(1).select(asof.slice_of(F.lit(None).cast("long"), [F.lit(c) for c in cuts]).alias("s")).first()["s"] == 0


def test_graph_as_of(spark):
    def version(i, n, day, until=None, **more):
        row = list(node(i, **more))
        row[7], row[9], row[10] = n, T0 + timedelta(days=day), until and T0 + timedelta(days=until)  # version, updated_at, valid_until
        return tuple(row)

    g = graph(spark, [version("a", 1, 0), version("a", 2, 5), version("b", 1, 9), version("c", 1, 0, 3), version("d", 1, 0, 99), version("d", 1, 0, 99, deprecated=True)], [(*edge("a", "d")[:-1], T0)])
    rows = {r["id"]: r for r in asof.as_of(g, T0 + timedelta(days=4)).nodes.collect()}
    assert {i: r["version"] for i, r in rows.items()} == {"a": 1, "d": 1} and rows["d"]["deprecated"]
    assert {r["id"]: r["version"] for r in asof.as_of(g, T0 + timedelta(days=9)).nodes.collect()} == {"a": 2, "b": 1, "d": 1}


SOURCES = {
    "m.py": "import a.b, c\nfrom d import e\nfrom . import f\nclass K:\n    async def m(self):\n        def n(): pass\ndef top(): pass\n",
    "bad.py": "def (", "none.py": None, "deep.py": "(" * 500 + ")" * 500, "empty.py": "",
}


def test_python_symbols_in_sql_are_those_of_the_data_frame(spark):
    rows = [(p, t.encode(), "python", T0) for p, t in SOURCES.items() if t is not None]
    df = spark.createDataFrame(rows, "path string, content binary, language string, modified timestamp_ntz")
    tables.register(spark)
    df.createOrReplaceTempView("files_here")
    short = spark.sql("select path, s.* from files_here, lateral python_symbols(content) s")
    assert short.columns == ["path", "kind", "name", "nth"]
    plain_ = files.python_symbols(df).select("path", "kind", "name", "nth")
    assert sorted(map(tuple, short.where("kind <> 'class'").collect())) == sorted(map(tuple, plain_.collect()))
    long = spark.sql("select s.* from files_here, lateral python_symbols(content, true) s where path = 'm.py'").collect()
    assert {(r["kind"], r["name"], r["line"], r["inside"], r["is_async"]) for r in long} == {
        ("import", "a.b", 1, None, False), ("import", "c", 1, None, False), ("import", "d", 2, None, False), ("class", "K", 4, None, False), ("function", "m", 5, "K", True), ("function", "n", 6, "K.m", False), ("function", "top", 7, None, False),
    }
    assert spark.sql("select * from python_symbols('def f(): pass')").collect() == [("function", "f", 1)]
    assert spark.sql("select * from python_symbols(cast(null as string))").collect() == []


@pytest.mark.parametrize("call, said", [("python_symbols(1)", "reads text or bytes"), ("python_symbols('x', 'y')", "detail is a constant")])
def test_wrong_calls_fail_when_they_are_analysed(spark, call, said):
    tables.register(spark)
    with pytest.raises(Exception, match=said):
        spark.sql(f"select * from {call}")


def test_statistics_are_merged_not_recomputed(spark, tmp_path):
    rows = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("n"), F.col("id") % 3000).alias("id"), F.when(F.col("id") % 2 == 0, "DOC").otherwise("RULE").alias("type_id"), (F.col("id") % 100 / 100.0).alias("confidence"), (F.col("id") % 10 == 0).alias("deprecated"), F.lit(T0 + timedelta(days=2)).alias("created_at"))
    s = statistics.Statistics(spark, f"file://{tmp_path}/s")
    s.add(statistics.summarised(rows(0, 4000), "node", "one"))
    files_ = {p.name for p in tmp_path.rglob("*.parquet")}
    s.add(statistics.summarised(rows(2000, 6000), "node", "two"))
    s.add(statistics.summarised(rows(2000, 6000), "node", "two"))  # added again after a failure
    assert files_ <= {p.name for p in tmp_path.rglob("*.parquet")}
    report = {(r["level"], r["name"]): r for r in s.report().collect()}
    assert set(report) == {("kind+name+week", "DOC"), ("kind+name+week", "RULE"), ("kind+name", "DOC"), ("kind+name", "RULE"), ("kind+week", None), ("kind", None), ("all", None)}
    all_, doc = report["all", None], report["kind+name+week", "DOC"]
    assert all_["n"] == 8000 and all_["live"] == 7200 and doc["n"] == 4000 and doc["week"] == date(2024, 1, 1)
    assert abs(all_["distinct_keys"] - 3000) < 3000 * 0.08 and abs(doc["distinct_keys"] - 1500) < 1500 * 0.08
    assert abs(all_["quantiles"][0] - 0.5) < 0.04 and abs(all_["quantiles"][1] - 0.95) < 0.04 and abs(all_["confidence_avg"] - 0.495) < 1e-9
