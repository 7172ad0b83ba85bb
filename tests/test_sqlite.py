"""Graph tables in SQLite files: round trips, foreign files, pushed filters, commits."""

import json
import os
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, Not, StringStartsWith

from graphloom.model import CONTENT_COLUMNS, EDGE_COLUMNS, NODE_COLUMNS, UNCERTAINTY_COLUMNS
from graphloom.sources import sqlite

AT = datetime(2024, 3, 1, 12, 30, 0, 250)
NODES = [(f"n{i}", "DOC" if i % 3 else "RULE", f"label 'n{i}'", [0.5, -1.25] if i % 2 else None, json.dumps({"i": i}), None, i / 20, 1, AT, AT, AT if i == 4 else None, i % 5 == 0, "p") for i in range(20)]


@pytest.fixture()
def nodes(spark):
    return spark.createDataFrame(NODES, NODE_COLUMNS)


def key(rows):
    return sorted(map(tuple, rows))


def test_round_trip(spark, nodes, tmp_path):
    sqlite.write(nodes.repartition(3), f"file://{tmp_path}")
    assert key(sqlite.read(spark, str(tmp_path)).collect()) == key(NODES)
    contents = [("c", "binary", b"\0\xff", "h", "utf-8", None, AT, ["x", "y"])]
    sqlite.write(spark.createDataFrame(contents, CONTENT_COLUMNS), str(tmp_path), "contents")
    assert [tuple(r) for r in sqlite.read(spark, str(tmp_path), "contents").collect()] == contents
    doubt = [("n1", 0.5, 0.25, 1.0, ["a"], AT)]
    sqlite.write(spark.createDataFrame(doubt, UNCERTAINTY_COLUMNS), str(tmp_path), "uncertainty")
    assert [tuple(r) for r in sqlite.read(spark, str(tmp_path), "uncertainty").collect()] == doubt
    assert sqlite.read(spark, str(tmp_path)).count() == 20  # a table's rows alone
    sqlite.write(nodes.where("id = 'n1'"), str(tmp_path), mode="overwrite")
    assert sqlite.read(spark, str(tmp_path)).select("id").collect() == [("n1",)] and sqlite.read(spark, str(tmp_path), "contents").count() == 1
    assert sqlite.read(spark, str(tmp_path), "assertions").count() == 0


def test_rows_lack_columns_and_tables_are_empty(spark, tmp_path):
    sqlite.write(spark.createDataFrame([("e", "a", "b", "IMPORTS", 1.0, 0.9, True, 1, False, "p", AT)], EDGE_COLUMNS.replace("valid_until timestamp_ntz, ", "")), str(tmp_path), "edges")
    assert sqlite.read(spark, str(tmp_path), "edges").select("id", "valid_until", "directional").collect() == [("e", None, True)]
    sqlite.write(spark.createDataFrame([], NODE_COLUMNS), str(tmp_path))
    assert sqlite.read(spark, str(tmp_path)).count() == 0


def foreign(path, rows=300):
    """A file as another program makes it, with values that ours doesn't write."""
    c = sqlite3.connect(path)
    c.execute("pragma journal_mode = wal")
    c.executescript(sqlite.DDL)
    for i in range(rows):
        values = (f"m{i}", "DOC" if i < 200 else "RULE", "x", b"" if i % 2 else b"\0\0\x80?", "{}", None, 0.9, 1, "2024-03-01T12:00:00+02:00" if i else "soon", "2024-03-01T12:00:00", None, int(i % 7 == 0), "p")
        c.execute(f"insert into nodes values ({', '.join('?' * 13)})", values)
    c.execute("insert into uncertainty values ('m1', 0.5, 0.5, 0.5, 'no list', '2024-01-01')")
    c.execute("insert into assertions values ('a', 'claim', '[\"m1\", 2]', 0.5, '2024-01-01', null)")
    c.commit()
    c.close()


def test_foreign_file(spark, tmp_path):
    path = f"{tmp_path}/graph.db"
    foreign(path)
    rows = {r["id"]: r for r in sqlite.read(spark, path, rows=37).collect()}
    assert len(rows) == 300 and rows["m0"]["created_at"] is None and rows["m2"]["created_at"] == datetime(2024, 3, 1, 10) and rows["m2"]["embedding"] == [1.0] and rows["m1"]["embedding"] is None
    assert sqlite.read(spark, path, "uncertainty").collect()[0]["contradiction_set"] == [] and sqlite.read(spark, path, "assertions").collect()[0]["source_node_ids"] == ["m1", "2"]
    live = sqlite.selected(spark, path, "nodes", "type_id = 'RULE' and not deprecated", 37)
    assert live.count() == sum(i % 7 > 0 for i in range(200, 300)) and live.rdd.getNumPartitions() == 3  # of nine ranges
    c = sqlite3.connect(f"{tmp_path}/other.db")
    c.execute("create table x (y)")
    c.close()
    assert sqlite.read(spark, str(tmp_path)).count() == 300


def test_filters_reach_the_source(spark, nodes, tmp_path):
    for kind in ("RULE", "DOC"):
        sqlite.write(nodes.where(F.col("type_id") == kind).coalesce(1), str(tmp_path))
    r = sqlite.FilteringReader("nodes", str(tmp_path), 4)
    left = [StringStartsWith(("label",), "x"), EqualTo(("embedding",), [1.0]), EqualTo(("confidence",), float("nan"))]
    assert list(r.pushFilters([EqualTo(("type_id",), "RULE"), Not(EqualTo(("deprecated",), True)), GreaterThanOrEqual(("confidence",), 0.2), In(("version",), (1, 2)), *left])) == left
    rows = [x for p in r.partitions() for b in r.read(p) for x in b.column(0).to_pylist()]
    assert sorted(rows) == sorted(n[0] for n in NODES if n[1] == "RULE" and not n[11] and n[6] >= 0.2)
    ranges = r.partitions()
    assert {os.path.basename(p.path) for p in ranges} == {n for n, x in sqlite.manifest(str(tmp_path))["files"].items() if x["types"] == ["RULE"]} and len(ranges) == 2  # the other file isn't opened
    none = sqlite.FilteringReader("nodes", str(tmp_path), 4)
    assert list(none.pushFilters([EqualTo(("type_id",), "METRIC")])) == [] and [list(none.read(p)) for p in none.partitions()] == [[]]


def test_two_filters_on_one_selection(spark, nodes, tmp_path):
    """Plans over one relation don't take each other's filters, and the session's setting stays."""
    sqlite.write(nodes, str(tmp_path))
    docs = sqlite.selected(spark, str(tmp_path), "nodes", F.col("type_id") == "DOC")
    assert spark.conf.get(sqlite.PUSHDOWN, "false") == "false"
    n = docs.count()
    both = docs.where("id = 'n1'").union(docs.where("id = 'n2'")).select("id").collect()
    assert sorted(both) == [("n1",), ("n2",)] and docs.count() == n == sum(x[1] == "DOC" for x in NODES)


def test_failed_tasks_leave_nothing(spark, nodes, tmp_path):
    sqlite.write(nodes.where("id = 'n3'"), str(tmp_path))
    broken = nodes.where("id <> 'n3'").withColumn("label", F.when(F.col("id") == "n9", None).otherwise(F.col("label")))  # no label: the file refuses it
    with pytest.raises(Exception, match="NOT NULL"):
        sqlite.write(broken, str(tmp_path))
    assert len(os.listdir(tmp_path)) == 2 and sqlite.read(spark, str(tmp_path)).count() == 1


def test_one_file(spark, nodes, tmp_path):
    sqlite.write(nodes.repartition(4), str(tmp_path / "parts"))
    sqlite.one_file(str(tmp_path / "parts"), str(tmp_path / "whole.db"))
    c = sqlite3.connect(tmp_path / "whole.db")
    assert c.execute("select count(*), count(distinct id) from nodes").fetchone() == (20, 20)
    assert key(sqlite.read(spark, str(tmp_path / "whole.db")).collect()) == key(NODES)


def test_stores_that_are_not_mounted_are_refused():
    with pytest.raises(ValueError, match="mounted"):
        sqlite.local("s3://bucket/x")
    assert sqlite.local("file:///a/b") == sqlite.local("file:/a/b") == "/a/b"
