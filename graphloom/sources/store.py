"""Graph tables on disk: Parquet, append-only, read as their latest versions.

Rows are added to the current generation. Compacting a table writes its latest rows, sorted by key, as the base of the
next one. Reading takes the newest whole base and ranks versions only of the keys that later rows touch: all
others leave the base as they are. A base that was lost on the way is passed over, and adding and compacting a
table at once is the caller's to avoid: there is one writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..model import ASSERTION_COLUMNS, CONTENT_COLUMNS, DEFAULT_SCHEMA, EDGE_COLUMNS, NODE_COLUMNS, PROVENANCE_COLUMNS, Schema, UNCERTAINTY_COLUMNS
from ..operators.state import newest
from ..operators.storage import latest

#: Columns of each table, and the column that its folders are named by.
TABLES = {"nodes": (NODE_COLUMNS, "type_id"), "edges": (EDGE_COLUMNS, "type_id"), "contents": (CONTENT_COLUMNS, "format"), "provenance": (PROVENANCE_COLUMNS, None), "uncertainty": (UNCERTAINTY_COLUMNS, None), "assertions": (ASSERTION_COLUMNS, None)}
#: Of tables with versions the key and what orders a key's rows.
VERSIONS = {"nodes": ("id", ("version", "deprecated")), "edges": ("id", ("version", "deprecated")), "uncertainty": ("node_id", ("last_verified",))}


class GraphStore:
    """The tables of a graph below a folder (any store that Spark writes to)."""

    def __init__(self, spark: SparkSession, root: str, schema: Schema = DEFAULT_SCHEMA):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def create(self) -> GraphStore:
        """Empty tables where there are none yet."""
        for name in TABLES:
            self.add(name, self.spark.createDataFrame([], TABLES[name][0]))
        return self

    def generation(self, name: str) -> int:
        return newest(self.spark, f"{self.root}/{name}/base")

    def add(self, name: str, rows: DataFrame) -> None:
        """Appends rows; columns that they lack are null."""
        columns, by = TABLES[name]
        wanted = [c.split(None, 1) for c in columns.split(", ")]
        out = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted))
        writer = out.write.mode("append")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}/changes/g{self.generation(name)}")

    def _rows(self, name: str, *folders: str) -> DataFrame:
        """Rows of those folders that are there; a folder below which nothing was written is empty."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [f for f in (f"{self.root}/{name}/{x}" for x in folders) if fs.exists(path(f))]
        columns = [c.split()[0] for c in TABLES[name][0].split(", ")]
        parts = [self.spark.read.schema(TABLES[name][0]).parquet(f).select(*columns) for f in there]
        out = parts[0] if parts else self.spark.createDataFrame([], TABLES[name][0])
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, name: str) -> DataFrame:
        """All rows that were ever added, all versions."""
        return self._rows(name, *(f"changes/g{k}" for k in range(self.generation(name) + 1)))

    def current(self, name: str) -> DataFrame:
        """The latest row of each key; of a table without versions all rows."""
        if name not in VERSIONS:
            return self.read(name)
        key, order = VERSIONS[name]
        k = self.generation(name)
        changes = self._rows(name, f"changes/g{k}")
        if not k:
            return latest(changes, key, order)
        base, touched = self._rows(name, f"base/g{k}"), changes.select(key).distinct()
        return base.join(touched, key, "left_anti").unionByName(latest(base.join(touched, key, "left_semi").unionByName(changes), key, order))

    def compact(self, name: str) -> None:
        """The latest rows as the base of a new generation."""
        key, _ = VERSIONS[name]
        by = TABLES[name][1]
        writer = self.current(name).repartitionByRange(key).sortWithinPartitions(*([by] if by else []), key).write
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}/base/g{self.generation(name) + 1}")

    def graph(self) -> Graph:
        """The latest version of every node and edge."""
        return Graph(self.current("nodes"), self.current("edges"), self.read("provenance"), self.current("uncertainty"), self.schema)
