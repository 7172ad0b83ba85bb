"""Edges stored once, by endpoint, for navigation.

Two bucketed tables hold the live edges, one by their source, one by their target. A hop from few nodes reads the
buckets and row groups of these alone; a hop from many is a join in which only the frontier is shuffled, as the
edges lie in buckets already. The tables are external ones below a folder, named in the session's catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("near", "far", "type_id", "edge")


@dataclass(frozen=True)
class Adjacency:
    """Names of the tables of out-edges and of in-edges (near, far, type_id, edge), bucketed and sorted by near."""

    spark: SparkSession
    out: str
    back: str

    @classmethod
    def store(cls, edges: DataFrame, name: str, folder: str, buckets: int = 64) -> Adjacency:
        """Writes the live edges (source, target, type_id, id, deprecated). At scale a bucket should hold some 200 MB."""
        spark = edges.sparkSession
        live = edges.where(~F.col("deprecated"))
        for way, near, far in (("out", "source", "target"), ("back", "target", "source")):
            rows = live.select(F.col(near).alias("near"), F.col(far).alias("far"), "type_id", F.col("id").alias("edge"))
            dealt = rows.repartition(buckets, "near")  # a bucket is one task's, so it is one file
            dealt.write.bucketBy(buckets, "near").sortBy("near").option("path", f"{folder}/{way}").mode("overwrite").saveAsTable(f"{name}_{way}")
        return cls(spark, f"{name}_out", f"{name}_back")

    def edges(self, direction: str, relations: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
        """(near, far, edge) of out- or in-edges or both; ids: of these nodes alone."""
        if direction == "both":
            return self.edges("out", relations, ids).unionByName(self.edges("in", relations, ids))
        rows = self.spark.table(self.out if direction == "out" else self.back)
        if relations:
            rows = rows.where(F.col("type_id").isin(list(relations)))
        if ids is not None:
            rows = rows.where(F.col("near").isin(ids))
        return rows.select("near", "far", "edge")
