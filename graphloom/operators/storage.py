"""Append-only tables: inserts, new versions, tombstones, and views of the latest rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import NODE_NAMES


def append(df: DataFrame, path: str, partition_by: str | None = "type_id") -> None:
    """Adds rows to a table, one folder for each type."""
    w = df.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def find(rows: DataFrame, wanted: str, key: str = "id") -> DataFrame:
    """The row of a content, provenance or uncertainty table with this key."""
    return rows.where(F.col(key) == wanted)


def duplicates(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Keys that an insert would repeat."""
    inside = new.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return inside.union(new.select(key).join(existing.select(key), key, "left_semi")).distinct()


def update_nodes(current: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """New versions: columns of changes (id and mutable ones) replace the current ones where not null;
    type and provenance don't change."""
    mutable = [c for c in changes.columns if c not in ("id", "type_id", "provenance_id", "version", "updated_at", "created_at")]
    change = changes.select("id", *(F.col(c).alias(f"new_{c}") for c in mutable))
    joined = current.join(change, "id")
    value = {c: F.coalesce(f"new_{c}", c) for c in mutable} | {"version": F.col("version") + 1, "updated_at": F.lit(now).cast("timestamp_ntz")}
    return joined.select(*(value.get(c, F.col(c)).alias(c) for c in NODE_NAMES))


def deprecate(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones: the rows again, deprecated, without a new version."""
    return current.join(ids.select("id"), "id", "left_semi").withColumn("deprecated", F.lit(True))


def latest(rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("version", "deprecated")) -> DataFrame:
    """The last row of each key: the highest version, of one version the tombstone."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def latest_uncertainty(rows: DataFrame) -> DataFrame:
    """Upserts by node: the row verified last."""
    return latest(rows, "node_id", ("last_verified",))
