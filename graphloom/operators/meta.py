"""Questions about a node: type, provenance, freshness, deprecation, uncertainty."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, Nodes


def get_type(nodes: Nodes) -> DataFrame:
    """(id, type_id) of the first node."""
    return nodes.first.select("id", "type_id")


def check_type(nodes: Nodes, type_id: str) -> DataFrame:
    """(id, ok): the type is exactly this one, inheritance aside."""
    return nodes.df.select("id", (F.col("type_id") == type_id).alias("ok"))


def get_provenance(g: Graph, nodes: Nodes) -> DataFrame:
    """The first node's provenance row, with the node's id as node_id."""
    first = nodes.first.select(F.col("id").alias("node_id"), F.col("provenance_id"))
    return first.join(g.provenance.withColumnRenamed("id", "provenance_id"), "provenance_id")


def get_uncertainty(g: Graph, ids: DataFrame) -> DataFrame:
    """Uncertainty columns by id, nulls where there is no row."""
    return ids.select("id").join(g.uncertainty.withColumnRenamed("node_id", "id"), "id", "left")


def get_confidence(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, confidence, coverage, freshness_score) of the uncertainty rows, nulls where there is none."""
    return get_uncertainty(g, ids).select("id", "confidence", "coverage", "freshness_score")


def is_fresh(g: Graph, ids: DataFrame, max_age: timedelta, as_of: datetime) -> DataFrame:
    """(id, fresh): updated within max_age of as_of; missing nodes aren't."""
    since = F.lit(as_of - max_age).cast("timestamp_ntz")
    return ids.select("id").join(g.nodes.select("id", "updated_at"), "id", "left").select("id", F.coalesce(F.col("updated_at") >= since, F.lit(False)).alias("fresh"))


def is_deprecated(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, deprecated); missing nodes aren't."""
    return ids.select("id").join(g.nodes.select("id", "deprecated"), "id", "left").select("id", F.coalesce("deprecated", F.lit(False)).alias("deprecated"))


def get_contradictions(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, other) for each entry of the contradiction sets; null where there is none."""
    return get_uncertainty(g, ids).select("id", F.explode_outer("contradiction_set").alias("other"))
