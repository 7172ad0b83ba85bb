"""Scans: exact, fresh, by id, by type, and by similarity."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import properties, vector
from ..graph import Graph, Nodes


def select_exact(g: Graph, type_id: str, name: str, value: object) -> Nodes:
    """Live nodes of exactly this type whose property equals the value. Where the type has typed rows, the
    comparison is one of their columns, which the scan filters by; else one of the JSON text."""
    source = g.sources.get(type_id)
    if source is not None and value is not None and name in source.fields:
        rows = source.rows.where(properties.typed_equals(source.rows.select(source.fields[name].alias("f")).schema["f"].dataType, source.fields[name], value))
        return Nodes(source.make(rows).where(~F.col("deprecated")))
    return Nodes(g.live.where((F.col("type_id") == type_id) & properties.equals(F.col("properties"), name, value)))


def select_by_id(g: Graph, node_id: str) -> Nodes:
    """The node, deprecated or not. An id of a type with typed rows is looked up by its key."""
    for source in g.sources.values():
        if source.prefix and (m := re.fullmatch(rf"{re.escape(source.prefix)}(0|-?[1-9]\d{{0,17}})", node_id)):
            return Nodes(source.make(source.rows.where(F.col(source.key) == int(m[1]))))
    return Nodes(g.nodes.where(F.col("id") == node_id))


def select_fresh(g: Graph, type_id: str, name: str, value: object, max_age: timedelta, as_of: datetime) -> Nodes:
    """select_exact of nodes updated within max_age of as_of."""
    found = select_exact(g, type_id, name, value)
    return found.with_df(found.df.where(F.col("updated_at") >= F.lit(as_of - max_age).cast("timestamp_ntz")))


def find_by_type(g: Graph, type_id: str, deprecated: bool = False) -> Nodes:
    return Nodes((g.nodes if deprecated else g.live).where(F.col("type_id") == type_id))


def all_nodes(g: Graph, deprecated: bool = False) -> Nodes:
    return Nodes(g.nodes if deprecated else g.live)


def scored(nodes: DataFrame, query: Column) -> DataFrame:
    return nodes.where("embedding is not null").withColumn("score", vector.cosine(F.col("embedding"), query))


def top_scored(g: Graph, query: Column, k: int) -> DataFrame:
    """The k nearest embedded nodes with their score, deprecated ones included: out of all, or those that the graph's
    index finds."""
    if g.index is None:
        return scored(g.nodes, query).orderBy(F.desc("score"), "id").limit(k)
    vector_ = g.nodes.sparkSession.range(1).select(query.cast("array<double>").alias("v")).first()["v"]
    return g.nodes.join(F.broadcast(g.index.query(vector_, k)), "id")  # k rows


def nearest(g: Graph, query: Column, k: int) -> DataFrame:
    """(id, score) of the k nearest embedded nodes, deprecated ones included."""
    return top_scored(g, query, k).select("id", "score").orderBy(F.desc("score"), "id")


def select_approx(g: Graph, query: Column, k: int = 10, threshold: float = 0.3, type_filter: str | None = None, exact_filter: bool = False) -> Nodes:
    """The k most similar live nodes, most similar first.

    As in the reference, threshold and type filter what an index returned: the top 3k of
    all embedded nodes, so fewer than k may come. exact_filter filters first, and asks no index.
    """
    ok = (F.col("score") >= threshold) & ~F.col("deprecated") & (F.lit(True) if type_filter is None else F.col("type_id") == type_filter)
    best = (F.desc("score"), F.asc("id"))
    top = scored(g.nodes, query) if exact_filter else top_scored(g, query, 3 * k)
    return Nodes(top.where(ok).orderBy(*best).limit(k), ("score desc", "id"))


def embed(text: str) -> Column:
    """A query vector of a text."""
    return vector.hash_embedding(F.lit(text))
