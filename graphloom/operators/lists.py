"""Set operations, filter, ranking, prefixes and aggregates over node lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import properties
from ..functions.conditions import condition
from ..graph import NODE_NAMES, Graph, Nodes


def intersect(a: Nodes, b: Nodes) -> Nodes:
    """a's rows, duplicates and order kept, whose id b has."""
    return a.with_df(a.df.join(b.df.select("id"), "id", "left_semi"))


def union(a: Nodes, b: Nodes) -> Nodes:
    """a's rows, then b's; the first row of an id stays."""
    both = a.df.select(*NODE_NAMES, F.lit(0).alias("side")).unionByName(b.df.select(*NODE_NAMES, F.lit(1).alias("side")))
    first = F.row_number().over(Window.partitionBy("id").orderBy("side"))
    return Nodes(both.withColumn("nth", first).where("nth = 1").drop("nth"), ("side", "id"))


def difference(a: Nodes, b: Nodes) -> Nodes:
    """a's rows whose id b lacks."""
    return a.with_df(a.df.join(b.df.select("id"), "id", "left_anti"))


def filter_nodes(nodes: Nodes, text: str) -> Nodes:
    """Rows for which the condition holds."""
    return nodes.with_df(nodes.df.where(condition(text)))


def rank(nodes: Nodes, score: Column) -> Nodes:
    """A column score, highest first; ties keep their order."""
    return Nodes(nodes.df.withColumn("score", score), ("score desc", *nodes.order))


def sort(nodes: Nodes, key: Column, descending: bool = False) -> Nodes:
    """By key, nulls last; ties keep their order either way."""
    return Nodes(nodes.df.withColumn("sort_key", key), ("sort_key desc" if descending else "sort_key", *nodes.order))


def top_k(nodes: Nodes, k: int = 10) -> Nodes:
    """The first k rows."""
    if k < 0:
        raise ValueError("k must not be negative")
    return nodes.with_df(nodes.df.orderBy(*nodes.sort).limit(k))


def count(nodes: Nodes) -> DataFrame:
    """One row (n), duplicates counted."""
    return nodes.df.agg(F.count("*").alias("n"))


AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}


def aggregate(nodes: Nodes, fn: str, name: str) -> DataFrame:
    """One row (value) over a property's numbers, booleans as 0 and 1; without any, 0."""
    if fn not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {fn}")
    value = AGGREGATES[fn](properties.number(F.col("properties"), name)).cast("double")
    return nodes.df.agg(F.coalesce(value, F.lit(0.0)).alias("value"))


def group(nodes: Nodes, key: Column) -> DataFrame:
    """(key, n): the size of each group."""
    return nodes.df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def group_members(nodes: Nodes, key: Column) -> Nodes:
    """The rows with a column key, by key and in their order within: groups stay rows, so none has to fit in one."""
    return Nodes(nodes.df.withColumn("key", key), ("key", *nodes.order))


def reduce_best(nodes: Nodes) -> Nodes:
    """The live row of the highest confidence, the first of equals; none without live rows."""
    best = nodes.df.where(~F.col("deprecated")).orderBy(F.desc("confidence"), *nodes.sort).limit(1)
    return nodes.with_df(best)


def count_by_type(g: Graph) -> DataFrame:
    """(type_id, n) of live nodes for each declared type, zeros kept, and a row `total` of their sum."""
    types = g.nodes.sparkSession.createDataFrame([(t,) for t in g.schema.types], "type_id string")
    counts = g.live.groupBy("type_id").agg(F.count("*").alias("n"))
    each = types.join(counts, "type_id", "left").select("type_id", F.coalesce("n", F.lit(0)).alias("n"))
    return each.rollup("type_id").agg(F.sum("n").alias("n")).select(F.coalesce("type_id", F.lit("total")).alias("type_id"), "n")
