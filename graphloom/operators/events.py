"""Event, interrupt and arbitration records: reading, statistics, and rows to append."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import properties as P
from ..graph import Graph

# The record types.
INTERRUPTS = ("INTERRUPT_L1", "INTERRUPT_L2", "INTERRUPT_L3")


def recent_events(g: Graph, type_id: str | None = None, limit: int = 50) -> DataFrame:
    """The newest nodes, of one type if given; deprecated ones included, broken properties as {}."""
    rows = g.nodes if type_id is None else g.nodes.where(F.col("type_id") == type_id)
    props = F.when(F.try_parse_json("properties").isNull(), F.lit("{}")).otherwise(F.col("properties"))
    return rows.select("id", "type_id", "created_at", props.alias("properties")).orderBy(F.desc("created_at"), "id").limit(limit)


def active_interrupts(g: Graph, limit: int = 100, salience: float = 0.5) -> DataFrame:
    """Of the newest `limit` interrupts, those unresolved (L1), salient (L2), and all L3."""
    p = F.col("properties")
    newest = g.nodes.where(F.col("type_id").isin(*INTERRUPTS)).orderBy(F.desc("created_at"), "id").limit(limit)
    resolved = F.coalesce(P.number(p, "resolved"), F.lit(0.0)) != 0
    low = F.coalesce(P.number(p, "salience_score"), F.lit(0.0)) < salience
    kept = newest.where(~((F.col("type_id") == "INTERRUPT_L1") & resolved) & ~((F.col("type_id") == "INTERRUPT_L2") & low))
    fields = {n: P.text(p, n) for n in ("trigger_metric", "action", "pattern", "monitor", "observation")} | {n: P.number(p, n) for n in ("trigger_value", "salience_score")}
    return kept.select("id", "type_id", "created_at", *(c.alias(n) for n, c in fields.items()))


def recent_decisions(g: Graph, limit: int = 20) -> DataFrame:
    """The newest arbitration outcomes, flattened."""
    p = F.col("properties")
    newest = g.nodes.where(F.col("type_id") == "ARBITRATION_OUTCOME").orderBy(F.desc("created_at"), "id").limit(limit)
    return newest.select("id", "created_at", *(P.text(p, n).alias(n) for n in ("outcome", "challenger_id", "challenged_id", "reason")), *(P.number(p, n).alias(n) for n in ("ecl_confidence", "risk_score")))


def since(as_of: datetime, hours: float) -> Column:
    return F.col("created_at") >= F.lit(as_of - timedelta(hours=hours)).cast("timestamp_ntz")


def pattern_frequency(g: Graph, as_of: datetime, hours: float = 24) -> DataFrame:
    """(pattern, n) of L2 interrupts within the hours before as_of, most frequent first."""
    rows = g.nodes.where((F.col("type_id") == "INTERRUPT_L2") & since(as_of, hours))
    return rows.groupBy(F.coalesce(P.text(F.col("properties"), "pattern"), F.lit("unknown")).alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern")


def event_summary(g: Graph, as_of: datetime, hours: float = 24) -> DataFrame:
    """One row: events within the hours, interrupts of all levels, the top pattern and its count."""
    rows = g.nodes.where(F.col("type_id").isin("EVENT_LOG", *INTERRUPTS))
    totals = rows.agg(F.count_if((F.col("type_id") == "EVENT_LOG") & since(as_of, hours)).alias("events"), F.count_if(F.col("type_id").isin(*INTERRUPTS)).alias("interrupts"))
    top = pattern_frequency(g, as_of, hours).limit(1).agg(F.coalesce(F.first("pattern"), F.lit("none")).alias("top_pattern"), F.coalesce(F.first("n"), F.lit(0)).alias("top_count"))
    return totals.join(top, how="cross")  # one row each


def record(rows: DataFrame, type_id: str, fields: dict[str, Column], node_id: Column, created_at: Column, confidence: Column | float = 1.0, label: Column | None = None, embedding: Column | None = None) -> DataFrame:
    """Nodes to append: an event, interrupt, challenge, revision, outcome, turn or session with these properties."""
    c = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else F.coalesce(confidence, F.lit(1.0))
    return rows.select(
        node_id.alias("id"), F.lit(type_id).alias("type_id"), (F.concat_ws(":", F.lit(type_id.lower()), node_id) if label is None else label).alias("label"), (F.lit(None) if embedding is None else embedding).cast("array<float>").alias("embedding"),
        F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("properties"), F.lit(None).cast("string").alias("content_ref"), c.alias("confidence"), F.lit(1).alias("version"),
        created_at.alias("created_at"), created_at.alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("provenance_id"),
    )


def relation(rows: DataFrame, source: Column, target: Column, type_id: str, created_at: Column, confidence: float = 1.0, weight: float = 1.0) -> DataFrame:
    """Edges to append where a target is given, such as INTERRUPT_OF, CHALLENGED_BY, SUPERSEDES, RESOLVED_TO."""
    return rows.where(target.isNotNull()).select(
        F.concat_ws(":", F.lit(type_id), source, target).alias("id"), source.alias("source"), target.alias("target"), F.lit(type_id).alias("type_id"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence"),
        F.lit(True).alias("directional"), F.lit(1).alias("version"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("provenance_id"), created_at.alias("created_at"),
    )


def set_property(nodes: DataFrame, name: str, value: Column, now: datetime | None = None) -> DataFrame:
    """New versions of nodes with one property replaced, as for a challenge's status; the other properties keep
    their kinds. Properties that are no JSON object become one of this property alone."""
    old = F.from_json("properties", "map<string,variant>")
    rest = F.coalesce(F.map_filter(old, lambda k, _: k != name), F.from_json(F.lit("{}"), "map<string,variant>"))
    patch = F.from_json(F.to_json(F.create_map(F.lit(name), value)), "map<string,variant>")
    at = F.col("updated_at") if now is None else F.lit(now).cast("timestamp_ntz")
    return nodes.withColumns({"properties": F.to_json(F.map_concat(rest, patch)), "version": F.col("version") + 1, "updated_at": at})
