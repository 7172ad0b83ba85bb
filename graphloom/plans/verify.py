"""Checks of a plan's result, schema violations, and the answer's text."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import properties as P
from ..graph import Graph, Nodes
from ..model import Schema
from .executor import Result


def verify(g: Graph, result: Result, as_of: datetime, window: timedelta = timedelta(days=14)) -> DataFrame:
    """One row: completeness, provenance_ok, freshness_ok, confidence, gap.

    Confidence is the mean over 1.0 for each assertion and each bound node's confidence.
    """
    lists = [b.df.select("id") for b in result.bindings.values() if isinstance(b, Nodes)]
    spark, n = g.nodes.sparkSession, len(result.assertions)
    if not n:
        return spark.createDataFrame([(False, True, True, 0.0, "no_assertions")], "completeness boolean, provenance_ok boolean, freshness_ok boolean, confidence double, gap string")
    bound = reduce(DataFrame.unionAll, lists) if lists else spark.createDataFrame([], "id string")
    rows = bound.join(g.nodes.select("id", "confidence", "updated_at", "provenance_id"), "id").join(g.provenance.select(F.col("id").alias("provenance_id"), F.lit(True).alias("known")), "provenance_id", "left")
    since = F.lit(as_of - window).cast("timestamp_ntz")
    return rows.agg(
        F.lit(True).alias("completeness"), F.coalesce(F.bool_and(F.col("known").isNotNull()), F.lit(True)).alias("provenance_ok"), F.coalesce(F.bool_and(F.col("updated_at") >= since), F.lit(True)).alias("freshness_ok"),
        ((F.coalesce(F.sum("confidence"), F.lit(0.0)) + float(n)) / (F.count("*") + n)).alias("confidence"), F.lit(None).cast("string").alias("gap"),
    )


def relation_violations(g: Graph, schema: Schema | None = None) -> DataFrame:
    """(id, source_type, relation, target_type) of edges that the schema doesn't allow."""
    schema = schema or g.schema
    rules = g.nodes.sparkSession.createDataFrame(schema.relation_rows() or [("", "", "")], "source_type string, relation string, allowed string")
    types = g.nodes.select("id", "type_id")
    e = g.edges.select("id", "source", "target", F.col("type_id").alias("relation"))
    e = e.join(types.withColumnsRenamed({"id": "source", "type_id": "source_type"}), "source").join(types.withColumnsRenamed({"id": "target", "type_id": "target_type"}), "target")
    ok = (e.source_type == rules.source_type) & (e.relation == rules.relation) & ((rules.allowed == "*") | (rules.allowed == e.target_type))
    return e.join(F.broadcast(rules), ok, "left_anti").select("id", "source_type", "relation", "target_type")  # rules: one row a declared relation


def node_violations(nodes: DataFrame, schema: Schema) -> DataFrame:
    """(id, error) for unknown types, missing required properties and values outside an enumeration."""
    errors = [F.when(~F.col("type_id").isin(*schema.types), F.concat(F.lit("unknown_type:"), F.col("type_id")))]
    for t in schema.types:
        for name, (kind, required, values) in schema.properties(t).items():
            here, v = F.col("type_id") == t, P.prop(F.col("properties"), name)
            if required:
                errors.append(F.when(here & P.kind(v).isNull(), f"missing_property:{name}"))
            if kind == "enum" and values:
                text = P.text(F.col("properties"), name)
                errors.append(F.when(here & P.kind(v).isNotNull() & ~F.coalesce(text.isin(*values), F.lit(False)), F.concat(F.lit(f"bad_enum:{name}="), F.coalesce(text, F.lit("?")))))
    return nodes.select("id", F.explode(F.array_compact(F.array(*errors))).alias("error"))


def synthesize(g: Graph, result: Result, query: str) -> str:
    """Each assertion with its first five sources and confidence; without any, why there is no answer."""
    if not result.assertions:
        return f"[UNKNOWN: no_assertions_for_query: {query}]"
    out = []
    for i, a in enumerate(result.assertions, 1):
        named = a["sources"].df.orderBy(*a["sources"].sort).limit(5).select(F.concat_ws(":", "type_id", F.coalesce(P.text(F.col("properties"), "path"), F.col("label"))).alias("s")).collect()
        sources = ", ".join(r["s"] for r in named) or "(none)"
        out.append(f"[A{i}] Claim: {a['claim']}\n      Sources: {sources}\n      Confidence: {a['confidence']:.2f}")
    return "\n".join(out)
