"""Grounded assertions, two-step inference, contradictions and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .retrieval import select_approx


def assert_claim(g: Graph, claim: str, sources: DataFrame, threshold: float = 0.7, step_id: str | None = None) -> DataFrame:
    """One row (claim, confidence, n_sources, plan_step_id, unknown_reason) over the ids in sources.

    The reason is null where the claim holds: sources exist, all are there and live, and their
    lowest confidence reaches the threshold; else the first of those that fails.
    """
    ids = sources.select("id")
    found = ids.join(g.nodes.select("id", "confidence", "deprecated", F.lit(True).alias("there")), "id", "left")
    a = found.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("there").isNull()), F.lit(False)).alias("missing"), F.coalesce(F.bool_or("deprecated"), F.lit(False)).alias("gone"), F.min("confidence").alias("least"))
    reason = (
        F.when(F.col("n") == 0, "no_sources").when(F.col("missing"), "source_missing").when(F.col("gone"), "source_deprecated")
        .when(F.col("least") < threshold, F.concat(F.lit("below_threshold: "), F.format_string("%.2f", "least"), F.lit(f"<{threshold:.2f}")))
    )
    return a.select(F.lit(claim).alias("claim"), F.when(reason.isNull(), F.col("least")).alias("confidence"), F.col("n").alias("n_sources"), F.lit(step_id).cast("string").alias("plan_step_id"), reason.alias("unknown_reason"))


def infer(g: Graph, rule_id: str) -> DataFrame:
    """(source, via, target, confidence) for every pair of edges that the rule's two relations chain,
    from a live source; a bag, 0.9 of the weaker edge's confidence. An unknown rule gives no rows."""
    rule = g.schema.rules.get(rule_id)
    relations = rule.relations if rule and len(rule.relations) == 2 else [None, None]
    e1, e2 = (g.live_edges.where(F.col("type_id").eqNullSafe(F.lit(r))).select("source", "target", "confidence") for r in relations)
    first = e1.join(g.live.select(F.col("id").alias("source")), "source", "left_semi").select("source", F.col("target").alias("via"), F.col("confidence").alias("c1"))
    second = e2.select(F.col("source").alias("via"), F.col("target"), F.col("confidence").alias("c2"))
    return first.join(second, "via").select("source", "via", "target", (F.least("c1", "c2") * 0.9).alias("confidence"))


def contradictions(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, reason) for pairs (a, b) of nodes of one type with a shared property that differs.

    The reason names the smallest such property; values compare as JSON, so 1 and "1" differ.
    """
    side = nodes.select("id", "type_id", F.transform_values(F.from_json("properties", "map<string,variant>"), lambda _, v: F.to_json(v)).alias("p"))
    x, y = side.select(F.col("id").alias("a"), F.col("type_id").alias("ta"), F.col("p").alias("pa")), side.select(F.col("id").alias("b"), F.col("type_id").alias("tb"), F.col("p").alias("pb"))
    differ = F.filter(F.array_sort(F.array_intersect(F.map_keys("pa"), F.map_keys("pb"))), lambda k: ~F.col("pa")[k].eqNullSafe(F.col("pb")[k]))
    return pairs.join(x, "a").join(y, "b").where("ta = tb").withColumn("d", differ).where(F.size("d") > 0).select("a", "b", F.concat(F.lit("differ_on:"), F.col("d")[0]).alias("reason"))


def check_coverage(g: Graph, query: Column, k: int = 20, threshold: float = 0.3) -> DataFrame:
    """One row (verdict, score, matched, confidence_avg, gap) of how well the graph covers a topic."""
    hits = select_approx(g, query, k, threshold).df
    a = hits.agg(F.count("*").alias("matched"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence_avg"))
    score = F.least(F.lit(1.0), F.col("matched") / k) * F.col("confidence_avg")
    verdict = F.when(F.col("matched") == 0, "UNKNOWN").when(score >= 0.7, "COVERED").when(score >= 0.4, "PARTIAL").otherwise("SPARSE")
    gap = F.when(F.col("matched") == 0, f"no_matches_above_threshold:{threshold}")
    return a.select(verdict.alias("verdict"), score.alias("score"), "matched", "confidence_avg", gap.alias("gap"))
