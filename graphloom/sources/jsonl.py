"""JSON Lines: datasets out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pairs(pairs: DataFrame, path: str) -> None:
    """(query, plan) pairs as JSON Lines; the plan is a nested object's text."""
    pairs.select(F.concat(F.lit('{"query":'), F.to_json(F.array("query")).substr(F.lit(2), F.length(F.to_json(F.array("query"))) - 2), F.lit(',"plan":'), F.col("plan"), F.lit("}")).alias("value")).write.mode("overwrite").text(path)
