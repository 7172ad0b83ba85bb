"""Statistics of a graph that grows: each ingest adds its own summaries, and summaries are merged, not recomputed.

A summary row stands for one (kind, name, week) of one ingest: exact counts and sums, an HLL sketch of distinct keys and a
KLL sketch of confidences. Reading merges them over grouping sets. Old rows are never read again: the work grows with
the number of summaries, not with the graph.

Errors (Apache DataSketches): distinct keys within some 1.6 per cent (2**12 buckets, one standard error), ranks of quantiles
within some 1.33 per cent (k = 200).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "ingest string, kind string, name string, week date, n long, live long, confidence_sum double, keys binary, confidences binary"
#: Bits of an HLL sketch's buckets, and the size of a KLL sketch.
HLL_BITS, KLL_SIZE = 12, 200


def week_of(at: Column) -> Column:
    return F.trunc(at.cast("date"), "week")


def summarised(rows: DataFrame, kind: str, ingest: str, name: str = "type_id", key: str = "id", at: str = "created_at") -> DataFrame:
    """Summaries of nodes or edges (kind): by name and week."""
    value = F.coalesce(F.col("confidence"), F.lit(0.0)).cast("double")
    return rows.groupBy(F.col(name).alias("name"), week_of(F.col(at)).alias("week")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("deprecated")).alias("live"), F.sum(value).alias("confidence_sum"), F.hll_sketch_agg(F.col(key), HLL_BITS).alias("keys"), F.kll_sketch_agg_double(value, KLL_SIZE).alias("confidences"),
    ).select(F.lit(ingest).alias("ingest"), F.lit(kind).alias("kind"), "name", "week", "n", "live", "confidence_sum", "keys", "confidences")


class Statistics:
    """Summaries below a folder, one append for each ingest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, summary: DataFrame) -> None:
        summary.write.mode("append").parquet(f"{self.root}/summaries")

    def summaries(self) -> DataFrame:
        """Of an ingest that was added again, as after a failure, the last rows count once."""
        rows = self.spark.read.schema(SUMMARY).parquet(f"{self.root}/summaries")
        return rows.dropDuplicates(["ingest", "kind", "name", "week"])

    def report(self, sets: list[tuple[str, ...]] = [("kind", "name", "week"), ("kind", "name"), ("kind", "week"), ("kind",), ()], quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:  # noqa: B006
        """(kind, name, week, n, live, confidence_avg, distinct_keys, quantiles) for each grouping set; a column that a set
        leaves out is null, and `level` names the set."""
        columns = ["kind", "name", "week"]
        merged = self.summaries().groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
            F.grouping_id().alias("left_out"), F.sum("n").alias("n"), F.sum("live").alias("live"), (F.sum("confidence_sum") / F.sum("n")).alias("confidence_avg"), F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("distinct_keys"), F.kll_merge_agg_double("confidences").alias("sketch"),
        )
        level = F.concat_ws("+", *(F.when(F.col("left_out").bitwiseAND(1 << (len(columns) - 1 - k)) == 0, c) for k, c in enumerate(columns)))
        values = F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in quantiles))
        return merged.select(F.when(level == "", "all").otherwise(level).alias("level"), *columns, "n", "live", "confidence_avg", "distinct_keys", values.alias("quantiles"))
