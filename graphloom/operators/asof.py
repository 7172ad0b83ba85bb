"""The graph as it was: each row joined to the version that held at its time.

An as-of join by union and carried values. Rows of both sides are dealt to time slices, cut at quantiles of the time, and
within (key, slice) the last version is carried forward in order. What a slice inherits is one row for each key:
the last version of the slices before, found among one row for each (key, slice). So a hot key's rows are
split over the slices, and no side is compared with the other.

Cases: a row before all versions of its key has null columns of the version; a version at the row's own time holds; of
versions at one time the greatest by `order` does; rows with a null key or time stay, with nulls; null times of versions
never hold.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph

SLICES = 64


def slice_of(at: Column, cuts: list, first: int = 0) -> Column:
    """Which slice a time lies in: first, and how many of the sorted cuts aren't after it (a null time: first).

    Branches that halve the cuts, no lambda over them: Spark renumbers a lambda's variables from 0 to compare expressions
    and takes them out of its references by number, with them a captured column of such an id, as a session's first
    plan has it."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(at >= cuts[half], slice_of(at, cuts[half + 1 :], first + half + 1)).otherwise(slice_of(at, cuts[:half], first))


def cuts_of(rows: DataFrame, slices: int) -> list[Column]:
    """Times that cut the rows into slices of about equal numbers."""
    shares = [i / slices for i in range(1, slices)]
    found = rows.select(F.percentile_approx("_at", F.array(*map(F.lit, shares)), 10_000).alias("p")).first()["p"] if shares else None
    kind = rows.schema["_at"].dataType
    return [F.lit(c).cast(kind) for c in sorted(set(found or ()))]


def asof_join(rows: DataFrame, versions: DataFrame, key: str, at: str, since: str, order: str | None = None, slices: int = SLICES) -> DataFrame:
    """rows (all columns kept) with the columns of the version (but its key) that holds at rows' time `at`: of the same key
    the last whose `since` isn't later. The versions' columns have names of their own."""
    kept = [c for c in versions.columns if c != key]
    clash = set(kept) & set(rows.columns)
    if clash:
        raise ValueError(f"versions' columns need names of their own: {sorted(clash)}")
    left = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), F.lit(None).alias("_version"), F.lit(None).alias("_order"))
    right = versions.where(F.col(since).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(since).alias("_at"), F.lit(None).alias("_row"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_version"), (F.lit(0) if order is None else F.col(order)).alias("_order"),
    )
    cuts = cuts_of(left.select("_at").union(right.select("_at")), slices)
    both = left.unionByName(right).withColumn("_slice", slice_of(F.col("_at"), cuts))
    last = both.where("_version is not null").groupBy("_key", "_slice").agg(F.max_by("_version", F.struct("_at", "_order")).alias("_version"))
    # One row for each key and slice: what the slices before it leave.
    places = last.unionByName(both.where("_row is not null").select("_key", "_slice").distinct(), allowMissingColumns=True).groupBy("_key", "_slice").agg(F.first("_version", ignorenulls=True).alias("_own"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("_version", F.last("_own", ignorenulls=True).over(before)).where("_version is not null")
    start = carried.select("_key", F.lit(None).alias("_at"), F.lit(None).alias("_row"), "_version", F.lit(None).alias("_order"), "_slice")
    so_far = Window.partitionBy("_key", "_slice").orderBy(F.asc_nulls_first("_at"), F.col("_row").isNotNull(), "_order").rowsBetween(Window.unboundedPreceding, 0)
    timed = both.where("_at is not null and _key is not null").unionByName(start)
    found = timed.withColumn("_version", F.last("_version", ignorenulls=True).over(so_far)).where("_row is not null")
    untimed = both.where("_row is not null and (_at is null or _key is null)")
    return found.select("_row", "_version").unionByName(untimed.select("_row", "_version")).select("_row.*", *(F.col("_version")[c].alias(c) for c in kept))


def as_of(g: Graph, at: datetime) -> Graph:
    """The graph at a time: of each node and edge the last version that began by then, unless that was no longer valid."""
    time = F.lit(at).cast("timestamp_ntz")

    def then(rows: DataFrame, since: str) -> DataFrame:
        known = rows.where(F.col(since) <= time)
        newest = known.groupBy("id").agg(F.max_by(F.struct(*known.columns), F.struct("version", since, "deprecated")).alias("r")).select("r.*")
        return newest.where(F.col("valid_until").isNull() | (F.col("valid_until") > time))

    return Graph(then(g.nodes, "updated_at"), then(g.edges, "created_at"), g.provenance, g.uncertainty, g.schema)
