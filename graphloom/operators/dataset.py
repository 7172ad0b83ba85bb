"""Query and plan pairs from random walks, and exact splits; seeded, so runs repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from .state import settled

# Shares of the train and validation parts; the rest tests.
SHARES = (0.70, 0.15)


#: Edges of one source that are numbered in one place; a hub's are dealt to several.
NUMBERED = 10_000


def drawn(*parts: Column) -> Column:
    """A number below 2**60 that the parts' text alone decides (the first 60 bits of its MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def numbered_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (source, target, relation, edge) with nth, their number within their source from 0, and (source, degree).

    Up to NUMBERED edges go by their id. A hub's are dealt to ranges of a hash first, numbered within each, and
    shifted by the sizes of the ranges before, so no task sorts a hub's whole list.
    """
    degrees = edges.groupBy("source").agg(F.count("*").alias("degree"))
    ranges = F.ceil(F.col("degree") / NUMBERED)
    dealt = edges.join(degrees, "source").withColumn("range", F.when(ranges > 1, F.pmod(F.xxhash64("edge"), ranges)).otherwise(0))
    sizes = dealt.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("source", "range").orderBy("edge")) - 1
    return dealt.withColumn("within", within).join(before, ["source", "range"]).select("source", "target", "relation", "edge", (F.col("within") + F.col("before")).cast("long").alias("nth")), degrees


def random_walks(g: Graph, n: int, seed: int = 0, max_hops: int = 3) -> DataFrame:
    """n walks (walk, path, relations) from live starts along uniformly drawn live out-edges.

    A walk wants 1 to max_hops hops and ends early where no edge leads on. A draw is a number below the source's degree,
    so a hop is two equi-joins with one row each for a walk, and a hub's list is never unfolded.
    """
    lit = lambda v: F.lit(str(v))
    starts = g.live.select("id").orderBy(drawn(F.col("id"), lit(seed)), "id").limit(n)
    walks = settled(starts.select(F.col("id").alias("walk"), F.array("id").alias("path"), F.array().cast("array<string>").alias("relations"), (drawn(F.col("id"), lit(seed + 1)) % max_hops + 1).alias("want")))
    edges = g.live_edges.select("source", "target", F.col("type_id").alias("relation"), F.col("id").alias("edge"))
    numbered, degrees = map(settled, numbered_edges(edges.join(g.live.select(F.col("id").alias("target")), "target", "left_semi")))
    for hop in range(max_hops):
        asked = walks.where((F.size("path") == hop + 1) & (F.col("want") > hop)).select("walk", F.element_at("path", -1).alias("source")).join(degrees, "source")
        step = asked.select("walk", "source", (drawn(F.col("walk"), lit(seed), lit(hop)) % F.col("degree")).alias("nth")).join(numbered, ["source", "nth"]).select("walk", F.struct("target", "relation").alias("next"))
        grown = walks.join(step, "walk", "left")
        walks = settled(grown.select("walk", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next.target"))).alias("path"), F.when(F.col("next").isNull(), F.col("relations")).otherwise(F.concat("relations", F.array("next.relation"))).alias("relations"), "want"))
    return walks.drop("want")


def pairs(g: Graph, walks: DataFrame) -> DataFrame:
    """(walk, query, plan): a question about each walk's ends, and the plan (JSON) that answers it."""
    label = g.nodes.select("id", "label")
    ends = walks.join(label.select(F.col("id").alias("walk"), F.col("label").alias("a")), "walk").withColumn("end", F.element_at("path", -1)).join(label.select(F.col("id").alias("end"), F.col("label").alias("b")), "end")
    query = F.when(F.size("relations") > 0, F.format_string("how is %s related to %s?", "a", "b")).otherwise(F.format_string("what is %s?", "a"))
    step = lambda op, args, i, deps: F.to_json(F.struct(F.concat(F.lit("s"), i.cast("string")).alias("step_id"), F.lit(op).alias("op"), args.alias("args"), F.concat(F.lit("$b"), i.cast("string")).alias("output_binding"), deps.alias("depends_on")))
    none = F.array().cast("array<string>")
    first = step("SELECT_BY_ID", F.struct(F.col("walk").alias("id")), F.lit(0), none)
    hops = F.transform("relations", lambda r, i: step("TRAVERSE", F.struct(F.concat(F.lit("$b"), i.cast("string")).alias("node"), r.alias("rel"), F.lit("out").alias("direction")), i + 1, F.array(F.concat(F.lit("s"), i.cast("string")))))
    size = F.size("relations")
    last = step("ASSERT", F.struct(query.alias("claim"), F.concat(F.lit("$b"), size.cast("string")).alias("sources"), F.lit(0.6).alias("confidence_threshold")), size + 1, F.array(F.concat(F.lit("s"), size.cast("string"))))
    plan = F.concat(F.lit('{"steps":['), F.array_join(F.concat(F.array(first), hops, F.array(last)), ","), F.lit("]}"))
    return ends.select("walk", query.alias("query"), plan.alias("plan"))


def split(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows with a column part: train, val or test, cut at the floors of 70 and 15 per cent of a shuffled order.

    Ranks come from counts per hash range, so no task sorts all rows.
    """
    hashed = rows.withColumn("_h", drawn(F.col(key).cast("string"), F.lit(str(seed)))).withColumn("_r", F.shiftright("_h", 48))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over 4096 rows
    offsets = hashed.groupBy("_r").agg(F.count("*").alias("_n")).select("_r", before.alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    nth = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)) + F.col("_before")
    train, val = (F.floor(F.col("_all") * s) for s in SHARES)
    part = F.when(F.col("_nth") <= train, "train").when(F.col("_nth") <= train + val, "val").otherwise("test")
    return hashed.join(F.broadcast(offsets), "_r").withColumn("_nth", nth).withColumn("part", part).drop("_h", "_r", "_before", "_all", "_nth")
