"""Conversation turns: ingestion, recent and similar turns, rendering, checkpoints."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import properties as P
from ..functions.vector import TURN, hash_embedding, nearest_of
from ..graph import Graph
from .retrieval import top_scored

# Sizes of rendered blocks.
TURN_CHARS, CHECKPOINT_TURN_CHARS, CHECKPOINT_CHARS = 600, 800, 4000
# Characters of a text that what it refers to is found by.
REFERRING_CHARS = 1000


def token_count(text: Column) -> Column:
    """Words between white space; none in a blank text."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def assign_turns(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new (session_id, seq, role, text) with turn_index after the session's last one; blank texts skipped."""
    last = existing.groupBy("session_id").agg(F.max("turn_index").alias("last"))
    said = new.where(F.trim("text") != "").join(last, "session_id", "left")
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", F.when(F.col("role") == "user", 0).otherwise(1)))
    return said.withColumn("turn_index", (F.coalesce("last", F.lit(-1)) + nth).cast("long")).drop("last")


def new_turns(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming turns without repeats, by (session_id, turn_index, role), of each other or of existing ones."""
    key = ["session_id", "turn_index", "role"]
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def sessions(existing: DataFrame, turns: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Sessions that turns name and that don't exist yet, with these columns, of which a session has one value."""
    return turns.select("session_id", *keep).distinct().join(existing.select("session_id"), "session_id", "left_anti")


def turn_label() -> Column:
    """Who spoke, when, and the session's beginning."""
    return F.concat("role", F.lit("["), F.col("turn_index").cast("string"), F.lit("]@"), F.substring("session_id", 1, 8))


def follows(turns: DataFrame) -> DataFrame:
    """(id, previous): each turn and the one at the index before, whoever spoke; of several the smallest id."""
    before = turns.groupBy("session_id", (F.col("turn_index") + 1).alias("turn_index")).agg(F.min("id").alias("previous"))
    return turns.join(before, ["session_id", "turn_index"]).select("id", "previous")


def turns_of(g: Graph) -> DataFrame:
    """Live turns with their properties as columns."""
    p = F.col("properties")
    fields = [P.text(p, n).alias(n) for n in ("session_id", "role", "text", "timestamp")]
    return g.live.where(F.col("type_id") == TURN).select("id", "created_at", "embedding", *fields, P.number(p, "turn_index").cast("long").alias("turn_index"))


def recent_turns(turns: DataFrame, n: int = 6, session_id: str | None = None) -> DataFrame:
    """The last n turns of a session, or of each, in order."""
    chosen = turns if session_id is None else turns.where(F.col("session_id") == session_id)
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index"), "id"))
    return chosen.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth").orderBy("session_id", "turn_index")


def semantic_turns(g: Graph, query: Column, session_id: str, k: int = 4, threshold: float = 0.55) -> DataFrame:
    """The k most similar live turns of other sessions, out of the top 6k of all embedded nodes."""
    best = (F.desc("score"), F.asc("id"))
    top = top_scored(g, query, 6 * k)
    ok = (F.col("score") >= threshold) & ~F.col("deprecated") & (F.col("type_id") == TURN) & ~F.coalesce(P.text(F.col("properties"), "session_id") == session_id, F.lit(False))
    return top.where(ok).orderBy(*best).limit(k)


def references(g: Graph, query: Column, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Live nodes that a text refers to: of the top 4k, at most k that are no turns, sessions or inferences."""
    best = (F.desc("score"), F.asc("id"))
    top = top_scored(g, query, 4 * k)
    return top.where((F.col("score") >= threshold) & ~F.col("deprecated") & ~F.col("type_id").isin(TURN, "SESSION", "INFERRED")).orderBy(*best).limit(k)


def references_of(nodes: DataFrame, turns: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """(id, target) for each of turns (id, text): what `references` finds for the text's first 1000 characters."""
    asked = turns.select("id", hash_embedding(F.substring(F.coalesce("text", F.lit("")), 1, REFERRING_CHARS)).alias("embedding"))
    near = nearest_of(asked, nodes, 4 * k, threshold)
    kinds = nodes.where("embedding is not null and not deprecated").where(~F.col("type_id").isin(TURN, "SESSION", "INFERRED")).select(F.col("id").alias("other"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return near.join(kinds, "other", "left_semi").withColumn("nth", nth).where(F.col("nth") <= k).select("id", F.col("other").alias("target"))


def rendered(show_session: bool = False) -> Column:
    """A turn as `[turn i | role | time]` and its text, cut after 600 characters."""
    at = F.replace(F.substring(F.coalesce("timestamp", F.lit("")), 1, 19), F.lit("T"), F.lit(" "))
    parts = [F.concat(F.lit("turn "), F.coalesce(F.col("turn_index").cast("string"), F.lit("?"))), F.coalesce("role", F.lit("?"))]
    parts += [F.concat(F.lit("session:"), F.substring(F.coalesce("session_id", F.lit("")), 1, 8))] * show_session
    head = F.concat_ws(" | ", *(F.when(p != "", p) for p in [*parts, at]))
    text = F.trim(F.coalesce("text", F.lit("")))
    return F.concat(F.lit("["), head, F.lit("]\n"), F.when(F.length(text) > TURN_CHARS, F.concat(F.substring(text, 1, TURN_CHARS), F.lit("…"))).otherwise(text))


def context_block(g: Graph, query: Column, session_id: str, recent: int = 6, k: int = 4, threshold: float = 0.55) -> DataFrame:
    """(section, id, block): recent turns of the session, then similar ones of others; and a row
    `total` that counts all turns, deprecated ones included."""
    turns = turns_of(g)
    now = recent_turns(turns, recent, session_id).select(F.lit("recent").alias("section"), "id", rendered().alias("block"))
    hits = semantic_turns(g, query, session_id, k, threshold).select("id")
    old = turns.join(hits, "id", "left_semi").select(F.lit("semantic").alias("section"), "id", rendered(True).alias("block"))
    total = g.nodes.where(F.col("type_id") == TURN).agg(F.count("*").cast("string").alias("block")).select(F.lit("total").alias("section"), F.lit("").alias("id"), "block")
    return now.unionByName(old).unionByName(total)


def checkpoint(turns: DataFrame, exchanges: int = 20) -> DataFrame:
    """(session_id, summary): a session's newest 2 x exchanges turns, in order, cut to 4000 characters."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("turn_index")))
    kept = turns.withColumn("nth", nth).where(F.col("nth") <= 2 * exchanges)
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.substring("text", 1, CHECKPOINT_TURN_CHARS))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("nth")).alias("o"), line.alias("line")))), lambda x: x["line"])
    return kept.groupBy("session_id").agg(F.substring(F.array_join(ordered, "\n---\n"), 1, CHECKPOINT_CHARS).alias("summary"))


def latest_checkpoint(g: Graph, as_of: datetime, max_age: timedelta = timedelta(seconds=600)) -> DataFrame:
    """The newest checkpoint of any session that isn't older than max_age."""
    rows = g.live.where((F.col("type_id") == "CHECKPOINT") & (F.col("created_at") >= F.lit(as_of - max_age).cast("timestamp_ntz")))
    return rows.orderBy(F.desc("created_at"), "id").limit(1).select("id", "created_at", P.text(F.col("properties"), "summary").alias("summary"))


def context_usage(usage: DataFrame, limit: int) -> DataFrame:
    """One row (percent) from the last row (seq, total) whose total is positive."""
    return usage.where("total > 0").agg(F.max_by("total", "seq").alias("total")).select(F.floor(F.col("total") * 100 / limit).cast("long").alias("percent"))
