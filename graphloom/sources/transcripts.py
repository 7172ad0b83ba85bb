"""Transcripts: JSON Lines of heterogeneous messages, read as VARIANT.

A line is an object with a type and a message: an object, or that object's JSON text. A message's content is text, or
a list of blocks of which those of type `text` count, joined by a space; its usage holds counters of tokens.

Cases: lines that aren't JSON objects, and messages that aren't objects, are skipped as they stand; null content is
empty; blocks that aren't objects don't count; counters that are missing or no numbers count 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The counters whose sum is the context in use, and characters of a user's text that are kept.
COUNTERS = ("cache_read_input_tokens", "cache_creation_input_tokens", "input_tokens", "output_tokens")
USER_CHARS = 2000


def member(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def message_text(content: Column) -> Column:
    """The text of a message's content (VARIANT), without white space around it."""
    blocks = member(content, "$", "array<variant>")
    of_text = F.filter(blocks, lambda b: member(b, "$.type", "string") == "text")
    joined = F.array_join(F.transform(of_text, lambda b: F.coalesce(member(b, "$.text", "string"), F.lit(""))), " ")
    whole = F.when(blocks.isNotNull(), joined).otherwise(F.coalesce(member(content, "$", "string"), F.lit("")))
    return F.regexp_replace(whole, r"^\s+|\s+$", "")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, kind, role, text, tokens) of the messages of transcripts at path; seq orders a file's lines."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("seq"), F.try_parse_json("value").alias("v"),
    )
    parsed = lines.select("file", "seq", member(F.col("v"), "$.type", "string").alias("kind"), F.try_parse_json(member(F.col("v"), "$.message", "string")).alias("m"))
    sound = parsed.where(F.expr("schema_of_variant(m) like 'OBJECT%'"))
    tokens = sum((F.coalesce(member(F.col("m"), f"$.usage.{c}", "bigint"), F.lit(0)) for c in COUNTERS), F.lit(0).cast("bigint"))
    content = member(F.col("m"), "$.content", "variant")
    return sound.select("file", "seq", "kind", F.coalesce(member(F.col("m"), "$.role", "string"), "kind").alias("role"), message_text(content).alias("text"), tokens.alias("tokens"))


def last_messages(messages: DataFrame, chars: int = USER_CHARS) -> DataFrame:
    """(file, kind, text): a file's last message of each kind that isn't empty; a user's is cut after so many characters."""
    last = messages.where("text <> '' and kind is not null").groupBy("file", "kind").agg(F.max_by("text", "seq").alias("text"))
    return last.withColumn("text", F.when(F.col("kind") == "user", F.substring("text", 1, chars)).otherwise(F.col("text")))


def context_in_use(messages: DataFrame, limit: int) -> DataFrame:
    """(file, percent): the share of the limit that a file's last message with a positive sum of counters tells; else 0."""
    last = messages.groupBy("file").agg(F.max_by(F.when(F.col("tokens") > 0, F.col("tokens")), F.when(F.col("tokens") > 0, F.col("seq"))).alias("tokens"))
    return last.select("file", F.floor(F.coalesce("tokens", F.lit(0)) * 100 / limit).cast("long").alias("percent"))


def last_messages_in_context(messages: DataFrame, limit: int, chars: int = USER_CHARS) -> DataFrame:
    """(file, kind, text, percent): last_messages with their file's context_in_use, from one pass over the messages."""
    told = F.when(F.col("tokens") > 0, F.struct("seq", "tokens"))
    last = messages.groupBy("file", "kind").agg(F.max_by("text", F.when(F.col("text") != "", F.col("seq"))).alias("text"), F.max(told).alias("told"))
    last = last.withColumn("tokens", F.coalesce(F.max("told").over(Window.partitionBy("file"))["tokens"], F.lit(0)))
    cut = F.when(F.col("kind") == "user", F.substring("text", 1, chars)).otherwise(F.col("text"))
    return last.where("kind is not null and text is not null").select("file", "kind", cut.alias("text"), F.floor(F.col("tokens") * 100 / limit).cast("long").alias("percent"))


def write_transcripts(turns: DataFrame, path: str) -> None:
    """turns (session_id, turn_index, role, text, usage: a struct of counters or null) as a folder of lines for each session,
    in order; the text becomes one block."""
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", block.alias("content"), "usage").alias("message")))
    turns.select("session_id", "turn_index", line.alias("value")).repartition("session_id").sortWithinPartitions("session_id", "turn_index").select("session_id", "value").write.partitionBy("session_id").text(path)
