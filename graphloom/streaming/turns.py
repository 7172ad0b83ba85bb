"""Turns as they are said: a stateful stream that numbers a session's messages and links each to the one before.

State holds, for each session, its last index, the last turn's id and the last message taken: a message that a source
replays is ignored, also after a restart from the checkpoint. A session is forgotten by a timer when the watermark has
passed its last message by `idle`, so state follows the sessions that are alive. Messages of one session come in the order of seq across batches, as a transcript
that is appended to; within a batch they may come in any order.

Cases: blank texts get no index; a null seq, session or time is skipped; messages behind the watermark are late and skipped; of messages with one seq the first by (role, text) is
taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TURNS = "session_id string, turn_index long, id string, previous string, role string, text string, opens boolean"
#: State with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Numbering(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "turn_index long, id string, seq long, ends long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, before, seen, ends = self.last.get() if self.last.exists() else (-1, None, None, None)
        new = pd.concat(list(rows)).sort_values(["seq", "role", "text"], kind="stable").drop_duplicates("seq")
        out = []
        for seq, role, text in zip(new["seq"], new["role"], new["text"]):
            if seen is not None and seq <= seen:
                continue
            seen, at = seq, at + 1
            turn = f"turn:{key[0]}:{at}"
            out.append((key[0], at, turn, before, role, text, at == 0))
            before = turn
        if out:
            if ends is not None:
                self.handle.deleteTimer(int(ends))
            ends = int(max(new["ms"].max(), (ends or self.idle_ms) - self.idle_ms)) + self.idle_ms
            self.handle.registerTimer(ends)
            self.last.update((int(at), before, int(seen), ends))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TURNS.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def numbered(messages: DataFrame, idle: str = "7 days", delay: str = "1 day") -> DataFrame:
    """A stream of messages (session_id, seq, role, text, at) as turns with their index and the id of the turn before."""
    idle_ms = pd.Timedelta(idle) // pd.Timedelta(1, "ms")
    said = messages.withWatermark("at", delay).where("session_id is not null and seq is not null and at is not null and trim(text) <> ''")
    rows = said.select("session_id", F.col("seq").cast("long").alias("seq"), "role", "text", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("session_id").transformWithStateInPandas(Numbering(idle_ms), outputStructType=TURNS, outputMode="append", timeMode="eventTime")


MESSAGES = "session_id string, seq long, role string, text string, at timestamp"


def ingest(spark: SparkSession, messages: str, turns: str, checkpoint: str, idle: str = "7 days", delay: str = "1 day") -> StreamingQuery:
    """Takes what is new in a folder of Parquet messages to a folder of turns, and stops; the checkpoint makes the next
    call go on where this one ended."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 64).parquet(messages)
        q = numbered(stream, idle, delay).writeStream.outputMode("append").format("parquet").option("path", turns).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return q
