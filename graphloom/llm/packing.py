"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Best-fit decreasing never looks at a piece but for its length, so it runs over the
lengths' histogram: at most `capacity` rows reach the driver, whatever the corpus. A
segment tree over remaining capacities finds the tightest open bin in logarithmic
time; bins alike are kept as runs, and a run of equal pieces goes into a run of equal
bins in one step, with the same outcome as placing them one at a time. The plan says
where the r-th piece of a length goes; executors number the pieces of each length and
look their places up. The plan's size follows the number of lengths, not of pieces.

Texts of any length and any white space are encoded whole. Cases: null and empty texts are one piece of the closing id alone; repeated rows are
packed as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytebpe import PATTERN, ByteBPE, byte_alphabet
from .common import arrow_map, settled, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


class CapacityTree:
    """A segment tree over remaining capacities; marks those that open bins have."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def mark(self, r: int, there: bool) -> None:
        i = self.size + r
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity of at least `least`."""
        i = self.size + least
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, rank from, rank to, first sequence, offset), and the number of sequences.

    A piece of this length whose rank lies in the row goes to sequence `first + rank -
    rank from` at the offset.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs (first sequence, how many)
    plan: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def keep(r: int, first: int, n: int) -> None:
        if r and n:
            open_bins.setdefault(r, []).append((first, n))
            tree.mark(r, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[r].pop()
                if not open_bins[r]:
                    tree.mark(r, False)
            each = r // length  # a bin that stays the tightest takes the next piece as well
            full = min(n, left // each)
            for j in range(each if full else 0):
                plan.append((length, rank + j * full, rank + (j + 1) * full, first, capacity - r + j * length))
            rank += full * each
            left -= full * each
            keep(r - each * length, first, full)
            if full < n and left and left < each:
                for j in range(left):
                    plan.append((length, rank + j, rank + j + 1, first + full, capacity - r + j * length))
                keep(r - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            keep(r, first + full, n - full)
    return plan, bins


#: White space of this length is left to the byte-level encoder of `bytebpe`: tiktoken's pattern backtracks in it
#: and gives up on some hundred thousand characters. The characters are those of its `\\s`, a fixed value.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000}")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """ids of the tokenizers file at path: its vocabulary run by tiktoken, which is several times
    faster; special tokens written in a text are matched first."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: _byte_level(path).encode(text) if LONG_SPACE.search(text) else enc.encode(text, allowed_special="all")


@lru_cache(maxsize=2)
def _byte_level(path: str) -> ByteBPE:
    return ByteBPE(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every whole text; `k` counts the pieces of a length within a task."""

    def cut(it):
        from pyspark import TaskContext

        encode, part, seen = _encoder(path), TaskContext.get().partitionId(), {}
        for batch in it:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                ids = np.array([*encode(text.decode("utf-8", "replace")), end_id], "<u4")
                head = len(ids) % capacity
                edges = [0, *([head] if head else []), *range(head + capacity, len(ids) + 1, capacity)]
                raw = memoryview(ids.tobytes())
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    k = seen[b - a] = seen.get(b - a, -1) + 1
                    out.append((doc_id, piece, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), part, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES)


NAMES = [c.split()[0] for c in PIECES.split(", ")]
TYPES = [{"long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in PIECES.split(", ")]


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with end_id; only documents longer than capacity are cut, the
    first piece taking what full pieces leave over.
    """
    spark = docs.sparkSession
    cut = settled(pieces(docs, path, capacity, end_id))  # so that ranks stay as they were dealt
    dealt = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = dealt.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, _ = best_fit_decreasing(counts, capacity)
    places = spark.createDataFrame(plan, "length long, lo long, hi long, first long, offset long")
    if len(plan) <= 64 * capacity:  # as with every histogram seen; a longer plan is joined by shuffle
        places = F.broadcast(places)
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("k"))
    return ranked.join(places, (ranked.length == places.length) & (ranked["rank"] >= places.lo) & (ranked["rank"] < places.hi)).select(
        "doc_id", "piece", "start", ranked.length, "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )
