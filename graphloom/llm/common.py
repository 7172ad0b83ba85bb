"""Shared plumbing of the training-data operators.

Arrow batches reach Python with text as UTF-8 bytes; `word_table` finds the
words of a whole batch with a handful of numpy passes, so no operator loops
over bytes or words in Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that a Python worker takes at once: working memory is some fifty times the bytes. Only a row that
#: is longer by itself is more. Spark bounds what it sends by spark.sql.execution.arrow.maxBytesPerBatch.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
SENT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

U64 = np.uint64


def bounded(batches, size: int = BATCH_BYTES):
    """The batches' rows, in lots of at most BATCH_ROWS rows and so many bytes."""
    todo = []
    for b in batches:
        todo.append(b)
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and (b.num_rows > BATCH_ROWS or b.nbytes > size):
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def arrow_map(df: DataFrame, fn: Callable, schema: str | T.StructType, size: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with batches small enough for long texts. Unless the session has a number of its own, Spark sends it
    BATCH_ROWS rows at once from here on: its 10,000 of long texts lie in the executor's JVM and again in Python."""
    conf = df.sparkSession.conf
    if conf.get(SENT_ROWS, None) is None:
        conf.set(SENT_ROWS, BATCH_ROWS)
    return df.mapInArrow(lambda it: fn(bounded(it, size)), schema)


def with_text_columns(docs: DataFrame, keep: list[str], fn: Callable, columns: str, size: int = BATCH_BYTES) -> DataFrame:
    """docs' columns `keep`, and those that fn makes of the text column of each batch."""
    made = T.StructType.fromDDL(columns)
    chosen = docs.select(*(docs[f"`{c}`"] for c in keep), docs["text"].cast("string").alias("_text_read"))

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *fn(b.column(b.num_columns - 1))], names=[*b.schema.names[:-1], *made.names])

    return arrow_map(chosen, run, T.StructType([*chosen.schema.fields[:-1], *made.fields]), size)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column one after another as bytes, each followed by a
    space, and the place where each begins (one more entry than texts)."""
    texts = text_bytes(column)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    data = b" ".join(texts) + b" " if texts else b""
    return np.frombuffer(data, np.uint8), at


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: a bijection of unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Two odd multipliers of the polynomial word hash and their inverses modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n, kept between batches."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.empty(size, U64)
        down = np.empty(size, U64)
        for table, base in ((up, _P), (down, _P_INV)):
            table[0] = 1
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                table[filled : filled + step] = table[:step] * U64(pow(base, filled, 1 << 64))
                filled += step
        _powers[0] = have = (up, down)
    return have


#: Bytes hashed at once; longer inputs are cut between texts or, within one text, between words.
CHUNK = 1 << 20


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]; equal words, equal hashes.

    A polynomial in the bytes, taken from prefix sums so that all words cost a few
    numpy passes, then mixed with the word's length.
    """
    out = np.empty(len(starts), U64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        stop = int(np.searchsorted(ends, base + CHUNK, "right"))
        stop = max(stop, k + 1)  # a word longer than CHUNK is taken alone
        s, e = starts[k:stop] - base, ends[k:stop] - base
        n = int(e[-1])
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(mix_byte[data[base : base + n]] * up[:n], out=sums[1:])
        h = (sums[e] - sums[s]) * down[s]
        out[k:stop] = mix64(h ^ mix64((e - s).astype(U64)))
        k = stop
    return out


def leading_bytes(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n (at most 8) bytes from each start, packed into one number; zeros past data's end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(starts), U64)
    for i in range(n):
        out |= padded[starts + i].astype(U64) << U64(8 * i)
    return out


#: A random odd 64-bit value for each byte, so that the polynomial's low bits mix.
mix_byte = mix64(np.arange(1, 257, dtype=U64)) | U64(1)

#: Bytes that separate words for `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased.
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = False
NOT_WORD[0x61:0x7B] = False
NOT_WORD[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, at: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of `joined` data, and the first word of each text
    (one more entry than texts)."""
    gap = gaps[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # data ends with a space, so words are closed
    return starts, ends, np.searchsorted(starts, at)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder: its lineage is cut,
    and a lost executor takes nothing with it."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a new folder below the shared checkpoint folder: as `settled`, but columns are packed
    and read one by one."""
    uri = scratch_uri(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.parquet(uri)


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(column: str, folds: int, fold: int):
    """crc32 of an id's decimal text modulo folds equals fold (null counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == fold


def components(links: DataFrame, ids: str = "id") -> DataFrame:
    """(id, component): the smallest id reachable through links (columns a, b).

    Min-label propagation with pointer jumping: every round each vertex takes the
    smallest label in its neighbourhood, then the label of that label, so rounds grow
    with the logarithm of a component's diameter. State is checkpointed every round;
    nothing is collected but one flag. No links give no rows.
    """
    edges = settled(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settled(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("id"), "l"))
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("l").alias("n"))
        step = labels.join(near, labels.id == near.a).select("id", "l", F.least("l", "n").alias("m"))
        jump = labels.select(F.col("id").alias("m"), F.col("l").alias("j"))
        new = settled(step.join(jump, "m", "left").select("id", F.least("m", F.coalesce("j", "m")).alias("l"), (F.least("m", F.coalesce("j", "m")) < F.col("l")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("id", "l")
        if not moved:
            return labels.select(F.col("id").alias(ids), F.col("l").alias("component"))
