"""Cosine similarity, the deterministic text embedding, and block-wise nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMENSIONS = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; an empty vector gives 0, a zero norm counts as 1."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    norm = F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dot(a, b) / norm)


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The text's SHA-256 bytes repeated over the dimensions, each scaled to [-1, 1], normalised."""
    byte = F.transform(F.array(F.sha2(text.cast("binary"), 256)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1))
    raw = F.slice(F.flatten(F.array_repeat(byte[0], -(-dimensions // 32))), 1, dimensions)
    # Lambda variables hold the vector and its norm, so that neither is computed for each element.
    both = F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))
    return F.transform(both, lambda s: F.transform(s["v"], lambda x: (x / s["norm"]).cast("float")))[0]


# What a turn's embedding is made of: its type, its role, and so many characters of its text.
TURN, EMBEDDED_CHARS = "CONVERSATION_TURN", 800


def turn_embedding(role: Column, text: Column) -> Column:
    """A conversation turn's embedding."""
    blank = F.lit("")
    return hash_embedding(F.concat(F.lit(f"{TURN} "), F.coalesce(role, blank), F.lit(": "), F.substring(F.coalesce(text, blank), 1, EMBEDDED_CHARS)))


def _blocks(vectors: DataFrame, parts: DataFrame, by: list[str], name: str) -> DataFrame:
    """vectors (id, seq, embedding, and columns `by`) as rows (by, part, name) of the vectors of one part each."""
    dealt = vectors.join(parts, by) if by else vectors.crossJoin(F.broadcast(parts))  # one row
    return dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).groupBy(*by, "part").agg(F.collect_list(F.struct("id", "seq", "embedding")).alias(name))


#: Rows of a block that are multiplied out at once, and near ties that are scored again at once.
ROWS, AGAIN = 256, 4096


def _unit(side, order: np.ndarray | None = None) -> np.ndarray:
    """A block's vectors divided by their norms, a zero norm counting as 1."""
    m = side.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(side), -1)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    m /= np.where(norm == 0, 1, norm)
    return m if order is None else m[order]


def _best_of_blocks(xs, ys, k: int, threshold: float, older: bool):
    """Batches (id, other, score): for each of the block xs at most k of the block ys, smaller ids first among equal
    scores. What may be among the k best is scored pair by pair once more: a matrix product gives equal
    vectors slightly different scores at different places."""
    import pyarrow as pa

    names = np.array(xs.field("id").to_pylist() + ys.field("id").to_pylist(), object)
    place = np.unique(names, return_inverse=True)[1] if len(names) else np.empty(0, np.int64)  # names are slow to compare
    x_place, y_place = place[: len(xs)], place[len(xs) :]
    order = np.argsort(y_place, kind="stable")
    y_place, xm, ym = y_place[order], _unit(xs), _unit(ys, order)
    x_names, y_names = xs.field("id"), ys.field("id").take(pa.array(order))
    x_seq, y_seq = xs.field("seq").to_numpy(zero_copy_only=False), ys.field("seq").to_numpy(zero_copy_only=False)[order]
    top = min(k, len(ys))
    for at in range(0, len(xs) if top else 0, ROWS):
        rows = slice(at, at + ROWS)
        score = xm[rows] @ ym.T
        out_of_question = ~(score >= threshold - 1e-9)
        if older:
            seq, name = x_seq[rows, None], x_place[rows, None]
            out_of_question |= (y_seq > seq) | ((y_seq == seq) & (y_place >= name))
        score[out_of_question] = -np.inf
        edge = -np.partition(-score, top - 1, 1)[:, top - 1 : top]
        i, j = np.nonzero((score >= edge - 1e-9) & ~out_of_question)
        found = np.empty(len(i))
        for n in range(0, len(i), AGAIN):
            found[n : n + AGAIN] = np.einsum("ij,ij->i", xm[at + i[n : n + AGAIN]], ym[j[n : n + AGAIN]])
        best = np.lexsort((j, -found, i))
        i, j, found = i[best], j[best], found[best]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < top
        if kept.any():
            yield pa.RecordBatch.from_arrays([x_names.take(pa.array(at + i[kept])), y_names.take(pa.array(j[kept])), pa.array(found[kept])], names=["id", "other", "score"])


def _best(pairs: DataFrame, k: int, threshold: float, older: bool) -> DataFrame:
    """(id, other, score) from pairs of blocks (xs, ys): for each of xs the k best of ys at or over the threshold,
    with `older` of those alone that come before it by (seq, id). A worker holds the pairs that Spark sends at once
    (spark.sql.execution.arrow.maxBytesPerBatch) and ROWS rows of scores, however many rows there are."""

    def multiply(it):
        for batch in it:
            for row in range(batch.num_rows):
                yield from _best_of_blocks(batch.column(0)[row].values, batch.column(1)[row].values, k, threshold, older)

    found = pairs.mapInArrow(multiply, "id string, other string, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "score")


#: Ranges of seq at most: each is a literal of the plan, and large ones are cut into blocks anyway.
RANGES = 64


def nearest_older(vectors: DataFrame, k: int, threshold: float, block: int = 2048) -> DataFrame:
    """For every vector (id, seq, embedding) the k nearest among those of smaller seq, at or over the threshold.

    Vectors are cut into ranges of seq, large ranges into blocks by a hash; only blocks of the same or an
    earlier range are multiplied out, once, and keep at most k rows for a vector, so no pair of vectors
    becomes a row of its own. Of equal seq the smaller id is older. Rows (id, older, score); ties go to the smaller id.
    """
    vectors = vectors.where("embedding is not null").select("id", "seq", "embedding")
    n = max(1, min(RANGES, -(-vectors.count() // block)))
    cuts = sorted(set(vectors.approxQuantile("seq", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    ranged = vectors.withColumn("b", F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("seq"))) if cuts else F.lit(0))
    parts = ranged.groupBy("b").agg(F.ceil(F.count("*") / block).alias("parts"))
    left = _blocks(ranged, parts, ["b"], "xs").select("xs", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("y"))
    pairs = left.join(_blocks(ranged, parts, ["b"], "ys").withColumnRenamed("b", "y"), "y").select("xs", "ys")
    return _best(pairs, k, threshold, True).withColumnRenamed("other", "older")


def nearest_of(queries: DataFrame, vectors: DataFrame, k: int, threshold: float, block: int = 2048) -> DataFrame:
    """For every query (id, embedding) the k nearest vectors (id, embedding), at or over the threshold: rows (id,
    other, score). Blocks of queries meet blocks of vectors; each pair keeps at most k rows for a query."""
    sides = []
    for side, name in ((queries, "xs"), (vectors, "ys")):
        side = side.where("embedding is not null").select("id", F.lit(0).alias("seq"), "embedding")
        parts = max(1, -(-side.count() // block))
        sides.append((_blocks(side, side.sparkSession.range(1).select(F.lit(parts).alias("parts")), [], name), parts))
    (xs, _), (ys, n) = sides
    left = xs.select("xs", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part")).repartition(n, "part")  # packed, all of it would be one task's
    return _best(left.join(ys, "part").select("xs", "ys"), k, threshold, False)
