"""Neighbours among copies: what a pair of blocks returns, and in which order."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.functions import vector


def block(ids, vectors):
    return pa.array([{"id": i, "seq": 0, "embedding": v.tolist()} for i, v in zip(ids, vectors)], pa.struct([("id", pa.string()), ("seq", pa.int32()), ("embedding", pa.list_(pa.float32()))]))


def test_copies_return_k_rows_each():
    """All pairs of 600 copies tie: k rows for each come back, no more than ROWS * k at once."""
    v = np.tile(np.random.default_rng(3).normal(size=32).astype(np.float32), (600, 12))
    ids = [f"v{i:03}" for i in range(600)]
    for older in (False, True):
        got = list(vector._best_of_blocks(block(ids, v), block(ids[::-1], v), 3, 0.5, older))
        assert max(b.num_rows for b in got) <= 3 * vector.ROWS
        rows = [(r["id"], r["other"]) for b in got for r in b.to_pylist()]
        assert rows == [(i, o) for n, i in enumerate(ids) for o in ids[: min(n, 3) if older else 3]]


def test_equal_vectors_tie_wherever_they_stand(spark):
    """Copies of five vectors, dealt to blocks: of equal ones the smallest ids are nearest, as in SQL."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5, 31)).astype(np.float32)
    rows = [(f"v{i:04}", base[i % 5].tolist()) for i in rng.permutation(603)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = vector.nearest_of(df, df, 4, 0.99, block=97).groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("near"), F.count_distinct("score").alias("scores")).collect()
    assert len(got) == 603
    for r in got:
        k = int(r["id"][1:]) % 5
        assert r["near"] == [f"v{k + 5 * n:04}" for n in range(4)] and r["scores"] == 1
