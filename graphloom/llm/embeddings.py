"""Embedding near-duplicates by an epsilon grid order join: exact.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t) of each other, and so do
their projections on the leading principal axes of all vectors. Vectors are sorted by
the grid cells (of side eps) of these projections; two vectors whose cells differ by
more than one on any axis can't be near. The sorted sequence is cut into blocks, pairs
of blocks whose cell boxes may touch are joined, and within a pair both intervals are
halved recursively, provably distant halves are skipped and small ones multiplied out.

Equal vectors are joined once and counted with their number. A pair of blocks returns
a count for each vector and a spanning forest of its links, never the pairs.

Cases: a null label, a vector that is null, zero, or holds null or non-finite
components, and a null id link with nothing (component: the row's own id; kept then,
but for a null id, whose component is null and kept false); vectors of different
length don't link; rows with equal ids are one vertex, each row counts as a vector; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, settled

AXES, BLOCK, LEAF = 6, 1024, 128


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """The leading principal axes of all vectors, by dimension: sums of products are added up on
    executors, and one matrix for each dimension reaches the driver."""

    def rows(sums: dict[int, np.ndarray]):
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["d", "x"])

    def multiply(it):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for _, x in by_dimension(b.column(0)).values():
                u = np.hstack((unit(x), np.ones((len(x), 1))))
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + u.T @ u
        yield from rows(sums)

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for d, raw in zip(b.column(0).to_pylist(), b.column(1)):
                sums[d] = sums.get(d, 0) + np.frombuffer(raw.as_buffer(), np.float64)
        yield from rows(sums)

    schema, out = "d int, x binary", {}
    for r in arrow_map(arrow_map(reps.select("embedding"), multiply, schema).repartition("d"), add, schema).collect():
        d = r["d"]
        s = np.frombuffer(r["x"], np.float64).reshape(d + 1, d + 1)
        n, mean = s[d, d], s[d, :d] / s[d, d]
        _, axes = np.linalg.eigh(s[:d, :d] / n - np.outer(mean, mean))
        out[d] = axes[:, ::-1][:, :AXES]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_dimension(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of each vector length in a column of lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = (rows, flat[at[rows][:, None] + np.arange(d)])
    return out


def blocks_of(reps: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Blocks of the sorted sequence: (block, part, lo, hi, ids, weights, cells, vectors)."""

    def cells(it):
        for b in it:
            out = np.zeros((b.num_rows, AXES), np.int64)
            for rows, x in by_dimension(b.column(3)).values():
                p = np.floor(unit(x) @ axes[x.shape[1]] / eps).astype(np.int64)
                out[rows, : p.shape[1]] = p
            dims = b.column(3).value_lengths().cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, dims, *(pa.array(c) for c in out.T)], names=["rep", "weight", "label", "embedding", "dims", *(f"c{k}" for k in range(AXES))])

    order = ["label", "dims", *(f"c{k}" for k in range(AXES)), "rep"]  # rep splits a cell of many vectors
    schema = "rep long, weight long, label string, embedding array<double>, dims int, " + ", ".join(f"c{k} long" for k in range(AXES))
    placed = arrow_map(reps.select(F.col("cid").alias("rep"), "weight", F.col("label").cast("string"), F.col("embedding").cast("array<double>")), cells, schema)

    def cut(it):
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, []

        def block():
            nonlocal made
            made += 1
            ids, weights, label, vectors, dims, c = (np.concatenate([h[k] for h in held]) if k not in (2, 4) else held[0][k] for k in range(6))
            held.clear()
            return [f"{task}-{made}", f"{label}/{dims}", c.min(0).tolist(), c.max(0).tolist(), ids.tobytes(), weights.tobytes(), c.tobytes(), vectors.tobytes()]

        names = ["block", "part", "lo", "hi", "ids", "weights", "cells", "vectors"]
        s, v, y = pa.string(), pa.list_(pa.int64()), pa.binary()

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((s, s, v, v, y, y, y, y))], names=names)

        for b in it:
            label, dims = np.array(b.column(2).to_pylist(), object), b.column(4).to_numpy()
            ids, weights = b.column(0).to_numpy(), b.column(1).to_numpy()
            c = np.stack([b.column(5 + k).to_numpy() for k in range(AXES)], 1)
            edge = np.flatnonzero((label[1:] != label[:-1]) | (dims[1:] != dims[:-1])) + 1
            for i, j in zip([0, *edge], [*edge, len(label)]):
                if i == j:
                    continue
                if held and (held[0][2] != label[i] or held[0][4] != dims[i]):
                    yield rows([block()])
                vectors = unit(b.column(3).slice(i, j - i).flatten().to_numpy().reshape(j - i, -1))
                while i < j:
                    room = BLOCK - sum(len(h[0]) for h in held)
                    k = min(j, i + room)
                    held.append((ids[i:k], weights[i:k], label[i], vectors[: k - i], dims[i], c[i:k]))
                    vectors, i = vectors[k - i :], k
                    if k and sum(len(h[0]) for h in held) == BLOCK:
                        yield rows([block()])
        if held:
            yield rows([block()])

    sequence = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return arrow_map(sequence, cut, "block string, part string, lo array<long>, hi array<long>, ids binary, weights binary, cells binary, vectors binary")


def join_intervals(a: tuple, b: tuple, threshold: float, same: bool):
    """Links between two intervals (vectors, cells): yields the places of linked pairs, in small lots."""
    todo = [(0, len(a[0]), 0, len(b[0]))]
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i:
            continue  # the mirror image is taken
        if ((a[1][i:j].min(0) > b[1][k:m].max(0) + 1) | (b[1][k:m].min(0) > a[1][i:j].max(0) + 1)).any():
            continue
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero(a[0][i:j] @ b[0][k:m].T >= threshold)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            yield x, y
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]


def join_blocks(pairs: DataFrame, threshold: float) -> DataFrame:
    """From pairs of blocks: rows (a, null, n), n vectors link with a; rows (a, b, null), a forest's links."""

    def run(it):
        for batch in it:
            columns = [batch.column(k) for k in range(9)]
            for row in range(batch.num_rows):
                same = columns[0][row].as_py()
                (ida, wa, ca, va), (idb, wb, cb, vb) = ([np.frombuffer(c[row].as_buffer(), t) for c, t in zip(columns[k : k + 4], (np.int64, np.int64, np.int64, np.float64))] for k in (1, 5))
                a = (va.reshape(len(ida), -1), ca.reshape(len(ida), -1))
                b = (vb.reshape(len(idb), -1), cb.reshape(len(idb), -1))
                na, nb = np.zeros(len(ida), np.int64), np.zeros(len(idb), np.int64)
                root = np.arange(len(ida) + len(idb))
                forest: list[tuple[int, int]] = []

                def find(x):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for x, y in join_intervals(a, b, threshold, same):
                    np.add.at(na, x, wb[y])
                    np.add.at(nb, y, wa[x])
                    off = 0 if same else len(ida)
                    flat = flatten(root, x, y + off)
                    while len(flat):  # pairs of different trees
                        u, v = int(flat[0, 0]), int(flat[0, 1])
                        ru, rv = find(u), find(v)
                        if ru != rv:
                            root[max(ru, rv)] = min(ru, rv)
                            forest.append((u, v))
                        flat = flatten(root, flat[1:, 0], flat[1:, 1])
                ids = np.concatenate((ida, idb))
                if same:
                    na, nb = na + nb, nb * 0
                n = np.concatenate((na, nb))
                hit = np.flatnonzero(n)
                f = np.array(forest, np.int64).reshape(-1, 2)
                left = np.concatenate((ids[hit], ids[f[:, 0]]))
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array([None] * len(hit) + ids[f[:, 1]].tolist(), pa.int64()), pa.array(n[hit].tolist() + [None] * len(f), pa.int64())], names=["a", "b", "n"])

    return arrow_map(pairs, run, "a long, b long, n long")


def flatten(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Those of the pairs whose ends lie in different trees; root is flattened on the way."""
    while True:
        up = root[root]
        if (up == root).all():
            break
        root[:] = up
    apart = root[x] != root[y]
    return np.stack((x[apart], y[apart]), 1)


def embedding_links(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vectors' rows (vec_id, embedding, label) as (vec_id, n_links, component_id, kept)."""
    sound = F.expr("label is not null and embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("sound", F.coalesce(sound, F.lit(False)))
    # cid stands for a class of equal vectors; ids may stand in several classes, which they join.
    classes = settled(rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("cid", F.monotonically_increasing_id()))
    eps = float(np.sqrt(2 - 2 * threshold) * (1 + 1e-6))
    axes = principal_axes(classes)
    blocks = settled(blocks_of(classes, axes, eps))
    meta = blocks.select("block", "part", "lo", "hi")
    # Blocks meet by their cells on the two leading axes; along the sequence most have one cell or few.
    cells = lambda margin: F.explode(F.expr(f"flatten(transform(sequence(lo[0] - {margin}, hi[0] + {margin}), i -> transform(sequence(lo[1] - {margin}, hi[1] + {margin}), j -> struct(i, j))))")).alias("cell")
    x = meta.select(F.col("block").alias("xb"), "part", F.col("lo").alias("xl"), F.col("hi").alias("xh"), cells(1))
    y = meta.select(F.col("block").alias("yb"), "part", F.col("lo").alias("yl"), F.col("hi").alias("yh"), cells(0))
    touch = F.expr("xb <= yb and forall(sequence(0, size(xl) - 1), k -> xl[k] <= yh[k] + 1 and yl[k] <= xh[k] + 1)")
    pairs = x.join(y, ["part", "cell"]).where(touch).select("xb", "yb").distinct()
    a = blocks.select(F.col("block").alias("xb"), *(F.col(c).alias(f"x_{c}") for c in ("ids", "weights", "cells", "vectors")))
    b = blocks.select(F.col("block").alias("yb"), *(F.col(c).alias(f"y_{c}") for c in ("ids", "weights", "cells", "vectors")))
    joined = pairs.join(a, "xb").join(b, "yb").select((F.col("xb") == F.col("yb")).alias("same"), "x_ids", "x_weights", "x_cells", "x_vectors", "y_ids", "y_weights", "y_cells", "y_vectors")
    found = settled(join_blocks(joined, threshold))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "cid")
    known = classes.join(counts, "cid", "left").select("label", "embedding", "rep", "weight", "linked")
    same = rows.label.eqNullSafe(known.label) & rows.embedding.eqNullSafe(known.embedding) & rows.sound
    placed = rows.join(known, same, "left").select("vec_id", "rep", "weight", "linked")
    name = classes.select("cid", "rep")
    forest = found.where("b is not null").select("a", "b").join(name.withColumnsRenamed({"cid": "a", "rep": "ra"}), "a").join(name.withColumnsRenamed({"cid": "b", "rep": "rb"}), "b")
    twice = rows.where("sound").groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select("vec_id")
    joining = placed.where("rep is not null").join(twice, "vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    label = components(forest.select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(joining), "rep")
    component = F.coalesce("component", "rep", "vec_id")
    return placed.join(label, "rep", "left").select(
        "vec_id", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )


ORACLE_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.98),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as c from r group by a), n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0) as n_links, c.c as component_id, c.c = vec_id as kept from embeddings join c on c.a = vec_id left join n on n.a = vec_id
"""
