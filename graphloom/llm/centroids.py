"""Centroid clustering by a dual-tree Lloyd iteration, exact.

The vectors are cut into blocks as they are read, and a cover tree over each block is stored once: a node holds a
centre and all points within its radius, its children's centres lie more than half its scale (a power of two) apart, and
the first child keeps the centre. Every round builds such a tree over the centroids and walks both: a pair of nodes
goes where no centroid of one can be as near to any vector of the other as a centroid already seen; pairs of leaves
that remain are compared in integers. Ties go to the smaller number, so pairs at equal distance are kept.

Of a round, counts and exact sums of each centroid travel: what reaches the driver is k times the length.

Cases: rows whose vector is null, has another length, or holds null or non-finite entries, or entries of 2**19 and
more (whose scaled squares no long adds up), are left out; repeated rows are vectors like others; of vectors with
equal ids, the first centroids take the one with smaller components; a null id's hash is that of `2:`; fewer vectors than
k give fewer centroids; an empty table gives no rows; other columns are ignored; sums that no long holds are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

K, ROUNDS, LENGTH, SCALE = 40, 5, 64, 256.0
#: Vectors of a block, and of a leaf at most (unless they are all equal).
BLOCK, LEAF = 1024, 8
#: Pairs of a vector and a centroid compared at once.
PAIRS = 1 << 13
#: Components up to this have exact products of doubles.
EXACT = 1 << 22


def distances(x: np.ndarray) -> np.ndarray:
    """Between all rows of one block."""
    if np.abs(x).max(initial=0) <= EXACT:
        v = x.astype(np.float64)
        n = (v * v).sum(1)
        return np.sqrt(n[:, None] + n[None, :] - 2 * (v @ v.T))
    return np.stack([np.sqrt(((x - row).astype(np.float64) ** 2).sum(1)) for row in x])


class Tree:
    """A cover tree: for each node its centre (a place in points), radius, interval of points and of children."""

    def __init__(self, order, centre, radius, lo, hi, first, last):
        self.order, self.centre, self.radius, self.lo, self.hi, self.first, self.last = order, centre, radius, lo, hi, first, last

    PARTS = (("order", np.int32), ("centre", np.int32), ("radius", np.float64), ("lo", np.int32), ("hi", np.int32), ("first", np.int32), ("last", np.int32))

    @classmethod
    def over(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        """points = x[order]; a node's points stand together, its children one after another."""
        gap = distances(x)
        order = np.arange(len(x))
        centre, radius, lo, hi, first, last = [0], [float(gap[0].max())], [0], [len(x)], [0], [0]
        k = 0
        while k < len(centre):
            if hi[k] - lo[k] > leaf and radius[k] > 0:
                near = 2.0 ** (np.ceil(np.log2(radius[k])) - 1)
                rest, at, pick = order[lo[k] : hi[k]].copy(), lo[k], centre[k]
                first[k] = len(centre)
                while len(rest):
                    d = gap[pick, rest]
                    own = rest[d <= near]
                    centre.append(int(pick))
                    radius.append(float(gap[pick, own].max()))
                    lo.append(at)
                    order[at : at + len(own)] = own
                    at += len(own)
                    hi.append(at)
                    first.append(0)
                    last.append(0)
                    rest = rest[d > near]
                    pick = rest[0] if len(rest) else -1
                last[k] = len(centre)
            k += 1
        place = np.empty(len(x), np.int32)
        place[order] = np.arange(len(x))
        return cls(*(np.asarray(v, t) for v, (_, t) in zip((order, place[centre], radius, lo, hi, first, last), cls.PARTS)))

    def dump(self) -> list[bytes]:
        return [getattr(self, name).tobytes() for name, _ in self.PARTS]

    @classmethod
    def load(cls, raw: list[bytes]) -> Tree:
        return cls(*(np.frombuffer(r, t) for r, (_, t) in zip(raw, cls.PARTS)))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    gap = a - b
    return (gap * gap).sum(1)


def unfold(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals: the number of the interval, and each place within."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """For each of a tree's points the number of the nearest centroid and the squared distance; and how many pairs
    of a point and a centroid were compared. centroids stand in their own tree's order."""
    number = over.order.astype(np.int64)
    bound = np.full(len(tree.lo), np.inf)  # on the distance of a node's points from their nearest centroid
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    leaf_a, leaf_b = tree.last == tree.first, over.last == over.first
    while len(a):
        gap = np.concatenate([np.sqrt(squares(points[tree.centre[a[i : i + PAIRS]]], centroids[over.centre[b[i : i + PAIRS]]]).astype(np.float64)) for i in range(0, len(a), PAIRS)])
        np.minimum.at(bound, a, gap + tree.radius[a])
        stays = gap - tree.radius[a] - over.radius[b] <= bound[a] * (1 + 1e-9)
        a, b, gap = a[stays], b[stays], gap[stays]
        done = leaf_a[a] & leaf_b[b]
        ends.append((a[done], b[done], gap[done]))
        a, b = a[~done], b[~done]
        down = ~leaf_a[a] & (leaf_b[b] | (tree.radius[a] >= over.radius[b]))  # the wider one is opened
        which, child = unfold(tree.first[a[down]], tree.last[a[down]])
        np.minimum.at(bound, child, bound[a[down]][which])
        other, kid = unfold(over.first[b[~down]], over.last[b[~down]])
        a, b = np.concatenate((child, a[~down][other])), np.concatenate((b[down][which], kid))
    a, b, gap = (np.concatenate(c) for c in zip(*ends))
    stays = gap - tree.radius[a] - over.radius[b] <= bound[a] * (1 + 1e-9)
    a, b = a[stays], b[stays]
    best, found = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(centroids), np.int64)
    lo, hi = tree.lo[a], np.where(tree.radius[a] == 0, tree.lo[a] + 1, tree.hi[a])  # equal points are compared once
    which, p = unfold(lo, hi)
    pair, c = unfold(over.lo[b[which]], over.hi[b[which]])
    p = p[pair]
    d = np.concatenate([np.empty(0, np.int64), *(squares(points[p[i : i + PAIRS]], centroids[c[i : i + PAIRS]]) for i in range(0, len(p), PAIRS))])
    np.minimum.at(best, p, d)
    tied = d == best[p]
    np.minimum.at(found, p[tied], number[c[tied]])
    equal = np.flatnonzero(leaf_a & (tree.radius == 0))
    which, p = unfold(tree.lo[equal], tree.hi[equal])
    best[p], found[p] = best[tree.lo[equal]][which], found[tree.lo[equal]][which]
    return found, best, len(d)


NAMES = [name for name, _ in Tree.PARTS]


def blocks_of(rows: DataFrame, length: int) -> DataFrame:
    """Blocks (ids, points, a cover tree) of rows (vec_id, embedding), in the order they are read."""

    def run(it):
        ids: list = []
        held: list[np.ndarray] = []

        def block():
            n = min(BLOCK, len(ids))
            x = np.concatenate(held)
            held[:] = [x[n:]]
            tree = Tree.over(x[:n])
            out = [np.array(ids[:n], object)[tree.order].tolist(), x[:n][tree.order].tobytes(), *tree.dump()]
            del ids[:n]
            return pa.RecordBatch.from_arrays([pa.array([out[0]], pa.list_(pa.int64())), *(pa.array([v], pa.binary()) for v in out[1:])], names=["ids", "points", *NAMES])

        for b in it:
            if b.num_rows:
                ids += b.column(0).to_pylist()
                held.append(np.floor(SCALE * b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, length))
            while len(ids) >= BLOCK:
                yield block()
        if ids:
            yield block()

    return arrow_map(rows, run, "ids array<long>, points binary, " + ", ".join(f"{n} binary" for n in NAMES))


def assigned(batch: pa.RecordBatch, length: int, centroids: np.ndarray):
    """For each block of a batch of blocks: ids, points, numbers of centroids, squared distances."""
    over = Tree.over(centroids)
    for r in batch.to_pylist():
        points = np.frombuffer(r["points"], np.int64).reshape(-1, length)
        found, best, _ = nearest(points, Tree.load([r[n] for n in NAMES]), centroids[over.order], over)
        yield r["ids"], points, found, best


def lloyd_round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floored means, empty ones stay."""
    k, length = centroids.shape

    def run(it):
        n, s = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for b in it:
            for _, points, found, _ in assigned(b, length, centroids):
                n += np.bincount(found, minlength=k)
                np.add.at(s, found, points)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.int64()))], names=["k", "n", "s"])

    parts = arrow_map(blocks, run, "k int, n long, s array<long>").select("k", "n", F.posexplode("s").alias("i", "s"))
    out = centroids.copy()
    for r in parts.groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38, 0)")).alias("s")).collect():  # k times the length
        out[r["k"], r["i"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH) -> DataFrame:
    """vectors' rows (vec_id, embedding) as (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    fits = F.expr(f"coalesce(embedding is not null and size(embedding) = {length} and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < {2.0**19!r}D), false)")
    rows = vectors.where(fits).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    first = rows.select(F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), scaled.alias("x")).orderBy("h", "x").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["x"] for r in first], np.int64)
    blocks = written(blocks_of(rows, length), "cover-trees")
    for _ in range(rounds):
        centroids = lloyd_round(blocks, centroids)

    def run(it):
        for b in it:
            for ids, _, found, best in assigned(b, length, centroids):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int32()), pa.array(best)], names=["vec_id", "cluster", "distance"])

    placed = written(arrow_map(blocks, run, "vec_id long, cluster int, distance long"), "clusters")
    sizes = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()  # k rows
    total = sum(int(r["s"]) for r in sizes)
    held = lambda v: v if v < 1 << 63 else None
    known = [(r["cluster"], held(int(r["s"])), held(total), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sizes]
    named = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = K, rounds: int = ROUNDS, length: int = LENGTH) -> str:
    """The same rows by comparing all vectors with all centroids."""
    ctes = [
        f"v as (select row_number() over () as u, vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)::bigint) as e from embeddings where len(embedding) = {length} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as (select row_number() over (order by sha256('2:' || vec_id), e) - 1 as k, e as c from v order by sha256('2:' || vec_id), e limit {k})",
    ]
    gap = "list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    for r in range(rounds + 1):
        ctes.append(f"a{r} as (select u, any_value(vec_id) as vec_id, any_value(e) as e, arg_min(k, struct_pack(d := d, k := k)) as k, min(d) as d from (select u, vec_id, e, k, {gap} as d from v cross join c{r}) group by u)")
        if r < rounds:
            ctes.append(f"s{r} as (select k, i, sum(x)::hugeint as s, count(*)::hugeint as n from (select k, unnest(e) as x, unnest(range(1, {length + 1})) as i from a{r}) group by k, i)")
            ctes.append(f"m{r} as (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from s{r} group by k)")
            ctes.append(f"c{r + 1} as (select k, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (k))")
    last = f"select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (k)"
    return "with " + ",\n".join(ctes) + "\n" + last
