"""Whitening, suffix dedup and dual-tree clustering against brute force, and their edge cases."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import centroids, suffixes, whitening

VECTORS = "vec_id long, embedding array<double>"


def table(spark, rows):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("n", "d", "x", "k", "w", "h", "cluster", "distance", "component", "label")})


# 11


def test_double_doubles_are_exact():
    rng = np.random.default_rng(5)
    y = rng.integers(-(1 << 40), 1 << 40, (57, 4)).astype(np.float64), rng.random((57, 4)) * 2.0**-20
    high, low = whitening.outer_sum(y, np.triu_indices(4))
    for t, (i, j) in enumerate(zip(*np.triu_indices(4))):
        want = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(y[0][:, i], y[1][:, i], y[0][:, j], y[1][:, j]))
        assert abs(Fraction(high[t]) + Fraction(low[t]) - want) <= abs(want) / 2**95 + 2**-10
    a, b = whitening.integers(np.array([(1 << 61) + 1, -5, 1 << 53]))
    assert [int(p) + int(q) for p, q in zip(a, b)] == [(1 << 61) + 1, -5, 1 << 53]


def test_whitening_is_the_plain_one(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(0, 1, (300, 6)) @ np.diag([3, 2, 1.5, 1, 0.7, 0.4])
    v[:40] = v[0]  # repeated rows count
    got = whitening.whiten(table(spark, [(i % 290, r.tolist()) for i, r in enumerate(v)]).repartition(5), 4).collect()
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = np.array([[float(Fraction(n * int(c) - int(t), n)) for c, t in zip(r, s)] for r in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    w = y @ u / np.sqrt(e)
    assert len(got) == 300 * 4 and {r["n"] for r in got} == {300} and {r["component"] for r in got} == {1, 2, 3, 4}
    for c in range(4):
        rows = sorted((r["vec_id"], abs(r["whitened"]), r["deviation"], r["explained"]) for r in got if r["component"] == c + 1)
        want = sorted((i % 290, abs(w[i, c]), int(((n * x[i] - s) ** 2).sum()), e[c] / e.sum()) for i in range(300))
        assert all(a[0] == b[0] and a[2] == b[2] and math.isclose(a[1], b[1], abs_tol=1e-8) and math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(rows, want))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_edges(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [2.0**57, 0.0])]
    flat = [(7, [1.0, 0.0]), (7, [2.0, 0.0]), (None, [4.0, 0.0])]
    other = [(8, [1.0, 2.0, 3.0])]
    got = whitening.whiten(table(spark, bad + flat + other)).collect()
    assert sorted((r["vec_id"] or -1, r["component"], r["n"], r["whitened"] is None) for r in got) == sorted([(i, c, 3, c == 2) for i in (7, 7, -1) for c in (1, 2)] + [(8, c, 1, True) for c in (1, 2, 3)])
    assert all(r["identity_error"] is None for r in got if r["vec_id"] == 8) and all(r["explained"] == 0 for r in got if r["component"] == 2)
    assert whitening.whiten(table(spark, bad)).count() == 0 and whitening.whiten(table(spark, [])).count() == 0
    large = whitening.whiten(table(spark, [(i, [2.0**54 * i, 1.0]) for i in range(3)])).collect()
    assert all(r["deviation"] is None for r in large if r["vec_id"] != 1)


# 12


def brute(rows, length=50):
    """What each document loses, by a table of all strings."""
    first, out = {}, {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.setdefault(d, []).append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return {d: sorted(v) for d, v in out.items()}


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("h", "s", "d", "u", "at", "n", "m", "mask", "runs", "kind")})
    out: dict = {}
    for r in suffixes.drop_repeated_strings(df.repartition(3), **more).collect():
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:])) and sum(a["end"] - a["start"] for a in r["spans"]) == r["n_removed"]
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])))
    return {d: sorted(v) for d, v in out.items()}


@pytest.fixture(scope="module")
def shared():
    rng = random.Random(12)
    letters = "abcdefgh é漢"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (30, 49, 50, 51, 60, 300)]
    rows = [(i, "".join(rng.choice((text(rng.randrange(80)), rng.choice(passages)[rng.randrange(3) :])) for _ in range(rng.randrange(6)))) for i in range(120)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)]  # copies
    rows += [(300 + i, "ab" * 90 + str(i) + "x" * 200) for i in range(12)]  # repeats within a text
    return rows


def test_suffix_dedup_is_brute_force(spark, shared):
    assert found(spark, shared) == brute(shared)


def test_suffix_dedup_of_other_lengths(spark, shared):
    assert found(spark, shared, length=33) == brute(shared, 33)


def test_suffix_dedup_of_split_groups(spark, shared, monkeypatch):
    """Anchors of many segments are dealt to several tasks, what is open between them is settled."""
    monkeypatch.setattr(suffixes, "GROUP", 2)
    assert found(spark, shared) == brute(shared)


def test_suffix_dedup_edges(spark):
    long = "".join(random.Random(1).choice("abc \n") for _ in range(suffixes.STEP * 3 + 17))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, "y" + long[: suffixes.STEP + 200]), (6, long[100:149]), (7, long[100:150]), (7, long[100:150]), (7, long[120:180]), (None, long[:90]), (None, None), (-3, long[400:600])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {} and found(spark, [(1, None)]) == {1: [(0, 0, 0, b"")]}


def test_suffix_sort_is_the_plain_one():
    rng = random.Random(4)
    data = np.array([rng.randrange(3) for _ in range(3000)], np.uint8)
    at = np.array([rng.randrange(2900) for _ in range(700)])
    group = np.sort(np.array([rng.randrange(9) for _ in at]))
    s = suffixes.Suffixes(data, 12)
    order, equal = s.sorted_runs(at, group)
    keys = [(group[t], data[at[t] : at[t] + 12].tobytes()) for t in order]
    assert sorted(order) == list(range(len(at))) and keys == sorted(keys)
    assert equal.tolist() == [k > 0 and keys[k] == keys[k - 1] for k in range(len(keys))]


def test_misleading_hashes_are_seen():
    """Hashes that call everything equal: the sequence doesn't verify, and is sorted by bytes."""
    data = np.frombuffer(b"zebra apple mango apple", np.uint8)
    s = suffixes.Suffixes(data, 5)
    s.sums[:] = 0
    order, equal = s.sorted_runs(np.array([0, 6, 12, 18]), np.zeros(4, int))
    assert equal.tolist() == [False, True, False, False] and order.tolist()[2:] == [2, 0]


def test_names_that_collide_are_drawn_anew(spark, shared, monkeypatch):
    """settle tells of a name that stands for two segments."""
    rows = [(1, 0, 9, 0, b"a" * 60, 1, 1), (1, 0, 9, 0, b"b" * 60, 2, 1), (2, 0, 9, 0, b"b" * 60, 2, 1)]
    out = suffixes.settle(spark.createDataFrame(rows, "h long, sub int, s long, lead int, bytes binary, m long, parts long").coalesce(1), 50).collect()
    assert [(r["h"], r["s"]) for r in out if r["kind"] == 2] == [(1, 9)]
    assert (suffixes.gram_hashes(np.arange(99, dtype=np.uint8), 20, 0) != suffixes.gram_hashes(np.arange(99, dtype=np.uint8), 20, 1)).all()


# 13


def lloyd(rows, k, rounds, length):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        sums = {}
        for _, v in kept:
            sums.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(sums[j]) for x in zip(*sums[j])] if j in sums else m for j, m in enumerate(c)]
    placed = [(i, *near(v)) for i, v in kept]
    size = {}
    for _, d, j in placed:
        size[j] = size.get(j, 0) + d
    return sorted((-1 if i is None else i, j, d, size[j], sum(size.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in placed)


def test_dual_tree_lloyd_is_plain_lloyd(spark, monkeypatch):
    rng = random.Random(13)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    rows = [(i % 380, [x + rng.gauss(0, 0.1) for x in rng.choice(base)]) for i in range(400)]
    rows += [(500 + i, base[0]) for i in range(60)] + [(None, base[1]), (None, base[2])]  # equal vectors, null ids
    rows += [(600, None), (601, [1.0] * 4), (602, [None] * 5), (603, [float("inf")] * 5), (604, [2.0**20] * 5)]
    want = lloyd([r for r in rows if r[0] != 604], 7, 5, 5)
    got = centroids.cluster(table(spark, rows).repartition(3), 7, 5, 5).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_dual_tree_edges(spark):
    few = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    got = centroids.cluster(table(spark, few), 9, 2, 2).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == lloyd(few, 9, 2, 2)
    assert centroids.cluster(table(spark, [(1, None)])).count() == 0 and centroids.cluster(table(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_cover_tree_holds_its_promises():
    """Points lie within their nodes, children's centres apart, and near clusters cost few comparisons."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(0, 4, (30, 8))[rng.integers(0, 30, 900)] + rng.normal(0, 0.05, (900, 8)))).astype(np.int64)
    tree = centroids.Tree.over(x)
    p = x[tree.order]
    for k in range(len(tree.lo)):
        own = p[tree.lo[k] : tree.hi[k]]
        assert np.sqrt(((own - p[tree.centre[k]]) ** 2).sum(1)).max() <= tree.radius[k] * (1 + 1e-12)
        children = range(tree.first[k], tree.last[k])
        if children:
            assert tree.centre[children[0]] == tree.centre[k] and [tree.lo[c] for c in children] + [tree.hi[k]] == [tree.lo[k]] + [tree.hi[c] for c in children]
            c = p[[tree.centre[j] for j in children]]
            gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[~np.eye(len(c), dtype=bool)]
            assert gap.min() > 2.0 ** (np.ceil(np.log2(tree.radius[k])) - 1)
    c = x[:40]
    over = centroids.Tree.over(c)
    where, best, compared = centroids.nearest(p, tree, c[over.order], over)
    d = ((p[:, None] - c[None]) ** 2).sum(2)
    assert (best == d.min(1)).all() and (where == d.argmin(1)).all() and compared < len(p) * len(c) / 3
    huge = x << 17  # beyond exact products of doubles
    assert (centroids.nearest(huge[(t := centroids.Tree.over(huge)).order], t, huge[:5], centroids.Tree.over(huge[:5]))[1] >= 0).all()
