"""Many repeats, dense cells and unusual shares: what grows, and that results stay whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import embeddings, near_duplicates, token_counts, toxicity
from graphloom.llm.queries import PIECES


def test_repeated_rows_are_verified_once(spark, monkeypatch):
    """Two near-duplicate texts, each in a hundred rows of one id: one pair of sets is verified."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    other = [*words[:60], "x", *words[61:]]
    rows = [(1, " ".join(words))] * 100 + [(2, " ".join(other))] * 100
    seen = []
    plain = near_duplicates.verify

    def counted(pairs, sets):
        seen.append((pairs.count(), sets.count(), sets.select("s").distinct().count()))
        return plain(pairs, sets)

    monkeypatch.setattr(near_duplicates, "verify", counted)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 200 and {r["component_id"] for r in got} == {1}
    assert seen and all(sets == distinct == 2 for _, sets, distinct in seen) and sum(pairs for pairs, _, _ in seen) == 1


def test_one_cell_is_cut_over_tasks(spark, monkeypatch):
    """Vectors that lie in one cell of the grid go to several tasks."""
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, 8)
    v = base + rng.normal(0, 1e-4, (3000, 8))
    df = spark.createDataFrame([(i, x.tolist(), "1", 1) for i, x in enumerate(v)], "cid long, embedding array<double>, label string, weight long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = embeddings.blocks_of(df, embeddings.principal_axes(df), 0.2).select("block", F.expr("length(ids) div 8").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    tasks = {}
    for r in made:
        tasks[r["block"].split("-")[0]] = tasks.get(r["block"].split("-")[0], 0) + r["n"]
    assert sum(tasks.values()) == 3000 and len(tasks) == 4 and max(tasks.values()) < 1500


def test_a_corpus_that_is_mostly_toxic(spark):
    """The prior isn't held below one half, and texts in which nothing tells stay below one half."""
    rng = random.Random(2)
    calm, rude = [f"calm{i}" for i in range(60)], [f"rude{i}" for i in range(25)]
    rows = []
    for i in range(1500):
        toxic = i % 5 < 3
        rows.append((i, " ".join(rng.choices(rude, k=5) * toxic + rng.choices(calm, k=12))))
    rows += [(5000, ""), (5001, "unheard of"), (5002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1500) if i % 5 < 3 and i % 3 == 0], "doc_id long, toxic int")
    texts = toxicity.training_texts(docs, labels, F.lit(True), 6000, 12000).collect()
    pos, unl = ([np.frombuffer(r["slots"], np.int32) for r in texts if r["confirmed"] is kind] for kind in (True, False))
    use = {s: k for k, s in enumerate(sorted({s for t in pos for s in t.tolist()} | {s for t in unl for s in t.tolist()}))}
    prior = toxicity.class_prior(*([np.array([use[s] for s in t.tolist()], np.int32) for t in part] for part in (pos, unl)), len(use))
    assert 0.5 < prior < 0.75
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, F.lit(True)).collect()}
    right = [(got[i] >= 0.5) == (i % 5 < 3) for i in range(1500)]
    assert np.mean(right) > 0.97 and all(got[i] < 0.5 for i in (5000, 5001, 5002))


def test_repeated_confirmed_rows_count_once(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 40 + [(2, "d e f")] * 40, "doc_id long, text string")
    texts = toxicity.training_texts(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(True), 10, 10)
    assert sorted(r["confirmed"] for r in texts.collect()) == [False, False, True]


@pytest.mark.parametrize("n, positives", [(200, 30)])
def test_scores_are_those_of_a_plain_fit(n, positives):
    """The fit by steps comes near the minimum of the same risk, found by plain descent over all texts."""
    rng = np.random.default_rng(1)
    pos = [np.unique(np.append(rng.integers(0, 6, 3), rng.integers(6, 30, 3))).astype(np.int32) for _ in range(positives)]
    unl = [np.unique(rng.integers(6, 30, 6)).astype(np.int32) if i % 4 else np.unique(np.append(rng.integers(0, 6, 3), rng.integers(6, 30, 3))).astype(np.int32) for i in range(n)]
    model = toxicity.fit_nnpu(pos, unl, 0.25, 30)
    x = np.zeros((positives + n, 30))
    for row, t in enumerate(pos + unl):
        x[row, t] = 1
    w, b = np.zeros(30), np.log(0.25 / 0.75)
    for _ in range(4000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g, _ = toxicity.risk_gradient(p, positives, 0.25)
        w, b = w - 2.0 * (x.T @ g + 1e-5 * w), b - 2.0 * g.sum()
    first = np.cumsum([0] + [len(t) for t in pos + unl])
    ours = model.score(np.concatenate(pos + unl), first)
    plain = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.mean((ours >= 0.5) == (plain >= 0.5)) > 0.97 and np.corrcoef(ours, plain)[0, 1] > 0.95


def test_a_long_word_keeps_no_lattice():
    """Counting a word of a million characters takes little more memory than the word."""
    import tracemalloc

    counter = token_counts.counter(PIECES)
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    part = counter.count_marked(word[:2000])
    tracemalloc.start()
    n = counter.count_marked(word)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 << 20 and 0.9 * part * 150 < n < 1.1 * part * 150
