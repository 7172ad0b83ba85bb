"""op5's last round: a large group of texts that lie near the bound returns links, not pairs."""

import random

from pyspark.sql import functions as F

from graphloom.llm import near_duplicates


def test_across_returns_fewer_links_than_sets(spark, monkeypatch):
    """Sets of one group, each its own component: links of a cell join them, and none is lost."""
    monkeypatch.setattr(near_duplicates, "CELL_SETS", 40)
    monkeypatch.setattr(near_duplicates, "CELL_SHINGLES", 5000)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        w = list(base)
        for k in range(1 if i % 4 else 30):
            w[rng.randrange(150)] = f"x{i}-{k}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    ids = near_duplicates.read_sets(docs).where("cells is null").select(F.col("doc_id").alias("id"), "s")
    sets = near_duplicates.settled(near_duplicates.wanted_sets(docs, ids))
    groups = sets.select(F.lit(1).cast("long").alias("g"), "s", F.col("s").alias("c"))
    found = near_duplicates.across(groups, sets).collect()
    words = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in texts}
    pairs = [(a, b) for a in words for b in words if a < b and 100 * len(words[a] & words[b]) >= 80 * len(words[a] | words[b])]
    cells = 3 * 4 // 2
    assert len(pairs) > 1500 and len(found) < 120 * cells / 2 < len(pairs)

    def classes(links, names):
        up = {x: x for x in names}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            x, y = sorted((top(a), top(b)))
            up[y] = x
        return sorted(sorted(x for x in names if top(x) == r) for r in {top(x) for x in names})

    name = {r["s"]: r["id"] for r in ids.collect()}
    assert classes([(name[r["a"]], name[r["b"]]) for r in found], list(words)) == classes(pairs, list(words))
