"""Nulls, repeated and null ids, clashing columns, very long texts and bounded batches, for every operator."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import bytebpe, common, embeddings, language, licenses, media, near_duplicates, packing, token_counts, toxicity
from graphloom.llm.queries import BYTE_BPE, PIECES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33), (1, "one two three four five six seven", "en", "a", 33), (1, "another text of the same id, longer than that", None, "b", 45), (None, "a text without an id", "en", None, None), (None, None, None, None, None),
    (2, None, "en", "a", 0), (3, "", "de", "a", 0), (4, "   \n\t ", "de", "a", 6), (5, "idiot scum " * 9, "en", "a", 99), (6, "<|endoftext|> é 漢字 🎉 ퟿", "de", "a", 20),
]


@pytest.fixture(scope="module")
def rows(spark):
    names = ("n", "s", "k", "d", "h", "id", "score", "rep", "line", "part", "length", "offset", "digest", "_text_read", "sketch", "component")
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1), (5, None), (None, 1), (1, 0), (1, 0)], "doc_id long, toxic int")


def agree(out, column, n=len(ROWS)):
    """Rows come back as often as they went in; equal texts have equal values."""
    got = out.collect()
    assert len(got) == n
    return {r["doc_id"]: r[column] for r in got}


def test_row_operators(spark, rows, labels, tmp_path):
    assert all(0 <= s <= 1 for s in agree(toxicity.toxicity(rows, labels, F.lit(True)), "score").values())
    assert agree(token_counts.token_counts(rows, PIECES), "n_tokens")[3] == 0
    assert agree(licenses.scan_licenses(rows), "n_words")[2] == 0
    assert agree(bytebpe.digests(rows, BYTE_BPE), "n_tokens")[3] == 0
    assert agree(media.media_columns(rows, f"file://{tmp_path}/m"), "n_bytes")[2] == 0
    names = agree(language.label(rows, language.learn(rows, F.lit(True))), "lang_pred")
    assert names[2] == names[3] == names[4] == "und" and set(names.values()) <= {"en", "de", "und"}
    pieces = packing.pack(rows, BYTE_BPE).collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(ROWS)


def test_near_duplicates_of_such_rows(spark, rows):
    got = agree(near_duplicates.near_duplicates(rows), "component_id")
    assert got == {i: i for i in (1, 2, 3, 4, 5, 6)} | {None: None}
    assert near_duplicates.one_of_each(rows).count() == len(ROWS)


def test_stages_take_such_rows_and_empty_tables(spark, rows, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = rows
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_embeddings_of_repeated_and_null_ids(spark, monkeypatch):
    """Many blocks, on a grid; rows of one id are one vertex."""
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(25)]
    rows = []
    for i in range(240):
        v = [x + rng.gauss(0, 0.05) for x in rng.choice(base)]
        rows.append((rng.randrange(200) if i % 20 else None, v, i % 2))
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, base[0], None), (504, [*base[0][:7], None], 0)]
    got = embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1))).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    sound = [r for r in rows[:240] if r[0] is not None]
    root = {r[0]: r[0] for r in rows if r[0] is not None}
    links = []
    for a in sound:
        n = 0
        for b in sound:
            if a is not b and a[2] == b[2] and cos(a[1], b[1]) >= 0.98:
                n += 1
                x, y = sorted((root[a[0]], root[b[0]]))
                root = {k: x if v == y else v for k, v in root.items()}
        links.append((a[0], n))
    assert sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] is not None and r["vec_id"] < 500) == sorted(links)
    assert all(r["component_id"] == (None if r["vec_id"] is None else root[r["vec_id"]]) for r in got)
    assert all(r["n_links"] == 0 and r["kept"] for r in got if (r["vec_id"] or 0) >= 500) and len(got) == len(rows)


def test_batches_are_bounded_by_bytes():
    texts = pa.array(["x" * 130_000] * 1000 + ["y" * (3 << 20)] + ["z"] * 5000)
    lots = list(common.bounded([pa.RecordBatch.from_arrays([texts], names=["text"])]))
    assert sum(b.num_rows for b in lots) == 6001 and max(b.num_rows for b in lots) <= common.BATCH_ROWS
    assert all(b.nbytes <= common.BATCH_BYTES or b.num_rows == 1 for b in lots)
    assert [t for b in lots for t in b.column(0).to_pylist()] == texts.to_pylist()
    assert list(common.bounded([])) == []


@pytest.mark.parametrize("work", [lambda t: toxicity.word_features(t), lambda t: near_duplicates.shingles(t), lambda t: language.Words(t).slots()], ids=["toxicity", "shingles", "language"])
def test_memory_of_a_batch_is_bounded(work):
    """The largest batch of long texts takes less than 400 MB of working memory."""
    import tracemalloc

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(24_000))[:130_000]
    lot = max(common.bounded([pa.RecordBatch.from_arrays([pa.array([text] * 1000)], names=["text"])]), key=lambda b: b.nbytes).column(0)
    tracemalloc.start()
    work(lot)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400 << 20, most >> 20
