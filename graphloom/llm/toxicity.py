"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier over hashed words is fitted in numpy on confirmed toxic texts
and unlabelled ones. With class prior p the risk of calling unlabelled text clean is
corrected by what its toxic part contributes: R = p*R(+) + max(0, Ru(-) - p*Rp(-)),
and where the corrected part turns negative in a mini-batch, the step goes the other
way, so the model can't overfit the positives (non-negative risk).

The fit takes at most `positives` confirmed texts and `unlabelled` texts (documented
bounds, chosen by hash of the id); unless p is given it is estimated from these. Each batch
of texts is scored whole on executors.

Cases: null and empty texts have no words and score by the bias alone; a label that is
null counts as none, of several labels of a document one that says toxic holds; without any
positive every score is 0; an empty table gives no rows; repeated rows are scored as
often as they occur; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD, U64, arrow_map, hash_words, joined, leading_bytes, mix64, settled, with_text_columns, word_spans

BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: Bytes of text whose features a worker makes at once: six hashes and more of each word.
LOT_BYTES = 1 << 19


def word_features(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, flat, and the first of each text: its words and their
    beginnings of PREFIXES bytes, each again where they stand at least twice and four times."""
    data, at = joined(column)
    low = LOWER[data]
    starts, ends, first = word_spans(low, at, NOT_WORD)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    hashes, docs = [hash_words(low, starts, ends)], [doc]
    lead, size = leading_bytes(low, starts, max(PREFIXES)), ends - starts
    for n in PREFIXES:
        long = size >= n
        hashes.append(mix64((lead[long] & U64((1 << 8 * n) - 1)) ^ mix64(np.array([n], U64))))
        docs.append(doc[long])
    slot = (np.concatenate(hashes) >> U64(64 - BITS)).astype(np.int64)
    key, times = np.unique(np.concatenate(docs) << BITS | slot, return_counts=True)
    more = [key, *(key[times >= n] ^ mark for n, mark in ((2, 0x5A5A5), (4, 0x3C3C3)))]
    key = np.unique(np.concatenate(more))
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(at)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[slots], dtype=np.float64)))
        z = sums[first[1:]] - sums[first[:-1]] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling(pos: np.ndarray, unl: np.ndarray, n_pos: int, n_unl: int, least: float = 3.5, texts: int = 3) -> np.ndarray:
    """Which slots stand apart: of n_pos confirmed and n_unl unlabelled texts, pos and unl hold the slot;
    the shares differ by `least` standard errors, and so many confirmed or unlabelled texts hold it."""
    both = (pos + unl + 1) / (n_pos + n_unl + 2)
    error = np.sqrt(both * (1 - both) * (1 / (n_pos + 1) + 1 / (n_unl + 1)))
    z = (pos / (n_pos + 1) - unl / (n_unl + 1)) / error
    return ((z >= least) & (pos >= texts)) | ((z <= -least) & (unl >= texts))


def risk_gradient(scores: np.ndarray, n: int, prior: float) -> tuple[np.ndarray, float]:
    """What a step descends by each text's logit, and the corrected risk Ru(-) - p*Rp(-) of scores, of which the
    first n are of confirmed texts. Where that risk is negative the step goes up on it instead."""
    p, u = scores[:n], scores[n:]
    pull = prior * (p - 1) / n  # of p*R(+)
    push_p, push_u = -prior * p / n, u / len(u)  # of Ru(-) - p*Rp(-)
    negative = prior * np.log1p(-np.minimum(p, 1 - 1e-9)).mean() - np.log1p(-np.minimum(u, 1 - 1e-9)).mean()
    return np.concatenate((pull + push_p, push_u) if negative >= 0 else (-push_p, -push_u)), float(negative)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, size: int, epochs: int = 60, batch: int = 512, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> Model:
    """Adagrad on the non-negative risk of the logistic loss; texts hold features below `size`."""
    model = Model(np.zeros(size), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if not pos or not unl:
        model.bias = -40.0
        return model
    rng, seen, seen_bias = np.random.default_rng(seed), np.full(size, 1e-6), 1e-6
    steps = max(1, -(-len(unl) // batch))
    for _ in range(epochs):
        order_u, order_p = rng.permutation(len(unl)), rng.permutation(len(pos))
        for u, p in zip(np.array_split(order_u, steps), np.array_split(np.resize(order_p, max(len(pos), steps)), steps)):
            texts = [pos[i] for i in p] + [unl[i] for i in u]
            first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            slots = np.concatenate(texts)
            s = model.score(slots, first)
            g, _ = risk_gradient(s, len(p), prior)
            grad = np.bincount(slots, np.repeat(g, np.diff(first)), size) + decay * model.weights
            seen += grad * grad
            model.weights -= rate * grad / np.sqrt(seen)
            seen_bias += g.sum() ** 2
            model.bias -= rate * g.sum() / np.sqrt(seen_bias)
    return model


#: Ranges of slots that are counted apart.
RANGES = 16


def slot_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """How many confirmed and how many unlabelled texts (confirmed, slots) hold each slot, equal texts once, and
    how many there are: added up on executors, two numbers for each slot reach the driver."""

    def count(it):
        import pyarrow as pa

        sums, n = np.zeros((2, 1 << BITS), np.uint32), [0, 0]
        for b in it:
            for confirmed, slots in zip(b.column(0).to_pylist(), b.column(1)):
                row = 0 if confirmed else 1
                sums[row, np.frombuffer(slots.as_buffer(), np.int32)] += 1  # a text's slots are distinct
                n[row] += 1
        if any(n):
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sums, RANGES, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary()), *(pa.array([x] + [0] * (RANGES - 1), pa.int64()) for x in n)], names=["part", "sums", "p", "u"])

    def add(it):
        import pyarrow as pa

        sums: dict[int, list] = {}
        for b in it:
            for part, raw, p, u in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(zlib.decompress(raw), np.uint32)
                old = sums.setdefault(part, [0, 0, 0])
                sums[part] = [old[0] + x, old[1] + p, old[2] + u]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0].tobytes() for x in sums.values()], pa.binary()), *(pa.array([x[k] for x in sums.values()], pa.int64()) for k in (1, 2))], names=["part", "sums", "p", "u"])

    schema = "part int, sums binary, p long, u long"
    once = texts.groupBy("confirmed", F.xxhash64("slots"), F.length("slots")).agg(F.first("slots").alias("slots")).select("confirmed", "slots")
    out, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    width = (1 << BITS) // RANGES
    for r in arrow_map(arrow_map(once, count, schema).repartition(RANGES, "part"), add, schema).collect():  # 8 MB in all
        out[:, r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["sums"], np.uint32).reshape(2, -1)
        n = [n[0] + r["p"], n[1] + r["u"]]
    return out[0], out[1], *n


def training_texts(docs: DataFrame, labels: DataFrame, train, positives: int, unlabelled: int) -> DataFrame:
    """(confirmed, slots) of confirmed and of unlabelled texts.

    `train` is a condition on doc_id: other rows are not read. Confirmed are texts that labels call toxic; the
    unlabelled ones are a draw from all of docs' rows, whether labels names them or not. No text counts as clean.
    """
    of_hash = (F.xxhash64("id"), F.col("id"))
    toxic = labels.where(train).where("doc_id is not null and toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    every = docs.select("doc_id").where(train).where("doc_id is not null").select(F.col("doc_id").alias("id"))
    ids = [toxic.orderBy(*of_hash).limit(positives).select("id", F.lit(True).alias("confirmed")), every.distinct().orderBy(*of_hash).limit(unlabelled).select("id", F.lit(False).alias("confirmed"))]
    chosen = F.broadcast(ids[0].union(ids[1]))  # ids within the documented bounds

    def features(it):
        import pyarrow as pa

        for b in it:
            slots, first = word_features(b.column(2))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([slots[i:j].tobytes() for i, j in zip(first, first[1:])], pa.binary())], names=["id", "confirmed", "slots"])

    made = arrow_map(docs.join(chosen, docs.doc_id == chosen.id).select(chosen.id, chosen.confirmed, docs.text.cast("string").alias("text")), features, "id long, confirmed boolean, slots binary", LOT_BYTES)
    return made.dropDuplicates(["id", "confirmed", "slots"]).select("confirmed", "slots")  # repeated rows count once


#: Bounds of an estimated class prior, and the one where nothing tells it.
PRIORS, NO_PRIOR = (1e-4, 1 - 1e-4), 0.01
#: The most that a text without any telling feature scores: nothing speaks for it.
SILENT = 0.49


def class_prior(pos: list[np.ndarray], unl: list[np.ndarray], size: int) -> float:
    """The share of toxic texts among unlabelled ones, from these two kinds alone.

    Whatever a score's threshold t, the share is at most P(score >= t | unlabelled) / P(score >= t | confirmed), and
    close to it where few clean texts score so high. The least such bound over thresholds that 30 to 90 per
    cent of confirmed texts reach, with a standard error on top, is averaged over two halves that score each other.
    Too few texts for halves, or no telling feature, say nothing: then it is NO_PRIOR. PRIORS bounds it away from 0 and 1,
    where no risk is defined.
    """
    found = []
    for fold in (0, 1) if size and len(pos) > 1 and len(unl) > 1 else ():
        model = fit_nnpu(pos[fold::2], unl[fold::2], 0.2, size, epochs=15)
        p, u = (np.sort(model.score(np.concatenate(part) if part else np.empty(0, np.int32), np.cumsum([0] + [len(t) for t in part]))) for part in (pos[1 - fold :: 2], unl[1 - fold :: 2]))
        bounds = []
        for reach in np.linspace(0.3, 0.9, 13):
            t = p[min(int(len(p) * (1 - reach)), len(p) - 1)]
            q = 1 - np.searchsorted(u, t) / len(u)
            bounds.append((q + np.sqrt(q * (1 - q) / len(u))) / (1 - np.searchsorted(p, t) / len(p)))
        found.append(min(bounds))
    return float(np.clip(np.mean(found), *PRIORS)) if found else NO_PRIOR


def learn(docs: DataFrame, labels: DataFrame, train, positives: int = 6000, unlabelled: int = 12000, prior: float | None = None) -> Model:
    """A model over all slots. Of the training texts only telling features reach the driver."""
    texts = settled(training_texts(docs, labels, train, positives, unlabelled))
    use = telling(*slot_counts(texts))
    place, size = (np.cumsum(use) - 1).astype(np.int32), int(use.sum())

    def of_use(it):
        import pyarrow as pa

        for b in it:
            slots = [np.frombuffer(x.as_buffer(), np.int32) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([place[x[use[x]]].tobytes() for x in slots], pa.binary())], names=["confirmed", "slots"])

    rows = arrow_map(texts, of_use, "confirmed boolean, slots binary").orderBy(F.xxhash64("slots"), "slots", "confirmed").collect()
    pos, unl = ([np.frombuffer(r["slots"], np.int32) for r in rows if r["confirmed"] is kind] for kind in (True, False))
    small = fit_nnpu(pos, unl, class_prior(pos, unl, size) if prior is None else prior, size)
    model = Model(np.zeros(1 << BITS), small.bias)
    model.weights[use] = small.weights
    return model


def toxicity(docs: DataFrame, labels: DataFrame, train, positives: int = 6000, unlabelled: int = 12000, prior: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs' rows as the columns `keep` (doc_id unless given) and score: the model's probability that label 1 holds."""
    return scores(docs, learn(docs, labels, train, positives, unlabelled, prior), keep or ["doc_id"])


def scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    small = Model(model.weights.astype(np.float32), model.bias)

    def score(text):
        import pyarrow as pa

        slots, first = word_features(text)
        told = np.concatenate(([0], np.cumsum(small.weights[slots] != 0)))[first]
        found = small.score(slots, first)
        return [pa.array(np.where(np.diff(told) > 0, found, np.minimum(found, SILENT)), pa.float64())]

    return with_text_columns(docs, keep, score, "score double", LOT_BYTES)
