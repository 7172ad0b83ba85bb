"""Language identification of words by a linear-chain conditional random field.

Every word of a text is a position of the chain; its label is a language. A label's
score at a word sums learned weights of the word's byte trigrams (with its borders),
prefix, suffix and lexicon membership; learned transitions couple neighbours. Forward-
backward gives each word's label probabilities, so code-switched texts are labelled
word by word; a document takes the language with the most probability mass.

Inference runs over whole texts: the words of a batch are one table, and the chain is
stepped for all its texts at once, longest first. The fit takes at most `sample`
labelled texts (a documented bound, chosen by hash of the id) on the driver.

Cases: texts that are null or without a letter are `und` with score 0; so is every
text where nothing was learned; null labels aren't learned from; an empty table gives
no rows; repeated rows are labelled as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD, U64, hash_words, joined, leading_bytes, mix64, with_text_columns, word_spans

BITS = 17
LEXICON = 30_000
#: Bytes of text that a worker labels together, as long texts step together, and words whose features it has at once.
LOT_BYTES, LOT_WORDS = 4 << 20, 1 << 16


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # feature slot x language
    lexicon: np.ndarray  # sorted hashes of words
    lexicon_language: np.ndarray
    lexicon_weights: np.ndarray  # language of the entry x language
    transitions: np.ndarray

    def emissions(self, t: Words) -> np.ndarray:
        out = np.empty((len(t.hashes), len(self.languages)))
        for i in range(0, len(out), LOT_WORDS):
            j = min(i + LOT_WORDS, len(out))
            slots, word = t.slots(i, j)
            edges = np.searchsorted(word, np.arange(j - i + 1))
            for k in range(len(self.languages)):
                w = self.weights[:, k]
                sums = np.concatenate(([0.0], np.cumsum(w[slots], dtype=np.float64)))
                out[i:j, k] = sums[edges[1:]] - sums[edges[:-1]] + w[t.prefix[i:j]] + w[t.suffix[i:j]]
        found, entry = self.entries(t.hashes)
        out[found] += self.lexicon_weights[entry]
        return out

    def entries(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that the lexicon has, and the language of each."""
        if not len(self.lexicon):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        found = np.flatnonzero(self.lexicon[at] == hashes)
        return found, self.lexicon_language[at[found]]


class Words:
    """The words of a batch of texts and their features' slots."""

    def __init__(self, column):
        data, self.at = joined(column)
        self.low = LOWER[data]
        self.starts, self.ends, self.first = word_spans(self.low, self.at, NOT_WORD)
        self.hashes = hash_words(self.low, self.starts, self.ends)
        n = self.ends - self.starts
        affix = np.minimum(n, 3)
        mask = (U64(1) << (U64(8) * affix.astype(U64))) - U64(1)
        pre = leading_bytes(self.low, self.starts, 3) & mask
        suf = leading_bytes(self.low, self.ends - affix, 3) & mask
        shift = U64(64 - BITS)
        self.prefix = (mix64(pre ^ U64(0x9E3779B1)) >> shift).astype(np.int32)
        self.suffix = (mix64(suf ^ U64(0x85EBCA6B)) >> shift).astype(np.int32)

    def slots(self, i: int = 0, j: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Trigram slots of the words from i to j, flat, and the word of each, from 0. A word's border counts as a space."""
        starts, ends = self.starts[i:j], self.ends[i:j]
        n = ends - starts  # a word of n bytes has n trigrams, centred on its bytes
        if not len(n):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        word, base = np.repeat(np.arange(len(n)), n), int(starts[0])
        where = np.arange(len(word)) + np.repeat(starts - base - (np.cumsum(n) - n), n)
        low = self.low[base : int(ends[-1])]  # what stands around words is no part of one
        b = np.where(NOT_WORD[low], np.uint8(32), low).astype(np.int32)
        before, after = np.concatenate(([32], b[:-1])).astype(np.int32), np.concatenate((b[1:], [32])).astype(np.int32)
        code = (before << 16 | b << 8 | after)[where].astype(np.uint32)
        return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32), word


def marginals(emit: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's label probabilities, and the expected transitions summed over all texts.

    Texts are stepped together, the longest first, so that at every step the running
    ones are a prefix; values are scaled at each step. Going back, each step's
    probabilities take the place of what the way forward left there.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], first[:-1][order]
    psi = emit - emit.max(1, keepdims=True) if len(emit) else emit
    np.exp(psi, out=psi)
    move = np.exp(transitions)
    alpha = np.empty_like(psi)
    moved = np.zeros_like(transitions)
    steps = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(steps), "left") if steps else []  # texts longer than t
    for t in range(steps):
        rows = begin[: running[t]] + t
        now = psi[rows] if not t else (last[: running[t]] @ move) * psi[rows]
        now /= now.sum(1, keepdims=True)
        alpha[rows] = last = now
    beta = np.ones((len(lengths), emit.shape[1]))
    for t in range(steps - 1, -1, -1):
        n = running[t]
        rows = begin[:n] + t
        both = alpha[rows] * beta[:n]
        both /= both.sum(1, keepdims=True)
        alpha[rows] = both
        if t:
            ahead = psi[rows] * beta[:n]
            back = ahead @ move.T
            norm = (alpha[rows - 1] * back).sum(1, keepdims=True)
            moved += move * (alpha[rows - 1].T @ (ahead / norm))
            beta[:n] = back / back.sum(1, keepdims=True)
    return alpha, moved


def fit_crf(texts: list[str], langs: list[str], epochs: int = 3, batch: int = 100, rate: float = 0.3, decay: float = 1e-6, seed: int = 5) -> Crf:
    """Adagrad on the conditional log-likelihood of texts whose words all have the text's label."""
    import pyarrow as pa

    languages = sorted(set(langs))
    n = len(languages)
    crf = Crf(languages, np.zeros((1 << BITS, n), np.float32), np.empty(0, U64), np.empty(0, np.int64), np.zeros((n, n)), np.zeros((n, n)))
    if not n:
        return crf
    label = np.array([languages.index(x) for x in langs])
    tables = [Words(pa.array(texts[i : i + batch])) for i in range(0, len(texts), batch)]
    gold = [np.repeat(label[i * batch : (i + 1) * batch], np.diff(t.first)) for i, t in enumerate(tables)]
    hashes, inverse = np.unique(np.concatenate([t.hashes for t in tables]), return_inverse=True)
    seen = np.bincount(inverse * n + np.concatenate(gold), minlength=len(hashes) * n).reshape(-1, n)
    total, most = seen.sum(1), seen.max(1)
    entry = np.flatnonzero((total >= 3) & (most >= 0.8 * total))
    entry = np.sort(entry[np.argsort(-total[entry], kind="stable")[:LEXICON]])
    crf.lexicon, crf.lexicon_language = hashes[entry], seen[entry].argmax(1)
    rng = np.random.default_rng(seed)
    squares = [np.full(x.shape, 1e-4) for x in (crf.weights, crf.lexicon_weights, crf.transitions)]
    for _ in range(epochs):
        for i in rng.permutation(len(tables)):
            t, y = tables[i], gold[i]
            if not len(y):
                continue
            error, moved = marginals(crf.emissions(t), t.first, crf.transitions)
            error[np.arange(len(y)), y] -= 1
            slots, word = t.slots()
            grads = [np.empty(crf.weights.shape), np.zeros((n, n)), moved]
            for k in range(n):
                e = error[:, k]
                grads[0][:, k] = np.bincount(slots, e[word], 1 << BITS) + np.bincount(t.prefix, e, 1 << BITS) + np.bincount(t.suffix, e, 1 << BITS)
            found, lang = crf.entries(t.hashes)
            np.add.at(grads[1], lang, error[found])
            inside = np.ones(len(y), bool)
            inside[t.first[:-1][np.diff(t.first) > 0]] = False
            np.subtract.at(grads[2], (y[np.flatnonzero(inside) - 1], y[inside]), 1)
            for x, g, s in zip((crf.weights, crf.lexicon_weights, crf.transitions), grads, squares, strict=True):
                g = g / len(y) + decay * x
                s += g * g
                x -= (rate * g / np.sqrt(s)).astype(x.dtype)
    return crf


def learn(docs: DataFrame, train, sample: int = 1200) -> Crf:
    """A model from at most `sample` texts with a language among the rows where train holds."""
    ids = docs.where(train).where("lang is not null and doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "id").limit(sample).select("id")
    rows = docs.join(F.broadcast(ids), docs.doc_id == ids.id).where("lang is not null").select("doc_id", docs.text.cast("string").alias("text"), "lang").orderBy("doc_id", "lang").limit(2 * sample).collect()  # repeated ids may add a few
    return fit_crf([r["text"] or "" for r in rows], [r["lang"] for r in rows])


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def label(docs: DataFrame, crf: Crf, keep: list[str] | None = None) -> DataFrame:
    """docs' rows as the columns `keep` (doc_id unless given), lang_pred, score, n_words, n_switched: the language
    with the most probability mass, its mean probability, and the words that another language holds."""

    def predict(text):
        import pyarrow as pa

        t = Words(text)
        counts = np.diff(t.first)
        ascii_letter = np.concatenate(([0], np.cumsum((t.low >= 97) & (t.low <= 122))))
        lettered = ascii_letter[t.at[1:]] > ascii_letter[t.at[:-1]]
        for i in np.flatnonzero(~lettered & (counts > 0)):
            lettered[i] = has_letter(t.low[t.at[i] : t.at[i + 1]].tobytes())
        names, score, switched = ["und"] * len(counts), np.zeros(len(counts)), np.zeros(len(counts), np.int64)
        if crf.languages and len(t.hashes):
            gamma, _ = marginals(crf.emissions(t), t.first, crf.transitions)
            leading = gamma.argmax(1)
            sums = np.zeros((len(gamma) + 1, gamma.shape[1]))
            np.cumsum(gamma, 0, out=sums[1:])
            mass = sums[t.first[1:]] - sums[t.first[:-1]]
            best = mass.argmax(1)
            odd = np.concatenate(([0], np.cumsum(leading != np.repeat(best, counts))))
            switched = odd[t.first[1:]] - odd[t.first[:-1]]
            score = np.clip(mass.max(1) / np.maximum(counts, 1), 0, 1)
            names = [crf.languages[k] if ok else "und" for k, ok in zip(best, lettered)]
        score[~lettered] = 0
        return [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(counts, pa.int64()), pa.array(switched, pa.int64())]

    return with_text_columns(docs, keep or ["doc_id"], predict, "lang_pred string, score double, n_words long, n_switched long", LOT_BYTES)
