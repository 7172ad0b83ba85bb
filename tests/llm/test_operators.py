"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from graphloom.llm import bytebpe, common, embeddings, language, licenses, line_templates, media, near_duplicates, packing, token_counts, toxicity

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "word " * 30_000
EDGES = [None, "", " ", "\n\n", "a", "a  b \n c", "é ß 漢字 🎉", "<|endoftext|> x<|endoftext|>", "x" * 5000, LONG, "same", "same"]


def docs(spark, texts, **extra):
    rows = [(i, t, *(v[i] for v in extra.values())) for i, t in enumerate(texts)]
    kinds = "".join(f", {k} {'string' if k in ('lang', 'source') else 'long'}" for k in extra)
    return spark.createDataFrame(rows, "doc_id long, text string" + kinds)


def clashing(df):
    """With columns whose names operators might use themselves."""
    return df.withColumns({c: F.lit(1) for c in ("n", "s", "k", "d", "h", "score", "rep", "line", "_text", "id")})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    return [" ".join(words(rng, rng.randrange(5, 200))) for _ in range(120)]


def test_word_hashes_are_the_words():
    texts = ["ab ab\tba", "", "ab", "A" * 3, "é é", "x" * (common.CHUNK + 5)]
    data, at = common.joined(pa.array(texts))
    starts, ends, first = common.word_spans(data, at, common.SPACES)
    h = common.hash_words(data, starts, ends)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in t.split()] and first.tolist() == [0, 3, 3, 4, 5, 7, 8]
    assert len(set(h.tolist())) == len(set(found))


# 1


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(1)
    texts = [" ".join(words(rng, 60) + ["vile", "scum"] * (i % 5 == 0)) for i in range(600)] + EDGES
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    d = clashing(docs(spark, texts))
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, labels, F.col("doc_id") % 4 != 1).collect()}
    assert all((out[i] >= 0.5) == (i % 5 == 0) for i in range(600)) and len(out) == len(texts)
    assert all(0 <= s < 0.5 for i, s in out.items() if i >= 600)
    assert toxicity.toxicity(empty(spark), labels, F.lit(True)).count() == 0
    assert {r["score"] < 0.01 for r in toxicity.toxicity(d, labels.limit(0), F.lit(True)).collect()} == {True}


def test_risk_is_corrected_by_the_prior():
    """Unlabelled texts that hold the marker as often as the prior says still score as toxic."""
    rng = np.random.default_rng(0)
    noise = lambda: rng.integers(100, 1000, 20)
    pos = [np.append(noise(), 7).astype(np.int32) for _ in range(200)]
    unl = [np.append(noise(), 7 if i < 100 else 8).astype(np.int32) for i in range(500)]
    counts = [np.bincount(np.concatenate([np.unique(t) for t in part]), minlength=1000) for part in (pos, unl)]
    use = toxicity.telling(*counts, len(pos), len(unl))
    m = toxicity.fit_nnpu([t[use[t]] for t in pos], [t[use[t]] for t in unl], 0.2, 1000)
    score = lambda x: m.score(np.array([x]), np.array([0, 1]))[0]
    assert score(7) > 0.5 > score(8)


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(4)
    noise = lambda: np.unique(rng.integers(20, 400, 15)).astype(np.int32)
    for share in (0.05, 0.15, 0.3):
        pos = [np.concatenate((rng.choice(20, 5, False).astype(np.int32), noise())) for _ in range(400)]
        unl = [np.concatenate((rng.choice(20, 5, False).astype(np.int32), noise())) if rng.random() < share else noise() for _ in range(2000)]
        assert abs(toxicity.class_prior(pos, unl, 400) - share) < 0.04
    assert toxicity.class_prior([], unl, 400) == toxicity.class_prior(pos, unl, 0) == 0.01


def test_risk_gradient_matches_differences():
    """One step of the fit follows the numeric gradient of the non-negative risk, in both of its cases."""
    rng = np.random.default_rng(5)
    size, prior = 12, 0.3
    texts = lambda n: [np.unique(rng.integers(0, size, 4)).astype(np.int32) for _ in range(n)]
    pos, unl = texts(6), texts(10)

    def risks(w, bias):
        z = lambda part: np.array([w[t].sum() + bias for t in part])
        zp, zu = z(pos), z(unl)
        return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

    for bias in (0.0, -3.0):  # the corrected part is positive, then negative
        w = rng.normal(0, 0.3, size)
        positive, corrected = risks(w, bias)
        loss = (lambda w: sum(risks(w, bias))) if corrected >= 0 else (lambda w: -risks(w, bias)[1])
        numeric = np.array([(loss(w + 1e-6 * e) - loss(w - 1e-6 * e)) / 2e-6 for e in np.eye(size)])
        first = np.cumsum([0] + [len(t) for t in pos + unl])
        s = toxicity.Model(w, bias).score(np.concatenate(pos + unl), first)
        g, negative = toxicity.risk_gradient(s, len(pos), prior)
        assert (negative >= 0) == (corrected >= 0) and abs(negative - corrected) < 1e-6
        found = np.bincount(np.concatenate(pos + unl), np.repeat(g, np.diff(first)), size)
        assert np.allclose(found, numeric, atol=1e-5), bias


def test_slot_counts_are_those_of_distinct_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(bool(i % 3), np.unique(rng.integers(0, 1 << toxicity.BITS, 30)).astype(np.int32).tobytes()) for i in range(40)]
    rows += rows[:7] + [(True, b""), (False, b"")]
    pos, unl, n_pos, n_unl = toxicity.slot_counts(spark.createDataFrame(rows, "confirmed boolean, slots binary"))
    for kind, found, n in ((True, pos, n_pos), (False, unl, n_unl)):
        texts = {s for c, s in rows if c is kind}
        want = np.bincount(np.concatenate([np.frombuffer(s, np.int32) for s in texts]), minlength=1 << toxicity.BITS)
        assert n == len(texts) and (found == want).all()


# 2


def test_token_counts_match_a_unigram_tokenizer(spark, prose):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    exact = Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], unk_id=0, byte_fallback=True))
    texts = EDGES + prose[:30] + ["a   b", " lead", "trail ", "▁▁x", "   "]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(clashing(docs(spark, texts)), PIECES).collect()}
    want = {i: len(exact.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for i, t in enumerate(texts)}
    assert got == want and token_counts.token_counts(empty(spark), PIECES).count() == 0


def test_ties_take_the_longest_piece():
    vocabulary = [("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b", -1.0), ("ab", -2.0)]
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    counter = token_counts.UnigramCounter(vocabulary, False, -3.0)
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("aabx") for _ in range(rng.randrange(1, 12)))
        assert counter.count_marked(t) == len(exact.encode(t).ids), t


# 3


def brute_base(text):
    tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [k for p in licenses.BASE for k in range(len(tokens)) if tokens[k : k + len(p.split())] == p.split()]
    return len(tokens), len(at), min(at, default=None), max(at, default=None)


def test_license_scans(spark):
    texts = EDGES + ["Released under the MIT License. Licensed under the Apache License, Version 2.0.", "mit-license MIT\nLICENSE", "licensed under the GNU general public license, version 3", "Licensed under CC BY-NC 4.0.", "under the apache licenses 2.0", "MİT license"]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(clashing(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == brute_base(t)
    n = len(EDGES)
    assert rows[n]["base_labels"] == "apache,mit" and rows[n]["labels"] == "apache,apache-2.0-notice,mit,mit-notice"
    assert rows[n + 2]["labels"] == "gpl,gpl-3.0-notice" and rows[n + 3]["labels"] == "cc-by-nc-4.0" and rows[n + 4]["labels"] == ""
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_automata_take_optional_and_replaceable_words():
    a = licenses.Automaton.compile("x", "use of {{who;this}} software [[and docs]] is free")
    find = lambda t: a.find(licenses.words(t.encode()))
    assert find("Use of THIS software is free") == [(0, 6)] and find("see: use of any odd software, and docs is free!") == [(1, 10)]
    assert find("use of software is free") == [] and find("use of this software and is free") == [] and find("use of " + "w " * 9 + "software is free") == []


def test_automata_begin_with_optional_and_replaceable_words():
    find = lambda template, t: licenses.Automaton.compile("x", template).find(licenses.words(t.encode()))
    assert find("[[the]] software is free", "software is free") == [(0, 3)] and (0, 4) in find("[[the]] software is free", "the software is free")
    assert find("[[this]] [[the]] software", "a software") == [(1, 2)] and (0, 2) in find("[[this]] [[the]] software", "this software")
    assert find("{{a;x}} {{b;y}} is free", "x y is free") == [(0, 4)] and find("{{a;x}} {{b;y}} is free", "u v x y is free") == [(2, 6)] and find("{{a;x}} {{b;y}} is free", "y is free") == []
    assert (0, 4) in find("[[the]] {{a;x}} is free", "the x is free") and find("[[the]] {{a;x}} is free", "x is free") == [(0, 3)]


def test_nested_and_open_regions_are_errors():
    for template in ("a [[b {{c;d}} e]]", "a [[b [[c]] d]]", "a {{b;c", "a [[b"):
        with pytest.raises(ValueError):
            licenses.Automaton.compile("x", template)


def template_pattern(template):
    """The template as a regular expression over words that end with a space."""
    out = ""
    for part in re.findall(r"\[\[.*?\]\]|\{\{.*?\}\}|[^\[{]+", template):
        if part.startswith("[["):
            out += "(?:" + "".join(w + " " for w in part[2:-2].split()) + ")?"
        elif part.startswith("{{"):
            out += r"(?:\w+ ){1,%d}" % licenses.REPLACEMENT
        else:
            out += "".join(w + " " for w in part.split())
    return out


def test_automata_match_regular_expressions():
    """Which texts hold random templates, and where a match may begin."""
    rng = random.Random(12)
    found = 0
    for _ in range(600):
        parts = [rng.choice(("{}", "{}", "[[{}]]", "{{{{x;{}}}}}")).format(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 3)))) for _ in range(rng.randrange(1, 5))]
        if all(p.startswith(("[[", "{{")) for p in parts):
            parts.append("a")
        template = " ".join(parts)
        text = [rng.choice("abcd") for _ in range(rng.randrange(0, 14))]
        pattern = re.compile(template_pattern(template))
        want = [k for k in range(len(text)) if pattern.match("".join(w + " " for w in text[k:]))]
        got = licenses.Automaton.compile("x", template).find([w.encode() for w in text])
        found += bool(want)
        assert bool(got) == bool(want), (template, text)
        assert {k for k, _ in got} <= set(want), (template, text)
    assert found > 150


def test_whole_license_texts(spark):
    plain = {name: re.sub(r"\{\{\w+;(.*?)\}\}", r"\1", re.sub(r"\[\[(.*?)\]\]", r"\1", t)) for name, t in licenses.TEXTS.items()}
    other = {name: re.sub(r"\{\{\w+;(.*?)\}\}", "Some Other Holder", re.sub(r"\[\[(.*?)\]\]", "", t)) for name, t in licenses.TEXTS.items()}
    texts = ["Copyright (c) 2001 A B\n\n" + t.replace(" ", "\n  ", 7) for t in (*plain.values(), *other.values())]
    broken = [t.replace("software", "hardware", 2).replace("SOFTWARE", "HARDWARE", 2).replace("Software", "Hardware", 2) for t in texts]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts + broken)).collect()}
    for i, name in enumerate([*plain, *other]):
        assert name in rows[i]["labels"].split(",") and rows[i]["score"] > 0.8, name
        assert name not in rows[len(texts) + i]["labels"].split(","), name


# 4


def drop_brute(rows, depth=2):
    """Every pair of lines is compared; rows (document, text)."""
    where = collections.defaultdict(list)
    for d, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                where[tuple("<*>" if re.search("[0-9]", w) else w for w in line.strip(" ").split(" "))].append((d, i))
    gone = set()
    for a, places in where.items():
        like = [b for b in where if len(a) == len(b) and a[:depth] == b[:depth] and 5 * sum(x == y for x, y in zip(a, b)) >= 4 * len(a)]
        first = min(min(where[b])[0] for b in like)
        gone |= {p for p in places if p[0] > first}
    return gone


def held_against_brute(spark, texts, depth):
    rows = list(enumerate(texts))
    gone = drop_brute(rows, depth)
    d = clashing(docs(spark, texts))
    out = line_templates.drop_recurring_lines(d, depth)
    assert out.columns == [*d.columns, "n_lines", "n_dropped"]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in out.collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i] == (want, sum(a == i for a, _ in gone)), i
    return gone


@pytest.mark.parametrize("depth", [1, 2])
def test_line_templates_match_brute_force(spark, depth):
    rng = random.Random(7)
    pool = [words(rng, n) for n in (1, 2, 4, 5, 6, 9, 10, 14, 31, 60) for _ in range(4)]
    texts = []
    for _ in range(90):
        lines = ["", "\t", f"error {rng.randrange(99)} in {rng.choice('abc')} x"]
        for _ in range(rng.randrange(1, 9)):
            w = list(rng.choice(pool))
            for _ in range(rng.randrange(len(w) // 4 + 2)):
                if len(w) > 3:
                    w[rng.randrange(depth, len(w))] = rng.choice(("odd", "even", f"n{rng.randrange(9)}"))
            lines.append(" ".join(w))
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    # Several variable words with and without digits; one under 12 tokens; a short line.
    texts += ["a b c " + " ".join(f"{q}{x}" if q in "fjq" else q for q in "defghijklmnopqrst") for x in ("one", "two")]
    texts += ["to be or not to see\nLes.", "to be or not to go\nLes."] + EDGES
    gone = held_against_brute(spark, texts, depth)
    assert len(gone) > 100 and {(91, 0), (93, 0), (93, 1)} <= gone
    assert line_templates.drop_recurring_lines(empty(spark)).count() == 0


def test_large_bands_are_refined(spark):
    """Many dissimilar lines that share a band, and similar ones among them that their bands' first lines don't tell."""
    rng = random.Random(9)
    texts = []
    for i in range(70):
        w = ["the", "log", *(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}" for _ in range(18)), *"one common end of many lines here".split()]
        texts.append(" ".join(w))
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(2, 20)] = "other"
            texts.append("before\n" + " ".join(w))
    gone = held_against_brute(spark, texts, 2)
    assert 10 < len(gone) < 60


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(1, "one line that recurs\nown"), (1, "one line that recurs\nelse"), (1, "one line that recurs\nown"), (2, "one line that recurs\nelse"), (None, "x y z\nx y z"), (None, None)]
    out = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_dropped) for r in out) == [(0, "", 0), (0, "x y z\nx y z", 0), (1, "one line that recurs\nelse", 0), (1, "one line that recurs\nown", 0), (1, "one line that recurs\nown", 0), (2, "", 2)]


def test_line_plan_is_native(spark):
    plan = line_templates.drop_recurring_lines(docs(spark, ["a b c"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5


def components_brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return [len(s) for s in sets], root


def test_near_duplicates_match_brute_force(spark, prose):
    rng = random.Random(4)
    texts = list(prose) + EDGES
    for t in prose[:40]:
        for _ in range(rng.randrange(4)):
            w = t.split()
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w) + rng.choice(("", " tail", "\n")))
    sizes, root = components_brute(texts)
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(clashing(docs(spark, texts))).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0


def test_keys_lose_no_link():
    """Sets of all shapes, where empty classes are frequent too: linked sets share as many keys of an entry as it needs."""
    rng = np.random.default_rng(1)
    none, all_hot = np.zeros(1 << near_duplicates.CELL_BITS - 3, np.uint8), np.full(1 << near_duplicates.CELL_BITS - 3, 255, np.uint8)
    some_hot = rng.integers(0, 256, 1 << near_duplicates.CELL_BITS - 3).astype(np.uint8)
    linked = 0
    for hot in (none, all_hot, some_hot):
        for k in range(260):
            n = int(rng.integers(4, 60) if k < 200 else rng.integers(60, 3000))
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate((a[: n - int(rng.integers(0, n // 9 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64)))
            x, y = np.unique(a), np.unique(b)
            both = len(np.intersect1d(x, y))
            if x.tobytes() == y.tobytes() or 100 * both < 80 * (len(x) + len(y) - both):
                continue
            linked += 1
            keys, entry, owner, tag, need = near_duplicates.all_keys(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]), hot)
            mine = [{e: set(keys[entry == e].tolist()) for e in np.flatnonzero(owner == i)} for i in (0, 1)]
            shared = [(e, f, len(p & q)) for e, p in mine[0].items() for f, q in mine[1].items()]
            assert any(m >= max(need[e], need[f]) for e, f, m in shared)
            assert len(set(zip(owner.tolist(), tag.tolist()))) == len(owner)
            s, t = near_duplicates.bit_sketch(x).view(np.uint64), near_duplicates.bit_sketch(y).view(np.uint64)
            words = min(len(s), len(t))
            assert 9 * int(np.bitwise_count(near_duplicates.folded(s, words) ^ near_duplicates.folded(t, words)).sum()) <= len(x) + len(y)
    assert linked > 300


def test_telling_keys_keep_a_key_of_each_pair_that_shares_enough(spark):
    rng = random.Random(8)
    sets = {s: {rng.randrange(60) for _ in range(20)} for s in range(40)}
    for s in range(40, 70):
        sets[s] = set(sorted(sets[s - 40])[: 12 + s % 8]) | {100 + s}
    need = {s: rng.choice((3, 6, 9, 12)) for s in sets}
    rows = [(g, s, 0, need[s], 0) for s, keys in sets.items() for g in keys if sum(g in x for x in sets.values()) >= 2]
    kept = {(r.g, r.s) for r in near_duplicates.telling_keys(spark.createDataFrame(rows, "g long, s long, tag int, need int, size int")).collect()}
    assert kept and len(kept) < len(rows)
    for s, x in sets.items():
        for t, y in sets.items():
            if s < t and len(x & y) >= max(need[s], need[t]):
                assert any((g, s) in kept and (g, t) in kept for g in x & y), (s, t)


def test_long_near_duplicates_and_repeated_ids(spark, monkeypatch):
    """Sets wider than the first sketch, repeated and null ids, many near copies of one text."""
    monkeypatch.setattr(near_duplicates, "CELL_SETS", 5)  # a grid of many cells
    monkeypatch.setattr(near_duplicates, "ROUNDS", 0)  # all candidates go there
    rng = random.Random(14)
    long = [words(rng, 2500, 9000) for _ in range(4)]
    texts = [" ".join(w) for w in long]
    for w in long:
        for share in (5, 40, 90, 260, 700):
            v = list(w)
            for _ in range(share):
                v[rng.randrange(len(v))] = "z" + str(rng.randrange(10**6))
            texts.append(" ".join(v))
    base = words(rng, 120, 5000)
    for k in range(60):
        v = list(base)
        v[k] = f"own{k}"
        v[(k * 7) % 120] = f"more{k}"
        texts.append(" ".join(v))
    sizes, root = components_brute(texts)
    ids = [*range(len(texts))]
    rows = list(zip(ids, texts)) + [(None, texts[0]), (3, texts[-1])]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and [r for r in got if r.doc_id is None] == [(None, sizes[0], None)]
    same = {root[3], root[-1]}  # the texts of id 3 join these
    want = [min(same) if r in same else r for r in root]
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(enumerate(want))
    one = near_duplicates.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in one.collect()} == {None, *want}


# 6


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = [base[i % 40] + rng.normal(size=8) * (0.0 if i % 7 == 0 else 0.06) for i in range(400)]
    v = [(i, [float(np.float32(x)) for x in r], i % 3) for i, r in enumerate(rows)]
    v += [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0, None] + [0.0] * 6, 1), (403, [float("nan")] * 8, 1), (404, v[0][1], None), (405, v[0][1], 0), (406, [2 * x for x in v[0][1]], 0), (407, [1.0, 2.0], 0)]
    df = clashing(spark.createDataFrame(v, "vec_id long, embedding array<float>, label int"))
    sound = [i for i, e, label in v if label is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(e) and len(e) == 8]
    x = np.array([v[i][1] for i in sound], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([v[i][2] for i in sound])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(len(sound))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(sound)).min(1))
        if (new == root).all():
            break
        root = new
    want = {i: (0, i, True) for i, *_ in v} | {i: (int(link[k].sum()), sound[root[k]], sound[root[k]] == i) for k, i in enumerate(sound)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_links(df).collect()} == want
    assert embeddings.embedding_links(df.limit(0)).count() == 0


# 7


def test_encoding_is_the_library_s(spark, prose):
    exact, own = Tokenizer.from_file(BPE), bytebpe.ByteBPE(BPE)
    rng = random.Random(6)
    alphabet = [*"abcdeTHEqz   \n\t.,'sd1290é \xa0\x1c\x85漢🎉ß", "<|endoftext|>", "'ll", "  ", "\n\n", " the"]
    texts = [t or "" for t in EDGES] + prose[:20] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    for t in texts:
        ids = exact.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == exact.decode(ids, skip_special_tokens=False) and packing._encoder(BPE)(t) == ids
    for r in bytebpe.digests(clashing(docs(spark, texts[:200])), BPE).collect():
        ids = exact.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(exact.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_forced_boundaries_are_in_no_token():
    own = bytebpe.ByteBPE(BPE)
    word = "Öqzthe漢字".encode()
    parts = own.fragments(word)
    assert b"".join(parts) == word and len(parts) > 1
    assert all(bytes((a[-1], b[0])) not in t for a, b in zip(parts, parts[1:]) for t in own.token_bytes.values())


# 8


def test_media_round_trip(spark, tmp_path):
    texts = EDGES + ["x" * 64, "x" * 65]
    out = media.media_columns(clashing(docs(spark, texts)), f"file://{tmp_path}/media")
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and (r["width"], r["height"]) == (64, len(payload) // 64)
        assert r["feature"] == f"png:64x{len(payload) // 64}x8:levels={len(set(payload))}:mean={sum(payload) * 1000 // len(payload)}"
        with open(tmp_path / "media" / r["shard"], "rb") as f:
            f.seek(r["offset"])
            assert hashlib.sha256(f.read(r["length"])).hexdigest() == r["media_sha256"] == r["digest"]
    assert rows[10].asDict() | {"doc_id": 11} == rows[11].asDict()
    import tarfile

    for shard in (tmp_path / "media").glob("*.tar"):
        assert all(m.isfile() for m in tarfile.open(shard).getmembers())
    assert media.media_columns(empty(spark), f"file://{tmp_path}/none").count() == 0


# 9


def best_fit_brute(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.randrange(4, 60)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 120))]
        counts = collections.Counter(lengths)
        plan, bins = packing.best_fit_decreasing(dict(counts), capacity)
        assert bins == best_fit_brute(lengths, capacity)
        placed = [(first + k, offset, n) for n, lo, hi, first, offset in plan for k in range(hi - lo)]
        assert sum(hi - lo for _, lo, hi, _, _ in plan) == len(lengths)
        fill = collections.Counter()
        for s, offset, n in sorted(placed):
            assert fill[s] == offset
            fill[s] += n
        assert all(n <= capacity for n in fill.values()) and set(fill) == set(range(bins))


def test_packing(spark, prose):
    texts = EDGES + prose + [" " * 1_000_000 + "x", "a" + "\n \t" * 400_000, "y" * 300_000, "z\u3000\u00a0" + "\u2003" * 5000 + "q <|endoftext|>" + " " * 3000]
    exact = Tokenizer.from_file(BPE)
    rows = packing.pack(clashing(docs(spark, texts)), BPE, 128).collect()
    fill, of = collections.Counter(), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill[r["sequence_id"]] == r["offset"]
        fill[r["sequence_id"]] += r["length"]
        of[r["doc_id"]].append(r)
    assert max(fill.values()) <= 128 and len(fill) == best_fit_brute([r["length"] for r in rows], 128)
    for i, t in enumerate(texts):
        ids, at = [*exact.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(of[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 128)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(empty(spark), BPE).count() == 0


# 10


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    emit, move, first = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 9])
    gamma, moved = language.marginals(emit, first, move)
    want, pairs = np.zeros_like(emit), np.zeros((3, 3))
    for a, b in zip(first, first[1:]):
        paths = list(itertools.product(range(3), repeat=b - a))
        weight = np.array([np.exp(sum(emit[a + k, y] for k, y in enumerate(p)) + sum(move[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            for k, y in enumerate(p):
                want[a + k, y] += w
            for x, y in zip(p, p[1:]):
                pairs[x, y] += w
    assert np.allclose(gamma, want) and np.allclose(moved, pairs)


def test_features_come_in_lots():
    rng = random.Random(3)
    t = language.Words(pa.array([" ".join(words(rng, 40)) + "  é ß, x!" for _ in range(9)] + ["", None, "ab"]))
    whole, of = t.slots()
    for i, j in ((0, 5), (5, 300), (300, len(t.hashes)), (7, 7)):
        slots, word = t.slots(i, j)
        mine = (of >= i) & (of < j)
        assert (slots == whole[mine]).all() and (word == of[mine] - i).all()


def test_language_labels(spark):
    rng = random.Random(9)
    roots = {"aa": ["the", "ing", "wh", "tion"], "bb": ["ß", "ung", "sch", "keit"], "cc": ["ñ", "que", "ción", "ado"]}
    make = lambda lang, n: " ".join("".join(rng.choice(roots[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    langs = [rng.choice(list(roots)) for _ in range(300)]
    texts = [make(x, rng.randrange(3, 60)) for x in langs]
    mixed = make("aa", 30) + " " + make("bb", 20)
    every = texts + [mixed, "123 --- 456", *EDGES]
    d = clashing(docs(spark, every, lang=[*langs, *[None] * (len(every) - 300)]))
    crf = language.learn(d, F.col("doc_id") % 3 != 0)
    out = {r["doc_id"]: r for r in language.label(d, crf).collect()}
    held = [i for i in range(0, 300, 3)]
    assert sum(out[i]["lang_pred"] == langs[i] for i in held) >= 0.98 * len(held)
    assert out[300]["lang_pred"] == "aa" and 12 <= out[300]["n_switched"] <= 28
    assert [out[i]["lang_pred"] for i in (301, 302, 303, 304, 305)] == ["und"] * 5 and out[301]["score"] == 0
    assert len(out) == len(every) and all(0 <= r["score"] <= 1 for r in out.values())
    none = language.label(d, language.learn(d.where("lang is null"), F.lit(True)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and language.label(empty(spark), crf).count() == 0


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in touched}
