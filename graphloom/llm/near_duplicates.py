"""N-gram Jaccard join by parity sketches: exact, without comparing all pairs.

A text's set is its distinct 5-word shingles as 64-bit hashes. Two sets A, B with
Jaccard >= 0.8 differ in at most (|A| + |B|) // 9 shingles. In a size band the shingles
are dealt by hash to m classes, more than the most that two sets of the band can differ
in, and each class is reduced to the XOR of its members: a wide parity sketch, whose
Hamming distance counted in classes is at most the symmetric difference (pigeonhole).
A set emits one key per filled class. If it fills f and differs from a linked one in at
most d shingles, they share f - d keys or more. So a set needs that many keys which
others have as well: sets that have fewer link with nothing, and the others may leave
out all but their rarest ones. A set with f <= d also emits keys under other seeds, and
after those with its empty classes: no link is lost. Shingles that very many documents
hold are left out of the first sketch, which can only bring sets closer; they are found
by counting all shingles of all documents in a table of cells.

Equal sets meet first: keys carry the set's own hash, so copies count once. Candidates
are compared in rounds: each set first with one pivot of its key groups, then with
another, and only what key groups hold across components so far with all the others,
pruned by a bit sketch whose Hamming distance is a lower bound of the symmetric
difference. What remains is verified on the whole sets, the last round's where they meet.

Cases: null, empty and blank texts have no shingles and link with nothing; fewer than
five words are one shingle; rows with equal ids are one vertex; a null id has a null
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .common import LOWER, SPACES, U64, arrow_map, components, hash_words, joined, mix64, settled, word_spans

WORDS = 5
#: Cells that count shingles, and ranges they are summed in.
CELL_BITS, RANGES = 23, 64
#: Keys that one grouping task is meant to get, and that a task holds before it sends them on.
BUCKET_KEYS, FLUSH_KEYS = 3_000_000, 500_000
#: Bytes of text whose shingles a worker makes at once.
LOT_BYTES = 1 << 19
#: Bits of the sketch that prunes candidates.
SKETCH_BITS = 1024
#: Sets of one part of a place where groups are compared, and their shingles.
CELL_SETS, CELL_SHINGLES = 1024, 2_000_000
#: Seeds beside the first, and rounds in which a set meets one pivot.
LEVELS, ROUNDS = 4, 2
#: Bits of a table of wanted documents, at most.
WANTED_BITS = 27

# Cells of sizes: the smaller set of a pair lies in one, the larger is at most 5/4 of it.
EDGES = [1]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 8 // 5))
EDGES_ARRAY = np.array(EDGES)


def most_different(cell: int) -> int:
    """The largest symmetric difference of a linked pair whose smaller set lies in the cell."""
    a = EDGES[cell + 1] - 1
    return (a + a * 5 // 4) // 9


def classes(d: int) -> int:
    """More than d, by so many that unrelated sets rarely share as many keys as linked ones must."""
    return d + 2 + int(0.15 * d + 0.5 * d**0.5) if d else 0


def shingles(column) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, flat, and the first of each text."""
    data, at = joined(column)
    low = LOWER[data]
    starts, ends, first = word_spans(low, at, SPACES)
    words = hash_words(low, starts, ends)
    n = np.diff(first)
    k = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))  # shingles of each text
    doc = np.repeat(np.arange(len(n)), k)
    begin = np.concatenate(([0], np.cumsum(k)))
    place = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], k)
    short = np.repeat(n < WORDS, k)
    acc = np.zeros(len(place), U64)
    padded = np.concatenate((words, np.zeros(WORDS, U64)))
    for j in range(WORDS):
        w = mix64(padded[place + j] + U64(0x9E3779B97F4A7C15 * (2 * j + 1) & (1 << 64) - 1))
        if short.any():
            w = np.where(short & (j >= np.repeat(n, k)), U64(0), w)
        acc += w
    acc = mix64(acc ^ mix64(np.where(short, np.repeat(n, k), WORDS).astype(U64)))
    order = np.lexsort((acc, doc)) if len(acc) else np.empty(0, np.int64)
    acc, doc = acc[order], doc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    acc, doc = acc[new], doc[new]
    return acc, np.searchsorted(doc, np.arange(len(n) + 1))


def set_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 of empty ones."""
    n = np.diff(first)
    out = np.zeros(len(n), U64)
    full = np.flatnonzero(n)
    if len(full):
        at = first[:-1][full]
        x = np.bitwise_xor.reduceat(mix64(hashes), at)
        s = np.add.reduceat(mix64(hashes ^ U64(0xD1B54A32D192ED03)), at)
        out[full] = mix64(mix64(x) + s * U64(0x9E3779B97F4A7C15) + n[full].astype(U64)) | U64(1)
    return out


def read_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s) of every row, and rows (part, cells) of shingle counts, in one pass."""

    def run(it):
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        held: list[np.ndarray] = []

        def add():
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            counts[cells] += n.astype(np.uint32)
            held.clear()

        for b in it:
            h, first = shingles(b.column(1))
            held.append((h >> U64(64 - CELL_BITS)).astype(np.uint32))
            if sum(map(len, held)) > 1_000_000:
                add()
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first), pa.int64()), pa.array(set_hashes(h, first).view(np.int64)), pa.nulls(b.num_rows, pa.int32()), none], names=["doc_id", "n", "s", "part", "cells"])
        if held:
            add()
        if counts.any():
            small = counts.astype("<u1" if counts.max() < 1 << 8 else "<u4")
            cells = [zlib.compress(bytes([small.itemsize]) + x.tobytes(), 1) for x in np.split(small, RANGES)]
            none = pa.nulls(RANGES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(RANGES), pa.int32()), pa.array(cells, pa.binary())], names=["doc_id", "n", "s", "part", "cells"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n long, s long, part int, cells binary", LOT_BYTES)


def hot_cells(read: DataFrame, total: int, rows: int) -> np.ndarray:
    """Which cells the shingles of more than one in 4000 documents fall in: 2**CELL_BITS bits."""
    least = max(12, rows // 4000, 4 * total >> CELL_BITS)

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = zlib.decompress(cells)
                x = np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)
                sums[part] = sums[part] + x if part in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x > least).tobytes() for x in sums.values()], pa.binary())], names=["part", "hot"])

    flags = np.zeros(1 << CELL_BITS - 3, np.uint8)
    width = len(flags) // RANGES
    for r in arrow_map(read.where("cells is not null").select("part", "cells").repartition(RANGES, "part"), add, "part int, hot binary").collect():  # 1 MB in all
        flags[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["hot"], np.uint8)
    return flags


def band_keys(h: np.ndarray, doc: np.ndarray, rows: np.ndarray, differ: np.ndarray, cell: int, hot: np.ndarray):
    """Keys of sets in a cell's band, level by level: yields keys, the place in rows of each, rows, and how
    many of its keys each must share with a linked set.

    h, doc: the sets' shingles and the set of each; rows: the sets, in order; differ: the most shingles
    that each may differ in from a linked one.
    """
    m = classes(most_different(cell))
    cell_of = (h >> U64(64 - CELL_BITS)).astype(np.int64)
    cold = (hot[cell_of >> 3] >> (7 - (cell_of & 7)).astype(np.uint8) & 1) == 0
    for level in range(LEVELS + 1):
        hh, dd = (h[cold], doc[cold]) if not level else (h, doc)
        salt = mix64(np.array([cell << 8 | level], U64))
        x = mix64(hh ^ salt)
        group = np.searchsorted(rows, dd) * m + (((x >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
        order = np.argsort(group)
        group, x = group[order], x[order]
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
        group, parity = group[begin], np.bitwise_xor.reduceat(x, begin) if len(begin) else np.empty(0, U64)
        keys, owners = mix64(parity ^ mix64((group % m).astype(U64) + salt)), group // m
        need = np.bincount(owners, minlength=len(rows)) - differ
        more = need <= 0  # such sets may share empty classes alone
        if level == LEVELS and more.any():
            there = np.zeros((len(rows), m), bool)
            there[owners, group % m] = True
            r, c = np.nonzero(~there & more[:, None])
            keys = np.concatenate((keys, mix64(mix64(c.astype(U64) + salt) ^ U64(0xA5A5A5A5))))
            owners = np.concatenate((owners, r))
            need = np.where(more, m - differ, need)
        yield keys, owners, level, rows, np.maximum(need, 1)
        rows, differ = rows[more], differ[more]
        if not len(rows):
            break
        keep = np.isin(doc, rows)
        h, doc, cold = h[keep], doc[keep], cold[keep]


def all_keys(h: np.ndarray, first: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The keys of every set, and the entry of each key; of each entry its set, its tag (one for each band
    and level of a set), and how many of its keys it must share with a linked set."""
    sizes = np.diff(first)
    own = np.searchsorted(EDGES_ARRAY, sizes, "right") - 1
    own[sizes == 0] = -1
    most = EDGES_ARRAY[np.maximum(own, 0)] - 1  # of the cell below
    below = np.where((own > 0) & (sizes <= most * 5 // 4), own - 1, -1)
    differ = (sizes + sizes * 5 // 4) // 9, (sizes + most) // 9
    out = [[np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)], [np.empty(0, np.int64)]]
    doc, entries = np.repeat(np.arange(len(sizes)), sizes), 0
    for cell in np.unique(np.concatenate((own, below))):
        if cell < 0 or not most_different(int(cell)):
            continue  # there only equal sets link
        rows = np.flatnonzero((own == cell) | (below == cell))
        mask = np.zeros(len(sizes), bool)
        mask[rows] = True
        mine = mask[doc]
        under = below == cell
        for keys, owners, level, sets, need in band_keys(h[mine], doc[mine], rows, np.where(under, differ[1], differ[0])[rows], int(cell), hot):
            for x, y in zip(out, (keys, owners + entries, sets, (under[sets].astype(np.uint8) << 3) | level, need)):
                x.append(y)
            entries += len(sets)
    return tuple(np.concatenate(x) for x in out)


def key_blocks(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Keys dealt to buckets: rows (bucket, block). A block holds its entries (set hash, need, tag), and each
    key's 40 low bits with the place of its entry."""

    def run(it):
        known: set[int] = set()
        held: list[tuple] = []
        n_keys = n_entries = 0

        def flush():
            nonlocal n_keys, n_entries
            if n_keys:
                keys, owners, ids, tags, needs = (np.concatenate(x) for x in zip(*held))
                bucket = ((keys >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                keys, owners, bucket = keys[order], owners[order], bucket[order]
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                blocks = []
                for k in full:
                    o, places = np.unique(owners[cut[k] : cut[k + 1]], return_inverse=True)
                    low = keys[cut[k] : cut[k + 1]]
                    parts = ([len(o), len(low)], "<u4"), (ids[o], "<u8"), (needs[o], "<u4"), (tags[o], "u1"), (low & U64(0xFFFFFFFF), "<u4"), (low >> U64(32) & U64(0xFF), "u1"), (places, "<u2")
                    blocks.append(b"".join(np.asarray(x).astype(t).tobytes() for x, t in parts))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])
            held.clear()
            n_keys = n_entries = 0

        for b in (b.slice(i, 200) for b in it for i in range(0, b.num_rows, 200)):
            h, first = shingles(b.column(0))
            s = set_hashes(h, first)
            fresh = []
            for i, x in enumerate(s.tolist()):
                if x and x not in known:
                    known.add(x)
                    fresh.append(i)
            if len(known) > 2_000_000:
                known.clear()
            keep = np.zeros(len(s), bool)
            keep[fresh] = True
            sizes = np.diff(first)
            h = h[np.repeat(keep, sizes)]
            first = np.concatenate(([0], np.cumsum(sizes[keep])))
            keys, owners, sets, tags, needs = all_keys(h, first, hot)
            if n_entries + len(sets) > 65_000:  # places are 16 bits wide
                yield from flush()
            held.append((keys, owners + n_entries, s[keep][sets], tags, needs))
            n_keys += len(keys)
            n_entries += len(sets)
            if n_keys >= FLUSH_KEYS:
                yield from flush()
        yield from flush()

    return arrow_map(docs.select(F.col("text").cast("string").alias("text")), run, "bucket int, block binary")


def shared_keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """(g, s, tag, need, size): the keys g that two sets or more have, with each of these."""

    def run(it):
        parts: dict[int, list] = {}
        for b in it:
            for bucket, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, k = np.frombuffer(block, "<u4", 2).tolist()
                at, got = 8, []
                for t, size in (("<u8", n), ("<u4", n), ("u1", n), ("<u4", k), ("u1", k), ("<u2", k)):
                    got.append(np.frombuffer(block, t, size, at))
                    at += got[-1].nbytes
                low, high, places = got[3:]
                parts.setdefault(bucket, []).append((*got[:3], high.astype(U64) << U64(32) | low.astype(U64), places))
        for bucket in list(parts):
            blocks_here = parts.pop(bucket)
            ids, needs, tags, keys = (np.concatenate([x[k] for x in blocks_here]) for k in range(4))
            begin = np.cumsum([0] + [len(x[0]) for x in blocks_here])
            entry = np.concatenate([x[4].astype(np.uint32) + np.uint32(i) for x, i in zip(blocks_here, begin)])
            del blocks_here
            order = np.argsort(keys)
            keys, entry = keys[order], entry[order]
            del order
            same = keys[1:] == keys[:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            keys, entry = keys[shared], entry[shared]
            order = np.lexsort((ids[entry], keys))
            keys, entry = keys[order], entry[order]
            sets = ids[entry]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
            keys, sets, entry = keys[new], sets[new], entry[new]
            lead = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
            size = np.diff(np.concatenate((lead, [len(keys)])))
            size = np.repeat(size, size)
            many = size >= 2
            g = mix64(keys[many] ^ mix64(np.array([bucket], U64))).view(np.int64)
            columns = g, np.ascontiguousarray(sets[many]).view(np.int64), tags[entry[many]].astype(np.int32), needs[entry[many]].astype(np.int32), size[many].astype(np.int32)
            for i in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=["g", "s", "tag", "need", "size"])

    return arrow_map(blocks.repartition(buckets, "bucket"), run, "g long, s long, tag int, need int, size int")


def telling_keys(shared: DataFrame) -> DataFrame:
    """(g, s): of each entry with as many shared keys as a linked set needs the rarest ones. Two that share
    `need` keys or more share one that isn't among the need - 1 most frequent keys of either."""
    enough = shared.groupBy("s", "tag").agg(F.count("*").alias("k"), F.max("need").alias("least")).where("k >= least").select("s", "tag")
    shared = shared.join(enough, ["s", "tag"], "left_semi")
    # Once more, counting only the keys that sets left over share.
    lively = shared.groupBy("g").agg(F.count("*").alias("size")).where("size >= 2")
    shared = shared.drop("size").join(lively, "g")
    entry = Window.partitionBy("s", "tag")  # the keys of one set
    ranked = shared.withColumns({"k": F.count("*").over(entry), "rank": F.row_number().over(entry.orderBy(F.col("size").desc(), "g"))})
    return ranked.where("k >= need and rank >= need").select("g", "s")


def bit_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the shingles dealt to bits, as 64-bit words: at least SKETCH_BITS bits and as many as the
    next power of two after twice the set's size. A half XORed onto the other is the sketch of half the width."""
    bits = max(SKETCH_BITS, 2 << len(h).bit_length())
    place = (mix64(h ^ U64(77)) >> U64(32)).astype(np.int64) & bits - 1
    return np.packbits(np.bincount(place, minlength=bits) & 1).view(np.int64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def plausible(m: int, x: np.ndarray, n: int, y: np.ndarray) -> bool:
    """What sizes and sketches say of two sets: the sketches' Hamming distance is at most the symmetric
    difference, and that of linked sets at most a ninth of their sizes' sum."""
    if 4 * max(m, n) > 5 * min(m, n):
        return False
    words = min(len(x), len(y))
    return 9 * int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= m + n


def wanted_table(wanted: DataFrame) -> np.ndarray:
    """A packed table of bits, in which the hashes of wanted ids and of the same with their sets are marked: 64 for each
    wanted row unless that is more than 2**WANTED_BITS."""
    bits = min(WANTED_BITS, max(16, (64 * wanted.count()).bit_length()))

    def mark(it):
        flags = np.zeros(1 << bits, bool)
        for b in it:
            ids, sets = numbers(b.column(0)), numbers(b.column(1))
            flags[table_places(ids, bits)] = True
            flags[table_places(ids ^ mix64(sets), bits)] = True
        if flags.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1) for x in np.split(flags, RANGES)], pa.binary())], names=["part", "flags"])

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(raw), np.uint8)
                sums[part] = sums[part] | x if part in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "flags"])

    schema = "part int, flags binary"
    out = np.zeros((RANGES, (1 << bits) // 8 // RANGES), np.uint8)
    for r in arrow_map(arrow_map(wanted.select("id", "s"), mark, schema).repartition(RANGES, "part"), add, schema).collect():  # 16 MB in all, at most
        out[r["part"]] = np.frombuffer(r["flags"], np.uint8)
    return out.ravel()


def numbers(column) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).view(U64)


def table_places(x: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(x) >> U64(64 - bits)).astype(np.int64)


def is_marked(packed: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether a table of bits has x."""
    place = table_places(x, len(packed).bit_length() + 2)
    return packed[place >> 3] >> (7 - (place & 7)) & 1 == 1


def wanted_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, n, sketch, shingles) of the wanted (id, s), and rarely of another document; each s once, however often its
    rows are repeated."""
    packed = wanted_table(wanted)

    def run(it):
        for b in it:
            b = b.filter(pa.array(is_marked(packed, numbers(b.column(0)))))
            h, first = shingles(b.column(1))
            s = set_hashes(h, first)
            new = np.flatnonzero((s != 0) & is_marked(packed, numbers(b.column(0)) ^ mix64(s)))
            new = new[np.sort(np.unique(s[new], return_index=True)[1])]
            parts = [h[first[i] : first[i + 1]] for i in new]
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)[new]), pa.array([len(x) for x in parts], pa.int64()), pa.array([bit_sketch(x).tobytes() for x in parts], pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["s", "n", "sketch", "shingles"])

    found = arrow_map(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), run, "s long, n long, sketch binary, shingles binary", LOT_BYTES)
    return found.dropDuplicates(["s"])


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that may link, by their sketches."""
    lite = sets.select("s", "n", "sketch")
    both = pairs.join(lite.withColumnsRenamed({"s": "a", "n": "m", "sketch": "x"}), "a").join(lite.withColumnsRenamed({"s": "b", "sketch": "y"}), "b")

    def near(it):
        for b in it:
            words = [[np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(k)] for k in (3, 5)]
            keep = pa.array([plausible(*x) for x in zip(b.column(2).to_pylist(), words[0], b.column(4).to_pylist(), words[1])], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return arrow_map(both.select("a", "b", "m", "x", "n", "y"), near, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, sorted, link."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def across(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components whose sets share a group and link.

    Groups with the same smallest set mostly hold the same sets. They are compared in one place, so that a set travels
    once for all of them and a pair of sets is looked at once. A place with many sets is split into a grid of cells
    of some 2 * CELL_SETS sets and 2 * CELL_SHINGLES shingles. Pairs are verified where they meet, unless a cell's links
    have joined their components already, and a cell returns fewer links than it has sets: pairs never become rows.
    """
    pivots = groups.groupBy("g").agg(F.min("s").alias("p"))
    rows = groups.join(pivots, "g").groupBy("p", "s", "c").agg(F.collect_list("g").alias("gs"))  # the keys of one set
    sized = rows.select("p", "s", "c").join(sets.select("s", "n"), "s")
    parts = sized.groupBy("p").agg(F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum("n") / CELL_SHINGLES)).alias("q"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("p", "q")
    dealt = rows.join(parts, "p").withColumn("r", F.pmod(F.xxhash64("s"), F.col("q"))).withColumn("o", F.explode(F.expr("sequence(0L, q - 1)")))
    cells = dealt.select("p", F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"), "r", "s", "c", "gs").join(sets, "s")
    placed = cells.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").select("p", "i", "j", "r", "s", "c", "n", "sketch", "gs", "shingles")

    def compare(it):
        held: list[pa.RecordBatch] = []

        def cell():
            t = pa.Table.from_batches(held)
            held.clear()
            i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            side, s, c, n = (t.column(k).to_numpy() for k in (3, 4, 5, 6))
            words = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column(7).combine_chunks()]
            lean = np.stack([folded(w, SKETCH_BITS // 64) for w in words])
            gs = t.column(8).combine_chunks()
            member = np.repeat(np.arange(len(s)), gs.value_lengths().to_numpy())
            _, group = np.unique(gs.flatten().to_numpy(), return_inverse=True)
            order = np.argsort(group, kind="stable")
            member, cut = member[order], np.cumsum(np.bincount(group))
            share = np.zeros((len(s), len(s)), bool)
            for x, y in zip(np.concatenate(([0], cut[:-1])), cut):
                share[np.ix_(member[x:y], member[x:y])] = True
            share &= (c[:, None] < c[None, :]) & ((side[:, None] != side[None, :]) | (i == j))
            share &= 4 * np.maximum(n[:, None], n[None, :]) <= 5 * np.minimum(n[:, None], n[None, :])
            out, root = [], c.copy()
            whole = [np.frombuffer(v.as_buffer(), U64) for v in t.column(9).combine_chunks()]
            for x in np.flatnonzero(share.any(1)):
                y = np.flatnonzero(share[x] & (root != root[x]))
                apart = np.bitwise_count(lean[x] ^ lean[y]).sum(1, dtype=np.int64)
                y, apart = (v[9 * apart <= n[x] + n[y]] for v in (y, apart))
                for k in y[np.argsort(apart, kind="stable")]:
                    if root[k] != root[x] and plausible(n[x], words[x], n[k], words[k]) and linked(whole[x], whole[k]):
                        out.append((s[x], s[k]))
                        root[root == root[k]] = root[x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], names=["a", "b"])

        for b in it:
            keys = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), b.num_rows]
            for x, y in zip(edges, edges[1:]):
                if y > x:
                    if held and any(held[-1].column(k)[0].as_py() != keys[x, k] for k in range(3)):
                        yield from cell()
                    held.append(b.slice(x, y - x))
        if held:
            yield from cell()

    return arrow_map(placed, compare, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link, by their whole sets."""

    def run(it):
        for b in it:
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                keep[i] = linked(*(np.frombuffer(b.column(c)[i].as_buffer(), U64) for c in (2, 3)))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    whole = sets.select("s", "shingles")
    # The set of b, which has few pivots, travels to a's.
    right = pairs.join(whole.withColumnsRenamed({"s": "b", "shingles": "y"}), "b")
    return arrow_map(right.join(whole.withColumnsRenamed({"s": "a", "shingles": "x"}), "a").select("a", "b", "x", "y"), run, "a long, b long")


def links_between_sets(docs: DataFrame, read: DataFrame, total: int, rows: int) -> DataFrame | None:
    """Links (a, b) that join all sets of a component, by set hash; None where no sets share keys."""
    hot = hot_cells(read, total, rows)
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, total // 2 // BUCKET_KEYS + 1)
    groups = settled(telling_keys(shared_keys(key_blocks(docs, hot, buckets), buckets)))
    reps = read.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("id"))
    wanted = settled(groups.select("s").distinct().join(reps, "s").where("id is not null"))
    sets = settled(wanted_sets(docs, wanted))
    links = label = None
    for k in range(ROUNDS + 1):
        # Groups whose sets lie in several components still: pairs across those.
        placed = groups.select("g", "s", F.col("s").alias("c")) if label is None else groups.join(label, "s", "left").select("g", "s", F.coalesce("component", "s").alias("c"))
        split = placed.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(F.xxhash64("s", F.lit(k)).alias("h"), F.col("s").alias("p"), F.col("c").alias("pc"))).alias("v")).where("lo <> hi").select("g", "v")
        groups = settled(placed.join(split, "g").select("g", "s", "c", "v"))
        if groups.isEmpty():
            break
        if k < ROUNDS:  # each set and one pivot
            pivots = groups.where("c <> v.pc").groupBy("s").agg(F.min("v").alias("v"))
            found = verify(likely(pivots.select(F.least("s", "v.p").alias("a"), F.greatest("s", "v.p").alias("b")).distinct(), sets), sets)
        else:
            found = across(groups, sets)
        links = settled(found if links is None else links.union(found))
        groups = groups.select("g", "s")
        if k < ROUNDS:
            label = components(links).select(F.col("id").alias("s"), "component")
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs' rows as (doc_id, n_shingles, component_id): the smallest id reachable by links."""
    read = settled(read_sets(docs))
    rows = read.where("cells is null").select("doc_id", "n", "s")
    total, count = rows.agg(F.sum("n"), F.count("*")).first()
    if not total:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    reps = rows.where("n > 0 and doc_id is not null").groupBy("s").agg(F.min("doc_id").alias("rep"))
    links = links_between_sets(docs, read, total, count)
    if links is None:
        links = reps.limit(0).select(F.col("s").alias("a"), F.col("s").alias("b"))
    by = reps.select("s", "rep")
    edges = links.join(by.withColumnsRenamed({"s": "a", "rep": "ra"}), "a").join(by.withColumnsRenamed({"s": "b", "rep": "rb"}), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    placed = rows.join(reps, "s", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    # Rows of one id with several texts join these texts' sets.
    twice = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("k")).where("k > 1 and lo <> hi").select("doc_id", "lo")
    edges = edges.union(placed.join(twice, "doc_id").where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")))
    label = components(edges, "rep")
    return placed.join(label, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component has a smaller id; of rows with equal ids none goes."""
    keep = near_duplicates(docs).where("component_id = doc_id or doc_id is null").select("doc_id").distinct()
    return docs.join(keep, docs.doc_id.eqNullSafe(keep.doc_id), "left_semi")


ORACLE_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) as s from w where len(w) > 0
), n as (select doc_id, count(*) as n from s group by doc_id),
b as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from b join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= 80 * (p.n + q.n - shared)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select documents.doc_id, coalesce(n, 0) as n_shingles, c as component_id from documents left join n using (doc_id) join (select a, min(b) as c from r group by a) on a = documents.doc_id
"""
