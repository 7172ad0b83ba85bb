"""Removal of substrings that stand in an earlier document, by suffixes sorted with hashes: exact.

A string is `length` bytes of a text's UTF-8. Equal strings must meet in one task without every suffix travelling, so
each is dealt by its anchor: the least hash among its grams (shorter strings), leftmost of equals. Neighbouring strings
mostly share their anchor; such a run is one segment, some 65 bytes for 16 strings.

1. Anchors' hashes and documents: an anchor that no two documents hold can't hold a repeat. The others are marked in a
   table of bits, whose size is bounded; where it lets others pass, only more travels.
2. Places of marked anchors' segments are stored once, without bytes. Equal segments share a name: the 64-bit hashes of
   anchor and segment. 22 bits of a third hash, the segment's length and its anchor's place must agree within a name, or
   else all hashes are drawn anew. Of each name the smallest document is found.
3. Anchors that stand in several different segments are marked in a second table. Their segments' bytes meet in a task,
   equal ones once. Their strings' suffixes are sorted by mergesort in which two suffixes are compared by their
   common extension, found by binary search over prefix polynomial hashes. The sorted sequence is then verified byte by
   byte; if hashes misled it, it is sorted by bytes. In each run of equal strings the smallest document keeps its string.
   An anchor's segments beyond GROUP are dealt to several tasks; each settles its own, and what remains open of a string
   (one row a task and string) is settled by minima of all.
4. A segment's verdict goes to all its places, places to their documents.

Cases: a null or empty text has no bytes; a null doc_id isn't smaller than any and has no smaller one: its text stays
whole and removes nothing; rows with equal ids don't remove each other's strings; texts shorter than `length` stay;
a table without rows gives none; other columns are ignored. What is kept are bytes, as a cut may fall within a character.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, arrow_map, hash_words, mix64, scratch_uri

LENGTH = 50
#: Strings that may share an anchor: the most that a mask of bits holds with room.
WINDOW = 31
#: Bits of the table of shared anchors for each of them, and at most 2**TABLE_BITS (64 MB).
BITS_EACH, TABLE_BITS, RANGES = 16, 29, 64
#: Segments of one anchor that one task takes, and segments that are sorted at once.
GROUP, BLOCK = 4096, 4096
#: Bytes whose grams are hashed at once; places within take 16 bits.
STEP = 1 << 15
#: Entries of a task's memory of anchors that it has reported twice.
REMEMBERED = 1 << 18
_P = 0x9E3779B97F4A7C15


def gram_of(length: int) -> int:
    return max(length - WINDOW + 1, (length + 1) // 2)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another as bytes, and where each begins (one more entry than texts)."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw else np.empty(0, np.uint8)), at - at[0]


def gram_hashes(data: np.ndarray, gram: int, seed: int) -> np.ndarray:
    """A mixed polynomial hash of each gram, put together from those of powers of two."""
    part = mix64(np.arange(1, 257, dtype=U64) + U64(1000 * seed))[data]
    whole, done, size = None, 0, 1
    while True:
        if gram & size:
            tail = part[done:] if done else part
            whole = tail if whole is None else whole[: len(tail)] * U64(pow(_P, size, 1 << 64)) + tail[: len(whole)]
            done += size
        if size * 2 > gram:
            return mix64(whole)
        part = part[:-size] * U64(pow(_P, size, 1 << 64)) + part[size:]
        size *= 2


def anchors(data: np.ndarray, at: np.ndarray, length: int, seed: int = 0):
    """Runs of strings with one anchor: text, place of the first string, number of strings, place of the anchor, hash."""
    gram = gram_of(length)
    window, out = length - gram + 1, []
    for c in range(0, max(len(data) - length + 1, 0), STEP):
        piece = data[c : c + STEP + length - 1]
        h = gram_hashes(piece, gram, seed)
        least = h & ~U64(0xFFFF) | np.arange(len(h), dtype=U64)
        size = 1
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: size - window], least[window - size :])
        place = (least & U64(0xFFFF)).astype(np.int64)
        # Strings that would cross into the next text: starts from bound - length + 1 to bound - 1.
        bounds = at[np.searchsorted(at, c, "right") : np.searchsorted(at, c + len(place) + length, "left")] - c
        cut = np.zeros(len(place) + 1, np.int64)
        np.add.at(cut, np.clip(bounds - length + 1, 0, len(place)), 1)
        np.add.at(cut, np.clip(bounds, 0, len(place)), -1)
        valid = np.cumsum(cut[:-1]) == 0
        first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]))))
        n = np.diff(np.concatenate((first, [len(place)])))
        n, first = n[valid[first]], first[valid[first]]
        out.append((first + c, n, place[first] + c, h[place[first]]))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    start, n, anchor, h = (np.concatenate(x) for x in zip(*out))
    return np.searchsorted(at, start, "right") - 1, start, n, anchor, mix64(h)  # as least ones they are small


def held_anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(h, d): anchors' hashes and the documents that hold them; of those in one lot the smallest and the largest, and
    none of an anchor that the task has reported in two documents."""

    def run(it):
        known = np.zeros(REMEMBERED, U64)
        for b in it:
            text, _, _, _, h = anchors(*texts_of(b.column(1)), length, seed)
            d = b.column(0).to_numpy()[text]
            new = known[h >> U64(46)] != h
            h, d = h[new], d[new]
            if not len(h):
                continue
            order = np.argsort(h)
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            h, low, high = h[first], np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
            two = low < high
            known[h[two] >> U64(46)] = h[two]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((h, h[two])).view(np.int64)), pa.array(np.concatenate((low, high[two])))], names=["h", "d"])

    return arrow_map(docs.select("d", "text"), run, "h long, d long")


def marked(anchors_: DataFrame) -> np.ndarray:
    """A table of bits of the hashes h, packed."""
    bits = min(TABLE_BITS, max(16, (BITS_EACH * anchors_.count()).bit_length()))
    size = (1 << bits) // RANGES

    def mark(it):
        tables: dict[int, np.ndarray] = {}
        for b in it:
            place = (b.column(0).to_numpy().view(U64) >> U64(64 - bits)).astype(np.int64)
            for r in np.unique(place // size).tolist():
                tables.setdefault(r, np.zeros(size, bool))[place[place // size == r] % size] = True
        if tables:
            yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([np.packbits(x).tobytes() for x in tables.values()], pa.binary())], names=["range", "bits"])

    dealt = anchors_.select("h").repartition(RANGES, F.shiftrightunsigned("h", 64 - (RANGES - 1).bit_length()))
    out = np.zeros((RANGES, size // 8), np.uint8)
    for r in arrow_map(dealt, mark, "range int, bits binary").collect():  # 64 MB in all, at most
        out[r["range"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


#: The name of a segment says nothing of these: its strings' number, its anchor's place, and bits of a third hash.
COUNT_BITS = PLACE_BITS = 5
OTHER = np.random.default_rng(3).permutation(256).astype(np.uint8)


def named(column: pa.Array, table: np.ndarray, length: int, seed: int):
    """The segments of marked anchors in texts: bytes of all texts and where these begin, and of each segment its text,
    start, number of strings, h, s and v."""
    data, bounds = texts_of(column)
    text, start, n, anchor, h = anchors(data, bounds, length, seed)
    place = (h >> U64(64 - (len(table) * 8).bit_length() + 1)).astype(np.int64)
    keep = table[place >> 3] >> (7 - (place & 7)) & 1 == 1
    text, start, n, anchor, h = text[keep], start[keep], n[keep], anchor[keep], h[keep]
    lead, end = anchor - start, start + n + length - 1
    s = mix64(hash_words(data, start, end) ^ mix64(lead.astype(U64) + U64(64 * seed)))
    third = hash_words(OTHER[data], start, end) >> U64(32 + COUNT_BITS + PLACE_BITS)
    v = (third.astype(np.int64) << PLACE_BITS | lead) << COUNT_BITS | n
    return data, bounds, text, start, n, h, s, v.astype(np.int32)


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after another, and where each begins."""
    at = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(start - at[:-1], size) + np.arange(at[-1])], at


def places_of(docs: DataFrame, table: np.ndarray, length: int, seed: int) -> DataFrame:
    """(h, s, v, d, u, at): the segments (h, s) at byte `at` of text u of document d."""

    def run(it):
        for b in it:
            _, bounds, text, start, _, h, s, v = named(b.column(2), table, length, seed)
            here = pa.array((start - bounds[text]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(v), b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), here], names=["h", "s", "v", "d", "u", "at"])

    return arrow_map(docs.select("d", "u", "text"), run, "h long, s long, v int, d long, u long, at int")


def segments(docs: DataFrame, table: np.ndarray, length: int, seed: int) -> DataFrame:
    """(h, s, lead, m, bytes): segments of marked anchors, of a lot's equal ones one, with the smallest document."""

    def run(it):
        for b in it:
            data, _, text, start, n, h, s, v = named(b.column(1), table, length, seed)
            if not len(h):
                continue
            d = b.column(0).to_numpy()[text]
            order = np.lexsort((s, h))
            new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (s[order][1:] != s[order][:-1])))
            least = np.minimum.reduceat(d[order], np.flatnonzero(new))
            one, group = order[new], np.cumsum(new) - 1
            other, of = order[~new], one[group[~new]]  # whose names are verified
            misled = v[other] != v[of]
            same = np.flatnonzero(~misled)
            size = n[other[same]] + length - 1
            x, at = gathered(data, start[other[same]], size)
            y, _ = gathered(data, start[of[same]], size)
            if len(same):
                misled[same] = np.logical_or.reduceat(x != y, at[:-1])
            one, least = np.concatenate((one, other[misled])), np.concatenate((least, d[other[misled]]))
            x, at = gathered(data, start[one], n[one] + length - 1)
            raw = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
            lead = (v[one] >> COUNT_BITS & (1 << PLACE_BITS) - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(s[one].view(np.int64)), pa.array(lead), pa.array(least), raw], names=["h", "s", "lead", "m", "bytes"])

    return arrow_map(docs.select("d", "text"), run, "h long, s long, lead int, m long, bytes binary")


class Suffixes:
    """Suffixes of `data`, compared by their first `length` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        power = np.full(len(data) + 1, _P, U64)
        power[0] = 1
        np.cumprod(power, out=power)
        back = np.full(len(data) + 1, pow(_P, -1, 1 << 64), U64)
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(mix64(data.astype(U64) + U64(1)) * power[:-1], out=self.sums[1:])

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes from i and from j agree, by their prefixes' hashes."""
        common, step = np.zeros(len(i), np.int64), 1 << (self.length.bit_length() - 1)
        down_i, down_j, sum_i, sum_j = self.back[i], self.back[j], self.sums[i], self.sums[j]
        while step:
            size = common + step
            fits = size <= self.length
            k = np.where(fits, size, 0)
            same = fits & ((self.sums[i + k] - sum_i) * down_i == (self.sums[j + k] - sum_j) * down_j)
            common = np.where(same, size, common)
            step //= 2
        return common

    def before(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix i stands before j; equal ones do where ties says so."""
        k = self.extension(i, j)
        equal = k == self.length
        k = np.where(equal, 0, k)
        return np.where(equal, ties, self.data[i + k] < self.data[j + k])

    def merge_sorted(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of suffixes within their groups, of which each stands together: runs of doubling width are merged,
        each suffix finding its place in the other run by binary search; all runs of all groups at once."""
        new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((new, [len(at)])))
        begin, end = np.repeat(new, size), np.repeat(new + size, size)
        order, width, here = np.arange(len(at)), 1, np.arange(len(at))
        while width < size.max(initial=0):
            run = (here - begin) // width
            low = np.minimum(begin + (run ^ 1) * width, end)
            high = np.minimum(low + width, end)
            left, lo, hi = run % 2 == 0, low.copy(), high
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                goes = self.before(at[order[mid]], at[order[open_]], ~left[open_])
                lo[open_] = np.where(goes, mid + 1, lo[open_])
                hi[open_] = np.where(goes, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            place = begin + (run & ~1) * width + (here - begin - run * width) + (lo - low)
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, width * 2
        return order

    def verified(self, at: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray | None:
        """Which suffixes of the sequence equal the one before, byte by byte; None where it isn't sorted."""
        equal = np.zeros(len(at), bool)
        for k in range(1, len(at), 1 << 14):
            here = np.arange(k, min(k + (1 << 14), len(at)))
            here = here[group[order[here]] == group[order[here - 1]]]
            x, y = (self.data[at[order[t]][:, None] + np.arange(self.length)] for t in (here - 1, here))
            first = (x != y).argmax(1)
            a, b = x[np.arange(len(x)), first], y[np.arange(len(y)), first]
            if (a > b).any():
                return None
            equal[here] = a == b
        return equal

    def sorted_runs(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes, and which of that sequence equal the one before."""
        order = self.merge_sorted(at, group)
        equal = self.verified(at, group, order)
        if equal is None:
            order = np.array(sorted(range(len(at)), key=lambda t: (group[t], self.data[at[t] : at[t] + self.length].tobytes())), np.int64)
            equal = self.verified(at, group, order)
        return order, equal


def blocks(it):
    """Rows in whole groups (columns h, sub), of BLOCK rows or more."""
    held: list[pa.RecordBatch] = []
    for b in it:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK:
            t = pa.Table.from_batches(held).combine_chunks()
            h, sub = t.column(0).to_numpy(), t.column(1).to_numpy()
            edge = np.flatnonzero((h[1:] != h[:-1]) | (sub[1:] != sub[:-1])) + 1
            cut = int(edge[-1]) if len(edge) else 0
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def settle(groups: DataFrame, length: int) -> DataFrame:
    """From sorted groups of distinct segments (h, sub, s, lead, bytes, m, parts) rows of three kinds: 0, a segment
    and a mask of its strings that a smaller document of the group holds, if any; 1, a string that is open
    in a group of several parts; 2, a name of different segments."""
    names = "kind", "h", "s", "m", "mask", "lead", "string"

    def rows(kind, h, s, m, mask, lead, string):
        n = len(h)
        columns = [pa.array([kind] * n, pa.int32()), *(pa.array(c, pa.int64()) for c in (h, s, m, mask)), pa.array(lead, pa.int32()), string if string is not None else pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=list(names))

    def run(it):
        for t in blocks(it):
            h, sub, s, lead, m, parts = (t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 5, 6))
            if not len(h):
                continue
            raw = t.column(4).combine_chunks()
            raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
            size = np.array([len(x.as_buffer()) for x in raw], np.int64)
            data, base = np.frombuffer(b"".join(raw.to_pylist()), np.uint8), np.concatenate(([0], np.cumsum(size)))
            group = np.cumsum(np.concatenate(([False], (h[1:] != h[:-1]) | (sub[1:] != sub[:-1]))))
            names_ = np.lexsort((s, group))
            twice = (group[names_][1:] == group[names_][:-1]) & (s[names_][1:] == s[names_][:-1])
            if twice.any():
                x = names_[1:][twice]
                yield rows(2, h[x], s[x], m[x], m[x] * 0, lead[x], None)
            n = size - length + 1
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at, offset = base[of] + k, k - lead[of] + length
            key = group[of] * (2 * length) + offset
            order = np.argsort(key, kind="stable")
            order = order[np.concatenate((key[order][1:] == key[order][:-1], [False])) | np.concatenate(([False], key[order][1:] == key[order][:-1]))] if len(order) > 1 else order[:0]
            lost = np.zeros(len(of), bool)
            if len(order):
                place, equal = Suffixes(data, length).sorted_runs(at[order], key[order])
                place = order[place]
                first = np.flatnonzero(~equal)
                least = np.repeat(np.minimum.reduceat(m[of[place]], first), np.diff(np.concatenate((first, [len(place)]))))
                lost[place] = least < m[of[place]]
            mask = np.zeros(len(n), np.int64)
            np.bitwise_or.at(mask, of[lost], np.int64(1) << k[lost])
            some = np.flatnonzero(mask)
            yield rows(0, h[some], s[some], m[some], mask[some], lead[some], None)
            free = np.flatnonzero(~lost & (parts[of] > 1))
            for i in range(0, len(free), 20_000):
                w = free[i : i + 20_000]
                strings = pa.array([data[a : a + length].tobytes() for a in at[w].tolist()], pa.binary())
                yield rows(1, h[of[w]], s[of[w]], m[of[w]], np.int64(1) << k[w], offset[w], strings)

    return arrow_map(groups, run, "kind int, h long, s long, m long, mask long, lead int, string binary")


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Spark removes each job's shuffle files when the job has ended: what it made is a table by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch(df: DataFrame, name: str) -> DataFrame:
    uri = scratch_uri(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.parquet(uri)


def removed(docs: DataFrame, length: int = LENGTH, seed: int = 0) -> DataFrame:
    """(d, u, runs): the removed strings of the texts u (hashes) of documents d, as (at, mask): the string at byte at + k
    goes where bit k is set. docs: (d, u, text), no nulls."""
    held = held_anchors(docs, length, seed).repartition("h").groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    places = scratch(places_of(docs, marked(scratch(held.where("lo < hi").select("h"), "shared-anchors")), length, seed), "places")
    of_name = places.groupBy("h", "s").agg(F.min("d").alias("m"), F.max("d").alias("last"), F.min("v").alias("v"), F.max("v").alias("w"))
    names = scratch(of_name.select("h", "s", "v", "m", (F.col("m") < F.col("last")).alias("repeats"), (F.col("v") < F.col("w")).alias("clash")), "names")
    several = scratch(names.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors-of-several")
    large = scratch(several.where(F.col("n") > GROUP).select("h", F.ceil(F.col("n") / GROUP).alias("parts")), "large-anchors")
    dealt = segments(docs, marked(several), length, seed).join(large, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("sub", F.pmod("s", "parts").cast("int"))
    once = dealt.repartition("h", "sub").groupBy("h", "sub", "s", "lead", "bytes").agg(F.min("m").alias("m"), F.min("parts").alias("parts"))
    found = scratch(settle(once.sortWithinPartitions("h", "sub"), length), "settled-segments")
    if not names.where("clash").isEmpty() or not found.where("kind = 2").isEmpty():
        return removed(docs, length, seed + 1)
    masks = found.where("kind = 0 and mask <> 0").select("h", "s", "mask")
    if not large.isEmpty():
        free = found.where("kind = 1").select("h", F.col("lead").alias("offset"), "string", "s", "m", "mask")
        least = free.groupBy("h", "offset", "string").agg(F.min("m").alias("least"))
        masks = masks.union(free.join(least, ["h", "offset", "string"]).where("least < m").select("h", "s", "mask")).groupBy("h", "s").agg(F.expr("bit_or(mask)").alias("mask"))
    known = names.join(masks, ["h", "s"], "left").where("repeats or mask is not null").select("s", "v", "m", "mask")
    all_ = F.expr(f"shiftleft(1L, v & {(1 << COUNT_BITS) - 1}) - 1")
    gone = places.drop("h").join(known, ["s", "v"]).withColumn("mask", F.when(F.col("d") > F.col("m"), all_).otherwise(F.coalesce("mask", F.lit(0)))).where("mask <> 0")
    return scratch(gone.select("d", "u", "at", "mask").groupBy("d", "u").agg(F.collect_list(F.struct("at", "mask")).alias("runs")), "removed-strings")


def drop_repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs' rows (doc_id, text) as (doc_id, n_bytes, n_removed, spans, kept): the removed runs of bytes, as wide as they go
    and in order, and the bytes that remain."""
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).withColumn("u", F.xxhash64("text"))
    runs = removed(rows.where(F.col("d").isNotNull() & (F.octet_length("text") >= length)), length)
    both = rows.join(runs, ["d", "u"], "left").select("d", "text", "runs.at", "runs.mask")

    def run(it):
        for b in it:
            data, bounds = texts_of(b.column(1))
            count = b.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, mask = (b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            begin, change = np.repeat(bounds[:-1], count) + at, np.zeros(len(data) + 1, np.int32)
            for k in range(int(mask.max(initial=0)).bit_length()):
                some = begin[mask >> k & 1 == 1] + k
                np.add.at(change, some, 1)
                np.add.at(change, some + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.zeros(len(data) + 1, bool)  # where a run begins: a text's first byte begins one too
            edge[:-1] = gone
            edge[1:-1] &= ~gone[:-1]
            inner = bounds[:-1][np.diff(bounds) > 0]
            edge[inner] = gone[inner]
            last = np.zeros(len(data) + 1, bool)
            last[1:] = gone
            last[1:-1] &= ~gone[1:]
            tail = bounds[1:][np.diff(bounds) > 0]
            last[tail] = gone[tail - 1]
            start, end = np.flatnonzero(edge), np.flatnonzero(last)
            owner = np.searchsorted(bounds, start, "right") - 1
            offsets = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            shift = bounds[owner]
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start - shift), pa.array(end - shift)], names=["start", "end"]))
            total = np.concatenate(([0], np.cumsum(gone)))[bounds]
            kept = [data[i:j][~gone[i:j]].tobytes() for i, j in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), pa.array(np.diff(total)), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return arrow_map(both, run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


ORACLE_SQL = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
s as (select doc_id, unnest(range(0, n - 49)) as i, x from t where n >= 50),
w as (select doc_id, i, substr(x, 2 * i + 1, 100) as w from s),
f as (select w, min(doc_id) as first from w group by w),
g as (select doc_id, i from w join f using (w) where first < doc_id),
r as (select doc_id, i, max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before from g),
b as (select doc_id, i, sum(case when before is null or before + 50 < i then 1 else 0 end) over (partition by doc_id order by i) as k from r),
p as (select doc_id, k, min(i) as lo, max(i) + 50 as hi from b group by doc_id, k),
q as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by k), 0) as prev from p),
c as (select q.doc_id, count(*) as n_spans, sum(hi - lo) as n_removed, string_agg(substr(x, 2 * prev + 1, 2 * (lo - prev)), '' order by lo) as head, max(hi) as last from q join t using (doc_id) group by q.doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256 from t left join c using (doc_id)
"""
