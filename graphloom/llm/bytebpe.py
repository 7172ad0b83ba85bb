"""Byte-level BPE by forced boundaries: exact encoding of whole texts, and decoding.

Splitting. A text is cut before every single space that a non-space character
follows; the vocabulary's pre-tokeniser always cuts there, so a chunk can be encoded
by itself and remembered. Inside a chunk the pre-tokeniser's pattern gives words, and
inside a word every byte pair that occurs in no vocabulary token is a *forced
boundary*: no merge can span it, so the fragments on either side are encoded
independently and their ids concatenated. Fragments and chunks are remembered in
dictionaries of bounded size.

Special tokens written out in a text are matched first, as the tokenizers library does
by default, and the parts around them are encoded as texts of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_bytes

#: The byte-level pre-tokeniser's pattern (a fixed value of these vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a dictionary of chunks or fragments before it starts anew.
CACHE = 600_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers JSON file.

    `encode` gives a text's ids; `chunks` gives the text's encoding as a list of remembered
    values, one for each chunk, made by `value` from the chunk's ids (as for joining
    them without touching single ids).
    """

    def __init__(self, path: str, value: Callable[[list[int]], object] = tuple):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(chars[c] for c in t) for t, i in vocab.items() if all(c in chars for c in t)}
        ids = {t: i for i, t in self.token_bytes.items()}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: t for t, i in self.special.items()}
        self._no_merge = (len(self.merges), 0)
        self.joint = {pair for t in ids for pair in zip(t, t[1:])}  # pairs inside some token
        self._special = regex.compile(b"|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._words = regex.compile(PATTERN).findall
        self._value = value
        self._fragments: dict[bytes, list[int]] = {}
        self._spaced: dict[bytes, object] = {}  # by chunk, of its encoding after a space
        self._plain: dict[bytes, object] = {}  # by chunk, of its encoding at a text's start

    def fragments(self, word: bytes) -> list[bytes]:
        """word cut at its forced boundaries."""
        joint, cut = self.joint, 0
        out = []
        for i, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in joint:
                out.append(word[cut:i])
                cut = i
        out.append(word[cut:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """Repeats the merge of lowest rank, leftmost first."""
        ids = [self.of_byte[b] for b in fragment]
        if len(ids) > 200:
            return self._merge_long(ids)
        get, none = self.merges.get, self._no_merge
        pairs = [get(pair, none) for pair in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) is not none:
            at = pairs.index(best)
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """merge() with a heap over a linked list, for long runs without boundaries."""
        import heapq

        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            rank, i, new, a, b = heapq.heappop(heap)
            if gone[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], gone[j] = new, True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merges.get((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[after[i]]))
            if (p := before[i]) >= 0 and (m := self.merges.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, m[1], ids[p], new))
        return [x for x, g in zip(ids, gone) if not g]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without special tokens."""
        known, out = self._fragments, []
        for word in self._words(chunk):
            for fragment in self.fragments(word.encode()):
                ids = known.get(fragment)
                if ids is None:
                    if len(known) >= CACHE:
                        known.clear()
                    ids = self.merge(fragment)
                    if len(fragment) <= 64:
                        known[fragment] = ids
                out += ids
        return out

    def _part(self, text: bytes) -> list:
        """Values of the chunks of a text without special tokens."""
        if not text:
            return []
        cut = text.split(b" ")
        values = list(map(self._spaced.get, cut))
        values[0] = self._plain.get(cut[0]) if cut[0] else None
        spans: list[list[int]] = []
        k = -1
        try:
            while True:
                k = values.index(None, k + 1)
                if k == 0 or _begins(cut[k]):
                    spans.append([k, k])
                elif spans and spans[-1][1] == k - 1:  # an empty chunk, or one that begins with
                    spans[-1][1] = k  # white space, belongs to the chunk before it
                else:
                    spans.append([k - 1, k])
        except ValueError:
            pass
        late = False
        for i, j in spans:
            chunk = cut[i] if i == j else b" ".join(cut[i : j + 1])
            if not chunk:  # the text begins with a space, which the next chunk has
                late = True
                continue
            known = self._spaced if i else self._plain
            value = known.get(chunk)
            if value is None:
                value = self._value(self.encode_chunk((b" " + chunk if i else chunk).decode("utf-8", "replace")))
                if len(chunk) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[chunk] = value
            values[i] = value
            late = late or i != j
        if not late:
            return values
        for i, j in spans:  # chunks that joined the one before
            values[i + 1 : j + 1] = [None] * (j - i)
        return [v for v in values if v is not None]

    def chunks(self, text: bytes) -> list:
        """The values of a whole text's chunks, in order."""
        if self._special is None or not self._special.search(text):
            return self._part(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._part(text[at : m.start()])
            out.append(self._value([self.special[m[0]]]))
            at = m.end()
        return out + self._part(text[at:])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text as the tokenizers library gives them without special tokens added."""
        own = ByteBPE.__new__(ByteBPE)
        own.__dict__ |= self.__dict__ | {"_value": list, "_spaced": {}, "_plain": {}}
        return [i for ids in own.chunks(text.encode("utf-8", "replace")) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        get = self.token_bytes.get
        return b"".join(get(i, b"") for i in ids).decode("utf-8", "replace")


_SPACE = regex.compile(r"\s")


def _begins(chunk: bytes) -> bool:
    """The chunk begins with something else than white space."""
    if not chunk:
        return False
    if chunk[0] < 0x80:
        return chunk[0] not in b"\t\n\x0b\x0c\r "
    return not _SPACE.match(chunk[:4].decode("utf-8", "ignore"))


@lru_cache(maxsize=2)
def _digest_encoder(path: str) -> ByteBPE:
    """Remembers each chunk's ids as decimal text."""
    return ByteBPE(path, lambda ids: ",".join(map(str, ids)).encode())


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs' rows as (doc_id, n_tokens, ids_sha256, decoded_sha256): the whole text encoded, and decoded again.

    Cases: a null text is an empty one, with no ids; an empty table gives no rows; repeated
    rows are encoded as often as they occur; other columns are ignored.
    """

    def run(it):
        encoder = _digest_encoder(path)
        token = encoder.token_bytes


        class Decoded(dict):
            def __missing__(self, ids: bytes) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                out = self[ids] = b"".join(token[int(i)] for i in ids.split(b","))
                return out

        decoded = Decoded()
        for b in it:
            n, coded, back = [], [], []
            for text in text_bytes(b.column(1)):
                chunks = encoder.chunks(text)
                ids = b",".join(chunks)
                n.append(ids.count(b",") + 1 if ids else 0)
                coded.append(sha256(ids).hexdigest())
                raw = b"".join([decoded[c] for c in chunks])
                back.append(sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
