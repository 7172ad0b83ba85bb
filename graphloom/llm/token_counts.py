"""Count-only Viterbi segmentation by a unigram vocabulary.

Per text only the number of pieces is wanted, so no lattice and no ids are kept. An
Aho-Corasick automaton over the vocabulary yields every piece that ends at each
character in turn; dynamic programming carries two numbers per position, the best score and
the pieces on that path, and keeps them for as many positions as a piece may be long. Ties go as in the unigram tokenizer: candidates at an end
position are taken in order of their start, and only a strictly better score replaces
one, so the longest of equals stays. A character that no piece of its own covers costs
the vocabulary's lowest score less 10; neighbouring unknowns fuse, and with byte pieces
they count one piece for each byte, else one.

Spaces become the vocabulary's space mark, which also leads the text. Where no piece
has a character right before the mark, a text may be cut before it: scores add, so the
words on either side are counted by themselves and remembered.

Cases: null and empty texts have no pieces; an empty table gives no rows; repeated rows
are counted as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers before it starts anew.
CACHE = 800_000
#: Places that are let go of at once.
KEPT = 4096


class UnigramCounter:
    """Piece counts by a vocabulary of (piece, score); `byte_pieces` says that unknown characters
    fall back to bytes."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_pieces: bool, lowest: float | None = None):
        import ahocorasick

        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                scores.setdefault(piece, score)
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.empty, self.longest = not scores, max(map(len, scores), default=1)
        self.unknown = (min(scores.values(), default=0.0) if lowest is None else lowest) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        pairs = [p for p in scores if any(b == MARK and a != MARK for a, b in zip(p, p[1:]))]
        self.cuts = not pairs and (MARK in scores or byte_pieces)  # a text may be cut before the mark
        self._counts: dict[str, int] = {}

    def count_marked(self, text: str) -> int:
        """Pieces of a text in which spaces are marks already."""
        lowest = float("-inf")
        # Of the places before `base`, which no piece reaches back to, nothing is kept.
        best, pieces, unknown, base = [0.0], [0], [False], 0
        found = iter(()) if self.empty else self.automaton.iter(text)
        last, match = next(found, (-1, None))
        for end in range(1, len(text) + 1):
            score, count, fused_here, single = lowest, 0, False, False
            here = end - base
            if last + 1 == end:
                matches = []
                while last + 1 == end:
                    matches.append(match)
                    last, match = next(found, (-1, None))
                if len(matches) > 1:
                    matches.sort(reverse=True)  # the longest, so the earliest start, first
                for length, worth in matches:
                    total = best[here - length] + worth
                    single |= length == 1
                    if total > score:
                        score, count = total, pieces[here - length] + 1
            if not single and (total := best[here - 1] + self.unknown) > score:
                fused = not self.byte_pieces and unknown[here - 1]
                add = len(text[end - 1].encode("utf-8", "replace")) if self.byte_pieces else 0 if fused else 1
                score, count, fused_here = total, pieces[here - 1] + add, True
            best.append(score)
            pieces.append(count)
            unknown.append(fused_here)
            if here >= KEPT + self.longest:
                del best[:KEPT], pieces[:KEPT], unknown[:KEPT]
                base += KEPT
        return pieces[-1]

    def count(self, text: str | None) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        if not self.cuts:
            return self.count_marked(MARK + text.replace(" ", MARK))
        words = text.replace(MARK, " ").split(" ")
        counts = list(map(self._counts.get, words))
        total, k = 0, -1
        try:
            while True:
                k = counts.index(None, k + 1)
                counts[k] = 0
                if words[k] or k + 1 == len(words):
                    counts[k] = self._remember(words[k]) if not k or words[k - 1] else 0
        except ValueError:
            pass
        if "" in words:  # runs of marks: a word takes the empty ones before it
            run = 0
            for k, word in enumerate(words):
                if word or k + 1 == len(words):
                    if run:
                        counts[k] = self.count_marked(MARK * (run + 1) + word)
                    elif not word:
                        counts[k] = self.count_marked(MARK)
                    run = 0
                else:
                    counts[k] = 0
                    run += 1
        total = sum(counts)
        return total

    def _remember(self, word: str) -> int:
        n = self.count_marked(MARK + word)
        if word and len(word) <= 64:
            if len(self._counts) >= CACHE:
                self._counts.clear()
            self._counts[word] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """A counter over the pieces and scores of the sentencepiece model file at path."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in normal], any(map(model.is_byte, ids)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs' rows as (doc_id, n_chars, n_tokens): characters and pieces of the whole text."""

    def count(it):
        import pyarrow as pa

        count = counter(path).count
        for b in it:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(map(count, texts), pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), count, "doc_id long, n_chars long, n_tokens long")
