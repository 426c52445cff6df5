"""Token counts: how many pieces a unigram vocabulary cuts a text into, by a Viterbi pass that only counts.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word; the pass carries, for each end, the best score,
the number of pieces of that best path and whether its last piece is unknown. No back-pointers, no pieces. Ties as the
tokenizers library's unigram model breaks them: of paths of equal score that end at one place, the one whose last piece
starts first stays. A character without a piece of its own costs the least score minus 10; it counts as the bytes of its
UTF-8 form if the file has a piece for each byte and `byte_fallback` is set, as op10 does, else neighbouring unknown characters are one piece.

Words are runs of anything but blanks, each marked with U+2581 in front and cut on its own. Nulls: a null text has no
words and no pieces. Repeated rows count each on their own. An empty table gives an empty table. Columns other than
doc_id and text are not read. Texts are never cut.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.common import WORD, chunks

CACHE_WORDS = 1_000_000
UNKNOWN_COST = 10.0
MARK = "▁"


def piece_scores(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file, with the file's scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def has_bytes(path: str) -> bool:
    """Whether the file has pieces for all 256 bytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(m.is_byte(i) for i in range(m.get_piece_size())) == 256


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        self.byte_fallback = byte_fallback
        self.find = ahocorasick.Automaton()
        for p, s in pieces:
            self.find.add_word(p, (len(p), s))
        self.find.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of the marked word."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        pieces, unknown = [0] * (n + 1), [False] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, x in self.find.iter(word):
            found[end].append(x)
        for end, c in enumerate(word):
            top: float | None = None
            for size, s in sorted(found[end], reverse=True) if len(found[end]) > 1 else found[end]:
                start = end + 1 - size
                if (got := s + best[start]) is not None and (top is None or got > top):
                    top, pieces[end + 1] = got, pieces[start] + 1
            if c not in self.single and (top is None or self.unknown + best[end] > top):
                top, unknown[end + 1] = self.unknown + best[end], True
                pieces[end + 1] = pieces[end] + (len(c.encode()) if self.byte_fallback else not unknown[end])
            best[end + 1] = top
        return pieces[n]

    def count_words(self, words: list[str]) -> int:
        cache = self.cache
        try:
            return sum([cache[w] for w in words])
        except KeyError:
            pass
        n = 0
        for w in words:
            if (k := cache.get(w)) is None:
                k = self.count(MARK + w)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                if len(w) <= 64:
                    cache[w] = k
            n += k
        return n


@functools.lru_cache(maxsize=2)
def load(path: str, byte_fallback: bool) -> Counter:
    return Counter(piece_scores(path), byte_fallback and has_bytes(path))


def count_tokens(docs: DataFrame, path: str, byte_fallback: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens for each row; path names a sentencepiece file that lies at the same place everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, words = load(path, byte_fallback), re.compile(WORD)
        for batch in chunks(batches):
            got = [words.findall(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, got), pa.int64()), pa.array(map(counter.count_words, got), pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
