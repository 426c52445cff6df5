"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives, in one pass over a word, the longest token that starts at each of
its characters. The encoder takes longest tokens from the left; a token may follow another only if the merges would
leave their border alone (a memoised pair-compatibility test); where none fits it falls back to shorter ones, and a
position from which nothing fits is never tried again. Exactly one sequence passes, that of the merges.

Words are cached by each Python worker, up to a bound. Decoding lays the tokens' strings end to end in one byte table and
gathers the bytes of all tokens of a batch by their offsets.

Nulls: a null text is an empty one (no tokens). Texts are never cut. A null doc_id stays null; repeated rows are encoded
each on their own. Special tokens that stand in a text are recognised, as the library does. An empty table gives an
empty table. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.common import chunks

CACHE_WORDS = 300_000
END = "</w>"
#: The characters that Unicode calls white space, and the contractions and classes of the word pattern.
BLANK = "\t-\r \x85\xa0  -     　"
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d"
BLANKS = re.compile(f"[{BLANK}]+")
WORDS = regex.compile(rf"{PARTS}|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")
#: The same over texts whose letters all lie in ASCII, Latin-1 and Latin Extended; those are nearly all.
LATIN = "a-zß-öø-ɏ"
PLAIN = re.compile(f"[\x00-\x1b\x20-\x7f{LATIN}]*")
PLAIN_WORDS = re.compile(rf"{PARTS}|[{LATIN}]+|[0-9]|[^\t-\r {LATIN}0-9]+")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


class WordBpe:
    """A lower-casing BPE with word ends, read from a tokenizers file of that kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        vocab, merges = t["model"]["vocab"], t["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in t["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.name = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.name[i] = s
        # a word's end is one character, so that every token is a plain substring of the marked word
        marked = {s: s.removesuffix(END) + "\n" if s.endswith(END) and s != END else s for s in vocab}
        self.length = [0] * size
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[int, int] = {}
        for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in merges):
            l, m, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault(l << 20 | m, r)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, l, m
        by_text = {marked[s]: i for s, i in vocab.items()}
        self.shorter, self.find = [-1] * size, ahocorasick.Automaton()
        for s, i in by_text.items():
            self.length[i] = len(s)
            self.find.add_word(s, (i, len(s)))
            self.shorter[i] = next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), -1)
        self.find.make_automaton()
        self.letters = byte_letters()
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        table = [(s + " ").encode() for s in self.name]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in table])))

    def compatible(self, l: int, r: int) -> bool:
        """Whether the merges leave the border between tokens l and r alone.

        Takes back the later of the two tokens' last merges, again and again; the border would be merged over if at
        some point its two neighbours were a pair that comes before the merge just taken back. Equal pairs merge from
        the left, so that a pair over the border comes before an equal one right of it, and after one left of it.
        """
        before = 1 << 30
        while True:
            if self.pair.get(l << 20 | r, before) < before:
                return False
            if self.rank[l] > self.rank[r]:
                before, l = self.rank[l], self.right[l]
            elif self.rank[r] >= 0:
                before, r = self.rank[r] + 1, self.left[r]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        marked = (word if word.isascii() and word.isprintable() else "".join(self.letters[b] for b in word.encode())) + "\n"
        longest = [-1] * len(marked)
        for end, (i, n) in self.find.iter(marked):
            longest[end - n + 1] = i  # ends come in order, so that the longest is set last
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < len(marked):
            if token >= 0:
                end = at + self.length[token]
                if end not in dead:
                    if not out:
                        fits = True
                    elif (fits := self.fits.get(key := out[-1] << 20 | token)) is None:
                        fits = self.fits[key] = self.compatible(out[-1], token)
                    if fits:
                        out.append(token)
                        at = end
                        token = longest[at] if at < len(marked) else -1
                        continue
                token = self.shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 16-bit numbers, and in decimal with a blank before each."""
        ids, said = [], []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                got = [self._held([self.special[part]])]
            else:
                part = BLANKS.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
                words = (PLAIN_WORDS if PLAIN.fullmatch(part) else WORDS).findall(part)
                cache = self.cache
                try:
                    got = [cache[w] for w in words]
                except KeyError:
                    got = [cache[w] if w in cache else self._learn(w) for w in words]
            ids += [x[0] for x in got]
            said += [x[1] for x in got]
        return b"".join(ids), "".join(said)

    @staticmethod
    def _held(ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u2").tobytes(), "".join(f" {i}" for i in ids)

    def _learn(self, word: str) -> tuple[bytes, str]:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        if len(self.fits) >= 4 * CACHE_WORDS:
            self.fits.clear()
        got = self._held(self.encode_word(word))
        if len(word) <= 64:
            self.cache[word] = got
        return got

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by a blank, as the library's decode without a decoder gives them."""
        ids = ids.astype(np.int64)
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.offsets[ids] - ends + size, size) + np.arange(ends[-1])][:-1].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    bpe = WordBpe(path)
    if len(bpe.name) > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    return bpe


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with ids, also the ids themselves.

    path names the vocabulary file, which has to lie at the same place on every executor (an installed package)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in chunks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                raw, said = bpe.encode(text or "")
                got = np.frombuffer(raw, "<u2")
                rows.append((len(got), hashlib.sha256(said[1:].encode()).hexdigest(), hashlib.sha256(bpe.decode(got)).hexdigest(), got))
            n, a, b, held = zip(*rows, strict=True)
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if ids:
                out.append(pa.array([x.astype(np.int32) for x in held], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
