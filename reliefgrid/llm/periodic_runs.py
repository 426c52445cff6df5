"""Periodic run detection: where the words of a text repeat with a period, found by counting equal words at every lag.

A run is a longest stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q) words.

1. For each lag q the places i with word i = word i + q are counted: words that occur often by the exact autocorrelation of
   their 0/1 rows (FFT, rounded to whole numbers), all others by the differences of their places.
2. Within a run, places that match at lag q are neighbours: max(LEAST - q, (TIMES - 1) * q) of them at least. Lags with fewer
   matches hold no run. Matches that a run with a period dividing q has made itself don't count: two stretches, of which
   one's period divides the other's, overlap in fewer words than the longer period, or one of them has no period of its own.
3. Lags that are left get a scan for islands of matches, at steps of a third of the least island first, in full only where
   neighbouring steps match. An island is a run unless a smaller period, which divides the lag, holds all over it.

Work for n words is about n log n for a text of prose, and n to the power 1.5 (log n under the root) at most for the counts.

Nulls: a null text has no words: no runs, the digests of the empty text. A row without a doc_id is not edited by
`edited_words`. Rows that repeat a doc_id are rows of their own. Ties between runs: the greatest exact length / period, then
the smallest start, then period. An empty table gives an empty table. Other columns are not read. Texts are never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.common import chunks

LEAST, TIMES = 24, 3
#: Numbers that a numpy pass holds at once, about.
PASS = 1 << 21
#: The square root of twice the FFT steps that take the time of one pair of places.
HEAVY = 8


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word, in the words' order."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """matches[q]: how many places i have ids[i] = ids[i + q], exact for each lag q of 0..most."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    times = np.bincount(ids)
    matches = np.zeros(most + 1, np.int64)
    size = 1 << int(n + most).bit_length()
    # a word that occurs so often has more pairs than its FFT has steps that cost as much
    heavy = np.flatnonzero(times > np.sqrt(size * np.log2(size)) / HEAVY)
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        at_once = max(1, PASS // size)
        for k in range(0, len(heavy), at_once):
            rows = np.zeros((min(at_once, len(heavy) - k), size))
            for row, w in zip(rows, heavy[k : k + at_once], strict=True):
                row[:n] = ids == w
            f = np.fft.rfft(rows)
            power += (f.real**2 + f.imag**2).sum(0)
        matches += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = np.ones(len(times), bool)
    light[heavy] = False
    at = order[light[ids[order]]]
    of = ids[at]
    # the k-th next place of the same word, for k = 1, 2, ... while there is one within the lag
    live = np.arange(len(at))
    k = 0
    while len(live):
        k += 1
        live = live[live + k < len(at)]
        live = live[of[live + k] == of[live]]
        lag = at[live + k] - at[live]
        near = lag <= most
        live = live[near]
        if len(live):
            matches += np.bincount(lag[near], minlength=most + 1)
    return matches


def least_island(q):
    """The least number of neighbouring matches at lag q within a run."""
    return np.maximum(LEAST - q, (TIMES - 1) * q)


def _islands(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Longest stretches [a, b) of at least `least` places that match at lag q."""
    n = len(ids) - q
    step = max(1, least // 3)
    at = np.arange(0, n, step)
    need = least // step  # so many steps lie in an island at least
    hit = np.flatnonzero(ids[at] == ids[at + q])
    if len(hit) < need:
        return []
    cut = np.flatnonzero(np.diff(hit) > 1) + 1
    out = []
    for a, b in zip(np.append(0, cut), np.append(cut, len(hit)), strict=True):
        if b - a < need:
            continue
        lo, hi = max(0, hit[a] * step - step + 1), min(n, (hit[b - 1] + 1) * step)
        same = np.zeros(hi - lo + 2, np.int8)
        same[1:-1] = ids[lo:hi] == ids[lo + q : hi + q]
        turn = np.flatnonzero(np.diff(same))
        out += [(int(lo + x), int(lo + y)) for x, y in zip(turn[::2], turn[1::2], strict=True) if y - x >= least]
    return out


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(ids)
    most = n // TIMES
    if n < LEAST:
        return []
    lags = np.arange(most + 1)
    least = least_island(lags)
    left = lag_matches(ids, most)
    out: list[tuple[int, int, int]] = []
    for q in np.flatnonzero(left >= least).tolist():
        if q == 0 or left[q] < least[q]:
            continue
        for a, b in _islands(ids, q, int(least[q])):
            end = b + q
            if any(np.array_equal(ids[a : end - q // p], ids[a + q // p : end]) for p in _primes(q)):
                continue
            out.append((a, end - a, q))
            times = np.arange(2 * q, min(most, end - a - 1) + 1, q)
            left[times] -= end - a - times
    return sorted(out, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def keep_mask(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def edited_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract's planted repeats: of documents chosen by the checksum of doc_id, the tail from a place on is
    replaced by repeats of its own first words."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return (words[:a] + piece * -(-(n - a) // p))[:n]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_STRUCT = "struct<start: long, length: long, period: long>"


def detect_runs(docs: DataFrame, edit: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), best (of these, or null), collapsed (the words that
    stay, joined by one space) for each row. edit(words, doc_id) may change the words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
        for batch in chunks(batches):
            sizes, found, best, kept = [], [], [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (t or "").encode().split()  # of bytes: at the six blanks alone
                if edit is not None:
                    words = edit(words, i)
                runs = find_runs(word_ids(words)) if len(words) >= LEAST else []
                sizes.append(len(words))
                found.append([named(r) for r in runs])
                best.append(named(best_run(runs)))
                if runs:
                    words = [words[k] for k in np.flatnonzero(keep_mask(len(words), runs)).tolist()]
                kept.append(b" ".join(words).decode())
            columns = [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "runs", "best", "collapsed"])

    schema = f"doc_id long, n_words long, runs array<{_STRUCT}>, best {_STRUCT}, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def digest_runs(docs: DataFrame) -> DataFrame:
    """The contract's row for each document: n_runs, the best run, digests of all runs and of what is left."""
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return detect_runs(docs, edited_words).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
