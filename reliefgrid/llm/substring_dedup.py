"""Substring dedup: windows of words that occur earlier, found by a compressed FM-index on each shard.

1. Seeds. Of each window of WINDOW words the run of SEED words with the least hash is its seed; equal windows have equal
   seeds. Neighbouring windows with one seed are a segment. Seeds are dealt by hash and counted; segments whose seed
   occurs once hold no window that repeats. This leaves a small part of the text and loses no repeat.
   A seed that stands several times in a chunk of text repeats for sure; its shard hears of it once a chunk.
2. Shards. The words of the remaining segments go to the shard of their seed, so that all kinds of a window meet in one
   shard. Of equal segments of a chunk only the first goes there, for the others are later occurrences in full: however
   common a passage is, its shard gets it once a chunk (CHUNK_BYTES).
3. Each shard concatenates its distinct segments, sorts their suffixes as deep as a window, and keeps the Burrows-Wheeler
   transform as a wavelet matrix of packed bits with rank counts. Every segment is then streamed against the index:
   backward search, one word at a time and all windows side by side, gives the suffix interval that matches a window in
   full (matching statistics that reach WINDOW), and the least place in the interval is the window's first occurrence.
4. All later occurrences are reported as intervals of words, and these are taken out of the documents.

Words are told apart by 64-bit hashes, of which 40 bits go to the shard; a window matches if its WINDOW words do.

Nulls: a null text has no words. A null doc_id stands for the smallest long, and so comes first. Rows that share a doc_id
are rows of their own, in order of their texts, each with the spans of its own text. A text of fewer than WINDOW words is kept. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.common import chunks, column, gram_hashes, mix, row_keys, runs, signed, text_bytes, word_hashes, word_spans

WINDOW, SEED = 20, 8
#: Bytes of text for which one shard is made.
SHARD_BYTES = 14 << 20


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one packed bit vector a level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n, self.levels = len(symbols), max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            packed = np.zeros(self.n // 64 * 8 + 8, np.uint8)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))
        self._starts = self._walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position at."""
        return self._walk(symbols, at) - self._starts[symbols]


class FmIndex:
    """Of a text of symbols 1..top, with suffixes sorted by their first `depth` symbols (at least)."""

    def __init__(self, text: np.ndarray, top: int, depth: int):
        n = len(text)
        order, k = np.argsort(text, kind="stable"), 1
        rank = text.astype(np.int64)
        while k < depth:
            key = rank * (n + 2)
            key[:-k] += rank[k:] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            k *= 2
        self.suffixes = order
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.bwt = WaveletMatrix(text[order - 1], top)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the rows of patterns, by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.bwt.n, np.int64)
        for c in patterns.T[::-1]:
            lo, hi = self.before[c] + self.bwt.rank(c, lo), self.before[c] + self.bwt.rank(c, hi)
        return lo, hi


def segments(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, row, first word (in its row) and number of windows of each segment."""
    data, at = text_bytes(batch)
    starts, ends, row = word_spans(data, at)
    words = word_hashes(data, starts, ends)
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if len(words) < WINDOW:
        return none
    grams = gram_hashes(words, SEED)
    span = WINDOW - SEED + 1
    # least of each run of `span` grams, by doubling; leftmost on ties
    n = len(words) - WINDOW + 1
    best, width = np.arange(len(grams)), 1
    while width * 2 <= span:
        l, r = best[:-width], best[width:]
        best, width = np.where(grams[r] < grams[l], r, l), width * 2
    l, r = best[:n], best[span - width : span - width + n]
    best = np.where(grams[r] < grams[l], r, l)
    window = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    if not len(window):
        return none
    seed = best[window]
    new = np.ones(len(window), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (np.diff(window) != 1)
    head = np.flatnonzero(new)
    first = np.searchsorted(row, np.arange(batch.num_rows))
    w = window[head]
    return grams[seed[head]], row[w], w - first[row[w]], np.diff(np.append(head, len(window)))


def shard_of(seed: np.ndarray, shards: int) -> np.ndarray:
    return (seed >> np.uint64(33)).astype(np.int64) % shards


def spread(ids: np.ndarray, shards: int) -> np.ndarray:
    """Negative shards, dealt by document: what needs no meeting with its kind goes there."""
    return -1 - (mix(ids.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % shards


def _seeds(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Segments by the shard of their seed. A seed that a chunk has twice is known to repeat: its segments go to negative shards,
    and its own shard gets one row with n = 0 that says so, however common the seed is."""
    for batch in chunks(batches):
        seed, row, start, n = segments(batch)
        ids = column(batch, "doc_id")[row]
        each, back, count = np.unique(seed, return_inverse=True, return_counts=True)
        many, mark = count[back] > 1, each[count > 1]
        none = np.zeros(len(mark), np.int64)
        shard = np.concatenate((np.where(many, spread(ids, shards), shard_of(seed, shards)), shard_of(mark, shards)))
        cols = [np.concatenate(x).astype(k) for x, k in (((seed, mark), np.uint64), ((ids, none), np.int64), ((start, none), np.int32), ((n, none), np.uint8))]
        used = list(runs(shard))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in used], pa.int32()), *[pa.array([x[at].tobytes() for _, at in used], pa.binary()) for x in cols]], ["shard", "seed", "ids", "start", "n"])


def _repeated(table: pa.Table) -> pa.Table:
    seed, ids, start, n = (np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()]) for c, k in (("seed", np.uint64), ("ids", np.int64), ("start", np.int32), ("n", np.uint8)))
    if table.column("shard")[0].as_py() < 0:
        held = np.ones(len(seed), bool)
    else:
        each, back = np.unique(seed, return_inverse=True)
        held = (np.bincount(back, np.where(n == 0, 2, 1), len(each))[back] > 1) & (n > 0)
    return pa.table({"doc_id": ids[held], "start": start[held], "n": n[held].astype(np.int32), "seed": signed(seed[held])})


def _contents(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """For each shard the distinct segments' words (40 bits each) and all their places."""
    for batch in chunks(batches):
        data, at = text_bytes(batch)
        starts, ends, row = word_spans(data, at)
        words = word_hashes(data, starts, ends)
        first = np.searchsorted(row, np.arange(batch.num_rows))
        asked = batch.column("segments")
        of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asked.offsets)))
        flat = asked.flatten()
        start, n, seed = (flat.field(k).to_numpy() for k in ("start", "n", "seed"))
        begin, size = first[of] + start, n + WINDOW - 1
        # content keys: windows of one seed that agree in all words
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * (2 * np.arange(len(words), dtype=np.uint64) + np.uint64(1)), dtype=np.uint64)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words, dtype=np.uint64)))
        whole = sums[begin + size] - sums[begin]
        key = (run[begin + size] - run[begin]) - np.uint64(2) * begin.astype(np.uint64) * whole
        order = np.lexsort((key, whole, size, seed))
        same = np.ones(len(order), bool)
        for x in (key, whole, size, seed):
            y = x[order]
            same[1:] &= y[1:] == y[:-1]
        same[:1] = False
        group = np.cumsum(~same) - 1
        heads = order[~same]
        ids = column(batch, "doc_id")[of]
        # of equal segments the first goes to the shard; the chunk's others are later occurrences of all their windows
        place = np.lexsort((start[order], ids[order], group))
        first_of = np.ones(len(place), bool)
        first_of[1:] = group[place[1:]] != group[place[:-1]]
        kept, later = order[place[first_of]], order[place[~first_of]]
        out: dict[str, list] = {k: [] for k in ("size", "low", "high", "ids", "start")}
        shard_ids = []
        for s, at in runs(shard_of(seed[kept].view(np.uint64), shards)):
            h = kept[at]
            ln = size[h].astype(np.int64)
            w = words[np.repeat(begin[h] - np.cumsum(ln) + ln, ln) + np.arange(ln.sum())]
            shard_ids.append(s)
            for k, x, kind in (("size", ln, np.uint16), ("low", w, np.uint32), ("high", w >> np.uint64(32), np.uint8), ("ids", ids[h], np.int64), ("start", start[h], np.int32)):
                out[k].append(x.astype(kind).tobytes())
        for s, at in runs(spread(ids[later], shards)):
            h = later[at]
            shard_ids.append(s)
            for k, x in (("size", size[h].astype(np.uint16)), ("low", h[:0]), ("high", h[:0]), ("ids", ids[h]), ("start", start[h].astype(np.int32))):
                out[k].append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(shard_ids, pa.int32()), *[pa.array(x, pa.binary()) for x in out.values()]], ["shard", *out])


def later_occurrences(size: np.ndarray, words: np.ndarray, seg: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, first word and end of the runs of words whose windows occur earlier.

    Segments have size words, laid end to end in words; occurrence k is segment seg[k] in document ids[k] from word start[k].
    """
    # equal segments of different tasks become one
    ends = np.cumsum(size)
    text_key = np.add.reduceat(words * (2 * (np.arange(len(words)) - np.repeat(ends - size, size)).astype(np.uint64) + np.uint64(1)), ends - size)
    other = np.bitwise_xor.reduceat((words + np.uint64(1)) * (words ^ (np.arange(len(words)) - np.repeat(ends - size, size)).astype(np.uint64)), ends - size)
    order = np.lexsort((other, text_key, size))
    new = np.ones(len(order), bool)
    new[1:] = (other[order[1:]] != other[order[:-1]]) | (text_key[order[1:]] != text_key[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
    to = np.empty(len(order), np.int64)
    to[order] = np.cumsum(new) - 1
    pick = order[new]
    seg, begin, size = to[seg], (ends - size)[pick], size[pick]
    # places as one number: the document's rank and the word
    names, doc = np.unique(ids, return_inverse=True)
    place = (doc.astype(np.int64) << 32) + start
    first = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(first, seg, place)
    # the text: segments with a 0 after each
    alphabet, dense = np.unique(words, return_inverse=True)
    room = size + 1
    at = np.cumsum(room) - room
    text = np.zeros(room.sum(), np.int64)
    own = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(at, size) + own] = dense.ravel()[np.repeat(begin, size) + own] + 1
    index = FmIndex(text, len(alphabet), WINDOW)
    # a place for each suffix; what begins at a 0 has none
    where = np.repeat(first - at, room) + np.arange(len(text))
    where[text == 0] = np.iinfo(np.int64).max
    where = np.append(where[index.suffixes], np.iinfo(np.int64).max)
    n = size - WINDOW + 1
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(at, n) + offset
    earliest = np.empty(len(left), np.int64)
    for k in range(0, len(left), 1 << 16):
        lo, hi = index.search(text[left[k : k + (1 << 16), None] + np.arange(WINDOW)])
        # intervals of one size of window are equal or disjoint
        lo, pick, back = np.unique(lo, return_index=True, return_inverse=True)
        earliest[k : k + (1 << 16)] = np.minimum.reduceat(where, np.stack((lo, hi[pick]), 1).ravel())[::2][back]
    # every occurrence's windows against the first of their kind
    many = n[seg]
    line = np.repeat(np.arange(len(seg)), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    later = np.flatnonzero(place[line] + step > earliest[(np.cumsum(n) - n)[seg][line] + step])
    if not len(later):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(later), bool)
    new[1:] = (line[later[1:]] != line[later[:-1]]) | (np.diff(later) != 1)
    head, tail = later[new], later[np.append(np.flatnonzero(new)[1:] - 1, len(later) - 1)]
    return ids[line[head]], start[line[head]] + step[head], start[line[tail]] + step[tail] + WINDOW


def _search(table: pa.Table) -> pa.Table:
    get = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
    size, ids, start = get("size", np.uint16).astype(np.int64), get("ids", np.int64), get("start", np.int32).astype(np.int64)
    if table.column("shard")[0].as_py() < 0:
        a, b = start, start + size
    else:
        words = get("low", np.uint32).astype(np.uint64) | get("high", np.uint8).astype(np.uint64) << np.uint64(32)
        ids, a, b = later_occurrences(size, words, np.arange(len(size)), ids, start)
    return pa.table({"doc_id": ids, "a": a.astype(np.int32), "b": b.astype(np.int32)}, pa.schema([("doc_id", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of (a, b), words a to b - 1 of the document), of the words to take out."""
    d = _by_id(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    seeds = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _seeds(b, shards), "shard int, seed binary, ids binary, start binary, n binary")
    asked = seeds.groupBy("shard").applyInArrow(_repeated, "doc_id long, start int, n int, seed long")
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "seed")).alias("segments"))
    held = d.join(asked, "doc_id").select("doc_id", "text", "segments")
    contents = held.mapInArrow(lambda b: _contents(b, shards), "shard int, size binary, low binary, high binary, ids binary, start binary")
    found = contents.groupBy("shard").applyInArrow(_search, "doc_id long, a int, b int")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _by_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text").repartition("doc_id")


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) for each row; with texts, also kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, at = text_bytes(batch)
            starts, ends, row = word_spans(data, at)
            count = np.bincount(row, minlength=batch.num_rows)
            first = np.concatenate(([0], np.cumsum(count)))
            spans = batch.column("spans")
            sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            base = np.repeat(first[:-1], sizes)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, base + flat.field("a").to_numpy(), 1)
            np.add.at(change, base + flat.field("b").to_numpy(), -1)
            gone = np.cumsum(change[:-1]) > 0
            raw, sha, kept = data.tobytes(), [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                k = np.flatnonzero(~gone[a:b]) + a
                text = b" ".join([raw[s:e] for s, e in zip(starts[k].tolist(), ends[k].tolist(), strict=True)])
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if texts else None)
            removed = np.bincount(row[gone], minlength=batch.num_rows)
            out = [batch.column("doc_id"), pa.array(count), pa.array(removed), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(out[: 4 + texts], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + texts])

    keyed = row_keys(docs.select("doc_id", "text"))
    if keyed is not None:  # spans are the rows', not the ids'
        of = keyed.select(F.col("row_").alias("doc_id"), F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(1 << 63))).alias("id_"))
        out = remove_repeats(keyed.select(F.col("row_").alias("doc_id"), F.col("doc.text").alias("text")), texts).join(of, "doc_id")
        return out.select(F.col("id_").alias("doc_id"), *out.columns[1:-1])

    held = _by_id(docs).join(repeated_spans(docs), "doc_id", "left").select("doc_id", "text", "spans")
    return held.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


SQL = r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS later
  FROM (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS h FROM words)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM windows WHERE later),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
