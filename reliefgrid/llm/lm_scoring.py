"""LM scoring: stupid-backoff scores from bigram and unigram counts of the whole corpus.

S(w | v) = c(v w) / c(v) if the bigram occurs at least min_count times, else BACKOFF * c(w) / N; a text's first word has
c(w) / N. c(v) counts v as the first word of a bigram. A document's score is the sum of log S over its words, divided by
their number. min_count is 1 unless the caller asks for more: no bigram is left out, and as the documents are scored by
their own counts, none backs off then.

1. Words' counts, and their counts as first words of bigrams, are added up over all documents. Words with at least
   1 / KNOWN of all occurrences, at most KNOWN of them, are broadcast with their counts. So are hot bigrams, those with
   1 / HEAVY of all occurrences (at most 2 * HEAVY are): any such bigram has 1 / (2 * HEAVY) of some runs of TASK_BIGRAMS
   bigrams that add up to half of that, so it is found there, and is then counted exactly. What is broadcast is scored
   in the documents' own tasks; hot bigrams are never sent.
2. All other bigrams are dealt to buckets by the hash of their second word, those of a heavy second word (1 / HEAVY of all)
   by both words; a text's first word, and a mark of its last word, if that is heavy, by the document. Each document sends
   a bigram once, with how often it holds it, and a bucket's part of a task is one row of packed arrays. A bucket has all
   occurrences of its bigrams and of its light second words: it counts them, and with the marks it has their counts as
   first words too, so that the numerator of one bigram and the denominator of the next are added where they are counted.
3. With a min_count above 1 a denominator counts only behind bigrams that are kept: for these, first words that aren't
   broadcast are joined with their counts by hash. The parts are summed by document.

Words are told apart by 64-bit hashes. Nulls: a null text has no words; such rows have score null. A null doc_id stands
for the smallest long. Rows that repeat a doc_id are scored together, as one row. An empty table gives an empty table.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.common import CHUNK_BYTES, WORD, chunks, column, materialize, mix, runs, signed, text_bytes, word_hashes, word_spans

BACKOFF = 0.4
#: Words with at least 1 / HEAVY of all occurrences are dealt by bigram; those with 1 / KNOWN are broadcast with counts (24 bytes each).
HEAVY, KNOWN = 1 << 15, 1 << 20
BUCKET_WORDS = 1 << 20
#: Buckets that a group holds packed and scores one by one, so that a document's sum is sent once for all of them.
TOGETHER = 3
#: Stands before a text's first word; stands before its last word once more, as a mark.
START, LAST = np.int64(-(1 << 63)), np.int64(1 - (1 << 63))
#: Distinct words that a task counts before it hands them on.
TASK_WORDS = 1 << 20
#: Bigrams that a task gathers before it packs them, at 36 bytes each, or looks for hot ones.
TASK_BIGRAMS = 1 << 21


class Model(NamedTuple):
    """What each task holds of the counts."""

    total: int
    min_count: int
    heavy: np.ndarray
    known: np.ndarray
    known_n: np.ndarray
    known_first: np.ndarray
    hot: np.ndarray
    hot_n: np.ndarray


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(batch)
    starts, ends, row = word_spans(data, at)
    return signed(word_hashes(data, starts, ends)), row


def _pairs(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v.view(np.uint64)) ^ w.view(np.uint64))


def _inner(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The bigrams within a row, as hashes."""
    at = np.flatnonzero(row[1:] == row[:-1])
    return signed(_pairs(words[at], words[at + 1]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n (occurrences), n_first (those that another word follows), added up within the task; also, with a null
    n_first, the bigrams that have 1 / (2 * HEAVY) of TASK_BIGRAMS or of the rest of the task."""
    none = (np.zeros(0, np.int64),) * 3
    held, pairs, many = none, [], 0
    out = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["word", "n", "n_first"])

    def often() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(pairs), return_counts=True)
        at = n * 2 * HEAVY >= many
        return out((keys[at], n[at], pa.nulls(int(at.sum()), pa.int64())))

    for batch in chunks(batches):
        w, row = _words(batch)
        followed = np.zeros(len(w), np.int64)
        followed[:-1] = row[1:] == row[:-1]
        keys, back = np.unique(np.concatenate((held[0], w)), return_inverse=True)
        held = (keys, *[np.bincount(back, np.concatenate(x), len(keys)).astype(np.int64) for x in ((held[1], np.ones(len(w), np.int64)), (held[2], followed))])
        if len(keys) > TASK_WORDS:
            yield out(held)
            held = none
        pairs.append(_inner(w, row))
        many += len(pairs[-1])
        if many > TASK_BIGRAMS:
            yield often()
            pairs, many = [], 0
    yield out(held)
    if many:
        yield often()


def _count_pairs(batches: Iterator[pa.RecordBatch], asked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """pair, n of the bigrams asked for, added up within the task."""
    n = np.zeros(len(asked), np.int64)
    for batch in chunks(batches):
        at = _find(asked, _inner(*_words(batch)))
        n += np.bincount(at[at >= 0], minlength=len(asked))
    yield pa.RecordBatch.from_arrays([pa.array(asked[n > 0]), pa.array(n[n > 0])], ["pair", "n"])


def _find(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return np.where(keys[at] == words, at, -1)


def _ints(x: np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them, after one byte that names it."""
    width = next(k for k in range(4) if k == 3 or not len(x) or int(x.max()) < 1 << (8 << k))
    return bytes([width]) + x.astype(f"u{1 << width}").tobytes()


def _from_ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{1 << raw[0]}", offset=1).astype(np.int64)


def _code(x: np.ndarray, heavy: np.ndarray) -> tuple[bytes, bytes]:
    """Words as the distinct light ones, and indices into the heavy words followed by these."""
    at = _find(heavy, x)
    own, back = np.unique(x[at < 0], return_inverse=True)
    at[at < 0] = len(heavy) + back
    return own.tobytes(), _ints(at)


def _decode(own: bytes, codes: bytes, heavy: np.ndarray) -> np.ndarray:
    return np.concatenate((heavy, np.frombuffer(own, np.int64)))[_from_ints(codes)]


NAMES = ["bucket", "own_first", "first", "own_second", "second", "runs", "ids", "docs", "times"]
DEALT = "bucket int, " + ", ".join(f"{c} binary" for c in NAMES[1:])


def _row(v: np.ndarray, w: np.ndarray, docs: np.ndarray, times: np.ndarray, heavy: np.ndarray) -> list[bytes]:
    """Bigrams of one bucket by second word and document: each second word once with its run, ids by differences."""
    order = np.lexsort((docs, w))
    v, w, docs, times = v[order], w[order], docs[order], times[order]
    at = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    ids, of = np.unique(docs, return_inverse=True)
    return [*_code(v, heavy), *_code(w[at], heavy), _ints(np.diff(np.append(at, len(w)))), _pack_ids(ids), _ints(of), _ints(times)]


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids by their differences."""
    return ids[:1].tobytes() + _ints(np.diff(ids.view(np.uint64)))


def _ids(raw: bytes) -> np.ndarray:
    return np.cumsum(np.append(np.frombuffer(raw, np.int64, 1), _from_ints(raw[8:])))


def _bigrams(batch: pa.RecordBatch, buckets: int, m: Model) -> tuple[np.ndarray, ...]:
    """Buckets, in order; first and second word, id and times of each document's distinct bigrams that aren't hot; ids,
    numbers of words, and the sums of the hot bigrams."""
    words, row = _words(batch)
    ids = column(batch, "doc_id")
    numbers = np.bincount(row, minlength=len(ids))
    v = np.full(len(words), START)
    if len(words):
        inner = np.flatnonzero(row[1:] == row[:-1])
        v[inner + 1] = words[inner]
        if m.min_count == 1:
            ends = np.flatnonzero(np.append(row[1:] != row[:-1], True))
            v, words, row = np.append(v, np.full(len(ends), LAST)), np.append(words, words[ends]), np.append(row, row[ends])
    both = _pairs(v, words)
    order = np.lexsort((both, row))
    one = np.ones(len(order), bool)
    one[1:] = (both[order[1:]] != both[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    at = np.flatnonzero(one)
    times, pick = np.diff(np.append(at, len(order))), order[at]
    hot = _find(m.hot, signed(both[pick]))
    is_hot = hot >= 0
    of, hot_times = pick[is_hot], times[is_hot]
    under = m.known_first[_find(m.known, (words if m.min_count == 1 else v)[of])]
    sums = np.bincount(row[of], hot_times * (np.log(m.hot_n[hot[is_hot]]) - np.log(under)), len(ids))
    pick, times = pick[~is_hot], times[~is_hot]
    by_pair = np.where((v == START) | (v == LAST), mix(both ^ ids[row].view(np.uint64)), both)[pick]
    light = _find(m.heavy, words[pick]) < 0
    bucket = (np.where(light, mix(words[pick].view(np.uint64)), by_pair) >> np.uint64(20)).astype(np.int64) % buckets
    by = np.argsort(bucket, kind="stable")
    pick = pick[by]
    return bucket[by], v[pick], words[pick], ids[row[pick]], times[by].astype(np.int32), ids, numbers, sums


def _deal(batches: Iterator[pa.RecordBatch], buckets: int, m: Model) -> Iterator[pa.RecordBatch]:
    """Packed bigrams by bucket, a text's first word as one whose own first word is START; negative buckets hold each
    document's number of words, as times, and its sum of hot bigrams, as own_first. A task gathers about TASK_BIGRAMS
    before it packs, as larger rows pack closer."""

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        cols = [np.concatenate([h[k] for h in held]) for k in range(5)]
        ids, n, sums = (np.concatenate([h[k] for h in held]) for k in (5, 6, 7))
        held.clear()
        for b, at in runs(cols[0]):
            rows.append([b, *_row(*(x[at] for x in cols[1:]), m.heavy)])
            size += sum(map(len, rows[-1][1:]))
            if size > CHUNK_BYTES:
                yield out(rows)
                rows, size = [], 0
        yield out([*rows, [-1 - int(ids[0] % buckets), sums.tobytes(), b"", b"", b"", b"", ids.tobytes(), b"", _ints(n)]])

    def out(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*rows, strict=True))], NAMES)

    held, many = [], 0
    for batch in chunks(batches):
        held.append(_bigrams(batch, buckets, m))
        many += len(held[-1][1])
        if many > TASK_BIGRAMS:
            yield from packed(held)
            held, many = [], 0
    if held:
        yield from packed(held)


SCORED = "part int, ids binary, sums binary, numbers binary, doc_id long, word long, times long"


def _parts(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(20)).astype(np.int64) % parts


def _sums(ids: np.ndarray, sums: np.ndarray, numbers: np.ndarray, parts: int) -> list[tuple]:
    """Rows of SCORED that hold what is known of documents, packed by the part that a document's id falls in."""
    part = _parts(ids, parts)
    order = np.lexsort((ids, part))
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    pack = lambda at: _ints(numbers[at]) if len(numbers) else b""
    return [(int(part[at[0]]), _pack_ids(ids[at]), sums[at].tobytes(), pack(at)) for at in np.split(order, cuts) if len(at)]


def _score_bucket(rows: list[dict], m: Model) -> tuple[np.ndarray, ...]:
    """ids and their sums; id, word and times for each count of a first word that is to be taken off."""
    times = np.concatenate([_from_ints(r["times"]) for r in rows])
    v = np.concatenate([_decode(r["own_first"], r["first"], m.heavy) for r in rows])
    w = np.concatenate([np.repeat(_decode(r["own_second"], r["second"], m.heavy), _from_ints(r["runs"])) for r in rows])
    ids = np.concatenate([_ids(r["ids"])[_from_ints(r["docs"])] for r in rows])
    order = np.lexsort((v, w))
    v, w, ids, times = v[order], w[order], ids[order], times[order]
    new_w = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    new_b = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
    spread = lambda x, at: np.repeat(x, np.diff(np.append(at, len(v))))
    at = _find(m.known, w[new_w])
    c_second = np.where(at >= 0, np.append(m.known_n, 1)[at], np.add.reduceat(np.where(v != LAST, times, 0), new_w))
    ends = np.add.reduceat(np.where(v == LAST, times, 0), new_w)
    c_first = spread(np.where(at >= 0, np.append(m.known_first, 1)[at], np.maximum(c_second - ends, 1)), new_w)
    alone = np.log(spread(c_second, new_w)) - math.log(max(m.total, 1))
    c_bigram = spread(np.add.reduceat(times, new_b), new_b)
    if m.min_count == 1:
        # each place of a word but a text's last is the first of a bigram
        ask = np.zeros(len(v), bool)
        part = np.where(v == LAST, np.log(c_first), times * (np.where(v == START, alone, np.log(c_bigram)) - np.log(c_first)))
    else:
        first = spread(_find(m.known, v[new_b]), new_b)
        seen = (c_bigram >= m.min_count) & (v != START)
        back = alone + np.where(v != START, math.log(BACKOFF), 0.0)
        part = times * np.where(seen, np.log(c_bigram) - np.where(first >= 0, np.log(np.append(m.known_first, 1)[first]), 0.0), back)
        ask = seen & (first < 0)
    # what is known is summed by document; what isn't goes by (document, word)
    docs, back_to = np.unique(ids, return_inverse=True)
    return docs, np.bincount(back_to, part, len(docs)), ids[ask], v[ask], times[ask]


def _score(table: pa.Table, parts: int, m: Model) -> pa.Table:
    """SCORED of TOGETHER buckets, one after another: sums of documents over all of them, packed; and single rows doc_id,
    word whose count as a first word is to be taken off `times` times."""
    by: dict[int, list[dict]] = {}
    for r in table.to_pylist():
        by.setdefault(r["bucket"], []).append(r)
    if min(by) < 0:
        rows = [r for own in by.values() for r in own]
        ids, at = np.unique(np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows]), return_inverse=True)
        n = np.bincount(at, np.concatenate([_from_ints(r["times"]) for r in rows]), len(ids)).astype(np.int64)
        s = np.bincount(at, np.concatenate([np.frombuffer(r["own_first"]) for r in rows]), len(ids))
        return _scored(_sums(ids, s, n, parts))
    found = [_score_bucket(by.pop(b), m) for b in sorted(by)]
    docs, sums, ids, words, times = (np.concatenate(x) for x in zip(*found, strict=True))
    docs, at = np.unique(docs, return_inverse=True)
    return _scored(_sums(docs, np.bincount(at, sums, len(docs)), np.zeros(0, np.int64), parts), _parts(ids, parts), ids, words, times)


def _scored(packed: list[tuple], *asked: np.ndarray) -> pa.Table:
    """SCORED of packed rows, followed by the single rows asked."""
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    k, m = len(packed), len(asked[0]) if asked else 0
    part, *rest = zip(*packed, strict=True)
    cols = [pa.array(np.append(part, asked[0]) if asked else part, kinds[0])]
    cols += [pa.array([*x, *[None] * m], t) for x, t in zip(rest, kinds[1:4], strict=True)]
    cols += [pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(x)]) if asked else pa.nulls(k, pa.int64()) for x in (asked[1:] or (0, 0, 0))]
    return pa.table(cols, names=["part", "ids", "sums", "numbers", "doc_id", "word", "times"])


def _add(table: pa.Table) -> pa.Table:
    """doc_id, word, times, n_words, s: a row for each document of one part with its sum of what is known (word is null),
    and a row for each document and word that it asks for."""
    table = table.combine_chunks()
    one = table.filter(pc.is_valid(table.column("word"))).group_by(["doc_id", "word"]).aggregate([("times", "sum")])
    ids, s, n = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
    held = table.filter(pc.is_valid(table.column("ids")))
    for raw, sums, numbers in zip(*(held.column(c).to_pylist() for c in ("ids", "sums", "numbers")), strict=True):
        ids.append(_ids(raw))
        s.append(np.frombuffer(sums))
        n.append(_from_ints(numbers) if numbers else np.zeros(len(ids[-1])))
    docs, at = np.unique(np.concatenate(ids), return_inverse=True)
    n, s = (np.bincount(at, np.concatenate(x), len(docs)) for x in (n, s))
    k, none = one.num_rows, pa.nulls(len(docs), pa.int64())
    return pa.concat_tables([pa.table([pa.array(docs), none, none, pa.array(n.astype(np.int64)), pa.array(s)], names=ADDED), pa.table([one.column("doc_id"), one.column("word"), one.column("times_sum"), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64())], names=ADDED)])


ADDED = ["doc_id", "word", "times", "n_words", "s"]


def _sorted(table: pa.Table) -> list[np.ndarray]:
    """The columns, in the order of the first."""
    columns = [c.to_numpy() for c in table.columns]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def score_documents(docs: DataFrame, min_count: int = 1) -> DataFrame:
    """doc_id, n_words, score (mean log S of a word, rounded to 6 places; null without words)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), "text")
    counts = d.mapInArrow(_counts, "word long, n long, n_first long").groupBy("word", F.col("n_first").isNull().alias("pair"))
    counts = counts.agg(F.sum("n").alias("n"), F.sum("n_first").alias("n_first"))
    total = d.select(F.regexp_count("text", F.lit(WORD)).alias("n")).agg(F.sum("n")).first()[0] or 0
    # a word that occurs once is neither broadcast nor asked for: it starts one bigram at most
    counts = materialize(counts.where("n > 1"))
    often = counts.where("pair").where(F.col("n") * 2 * HEAVY >= total).select("word").toArrow()
    asked = spark.sparkContext.broadcast(_sorted(often)[0])
    pairs = d.mapInArrow(lambda b: _count_pairs(b, asked.value), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    hot, hot_n = _sorted(pairs.where((F.col("n") >= max(2, min_count)) & (F.col("n") * KNOWN >= total)).toArrow())
    counts = counts.where("not pair")
    known, known_n, known_first = _sorted(counts.where(F.col("n") * KNOWN >= max(total, 1)).select("word", "n", "n_first").toArrow())
    model = Model(total, min_count, known[known_n * HEAVY >= max(total, 1)], known, known_n, np.maximum(known_first, 1), hot, hot_n)
    held = spark.sparkContext.broadcast(model)
    buckets = max(1, math.ceil(total / BUCKET_WORDS))
    dealt = d.mapInArrow(lambda b: _deal(b, buckets, held.value), DEALT)
    scored = dealt.groupBy(F.floor(F.col("bucket") / TOGETHER)).applyInArrow(lambda t: _score(t, buckets, held.value), SCORED)
    out = scored.groupBy("part").applyInArrow(_add, "doc_id long, word long, times long, n_words long, s double")
    if min_count > 1:
        # a document's own row gets a key of its own in the join, so that these rows don't meet in one task
        added = out.withColumn("key", F.coalesce("word", F.xxhash64("doc_id", F.lit("none"))))
        found = added.join(counts.select(F.col("word").alias("key"), F.col("n_first").alias("c")), "key", "left")
        s = F.coalesce(F.col("s"), -F.col("times") * F.log("c"))
        out = found.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum(s).alias("s"))
    return out.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round(F.col("s") / F.col("n_words"), 6)).alias("score"))


SQL = r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
unigrams AS (SELECT word, count(*) AS n FROM each GROUP BY word),
total AS (SELECT count(*) AS n FROM each),
bigrams AS (SELECT doc_id, i, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS v, word AS w FROM each),
firsts AS (SELECT v, count(*) AS n FROM bigrams WHERE v IS NOT NULL GROUP BY v),
counted AS (SELECT v, w, count(*) AS n FROM bigrams WHERE v IS NOT NULL GROUP BY v, w),
scored AS (
  SELECT b.doc_id, CASE WHEN b.v IS NULL THEN ln(u.n) - ln(t.n) WHEN c.n >= 1 THEN ln(c.n) - ln(f.n) ELSE ln(0.4::DOUBLE) + ln(u.n) - ln(t.n) END AS s
  FROM bigrams b CROSS JOIN total t JOIN unigrams u ON u.word = b.w LEFT JOIN firsts f ON f.v = b.v LEFT JOIN counted c ON c.v = b.v AND c.w = b.w)
SELECT w.doc_id, max(len(w.w))::BIGINT AS n_words, round(sum(s.s) / max(len(w.w)), 6) AS score
FROM words w LEFT JOIN scored s USING (doc_id) GROUP BY w.doc_id
"""
