"""op12 against brute force: all lags of all words, on random, periodic and edited texts."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from reliefgrid.llm import periodic_runs as P

SCHEMA = "doc_id long, text string, runs string, best string, start string, n_chars long"


def brute_runs(w):
    """For each lag all longest stretches, and of these those without a smaller period."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = [x for x in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in text or "").split("\n") if x]
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def texts():
    r = random.Random(12)
    out = [None, "", "  \n", "one", " ".join(["w"] * 23), " ".join(["w"] * 24), " ".join(["w"] * 400), "a\x85b " * 40]
    for k in range(120):
        letters = "abcdefghijklmnop"[: r.choice([1, 2, 3, 5, 16])]
        w = [r.choice(letters) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            piece = [r.choice(letters) for _ in range(r.randint(1, 30))]
            w += (piece * 9)[: r.randint(1, 9 * len(piece))]
            w += [r.choice(letters) for _ in range(r.randint(0, 4))]
        if k % 6 == 0 and w:
            w[r.randrange(len(w))] = "odd"
        out.append("  ".join(w) if k % 2 else "\n".join(w))
    nested = ["a"] * 30 + ["b"]
    out += [" ".join(nested * 4), " ".join((["x", "y"] * 15 + ["z"]) * 5 + ["x", "y"] * 20)]
    return out


def test_equals_brute_force(spark):
    # ids whose checksum is divisible by ten are edited: take both kinds
    edited = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    plain = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10]
    rows = [(i, t) for t, i in zip(texts(), plain)] + [(i, t) for t, i in zip(texts(), edited)]
    rows += [(None, rows[-1][1]), (None, None), rows[20], rows[150]]
    docs = spark.createDataFrame([(i, t, "r", "b", "s", 1) for i, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, P.digest_runs(docs).collect()), key=repr)
    assert got == sorted((brute_row(i, t) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 100 and max(r[1] for r in got) > 2
    assert P.digest_runs(docs.where("false")).collect() == []


def test_long_texts(spark):
    """A repeated part inside a long text of prose, and one word again and again: whole texts, in about linear time."""
    r = random.Random(1)
    words = [f"w{min(int(r.expovariate(0.02)), 5000)}" for _ in range(120_000)]
    piece = words[:7000]
    long = words[:30_000] + piece * 4 + words[30_000:]
    rows = [(1, " ".join(long), "", "", "", 0), (2, " ".join(["again"] * 200_000), "", "", "", 0)]
    got = {x.doc_id: x for x in P.detect_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2].runs == [(0, 200_000, 1)] and got[2].collapsed == "again"
    (start, length, period), *more = [tuple(x) for x in got[1].runs if x.period == 7000]
    assert not more and start <= 30_000 and start + length >= 58_000
    assert tuple(got[1].best)[2] == P.best_run([tuple(x) for x in got[1].runs])[2]


@pytest.mark.parametrize("n, letters", [(1, 1), (50, 1), (300, 2), (3000, 3), (3000, 900), (20_000, 40)])
def test_counts_of_matches_are_exact(n, letters):
    ids = np.random.default_rng(n).integers(0, letters, n)
    ids = P.word_ids([str(x).encode() for x in ids])
    got = P.lag_matches(ids, n // 3)
    for q in {1, 2, n // 7, n // 3} - {0}:
        if q <= n // 3:
            assert got[q] == (ids[:-q] == ids[q:]).sum()
