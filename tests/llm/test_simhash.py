"""op11: fingerprints and components against brute force; BK-trees, bands and their dealing on their own."""

import random

import numpy as np
import pytest
import xxhash

from reliefgrid.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root string, least string"


def brute_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in low).split("\n") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_groups(values, radius):
    root = list(range(len(values)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(values))]


def corpus():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 9))) for _ in range(90)]
    texts = [None, "", " \t\r\n\x0b\x0c ", "one", "One", "two words", "TWO words", "x\x85y", "x y", "\x1cx y"]
    for k in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(1, 150))]
        texts.append(" ".join(w))
        for _ in range(k % 4):
            w[r.randrange(len(w))] = r.choice(vocab)
            texts.append("  ".join(w).upper() if k % 5 == 0 else "\n".join(w))
    texts += [texts[20]] * 30 + [" ".join(["again"] * 5000), " ".join(r.choice(vocab) for _ in range(80_000))]
    r.shuffle(texts)
    ids = [5 * i for i in range(len(texts))]
    ids[3] = ids[4] = ids[50] = None
    ids[7] = ids[8]
    return [(i, t, "f", "r", "l") for i, t in zip(ids, texts)]


def test_equals_brute_force(spark):
    rows = corpus()
    got = simhash.link_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    groups = brute_groups(fps, 3)
    least = {}
    for (i, *_), g in zip(rows, groups):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((repr(i), f"{f:016x}", repr(least.get(g))) for (i, *_), f, g in zip(rows, fps, groups))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want
    assert len({g for g in groups}) < len(set(fps)) < len(rows)


def test_empty_and_only_null(spark):
    assert simhash.link_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    got = simhash.link_documents(spark.createDataFrame([(None, None, "", "", "")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(None, "0" * 16, None)]


def test_one_of_each_component_stays(spark):
    rows = [r for r in corpus()]
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    kept = simhash.dedup_documents(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "root", "least"]
    assert kept.count() == len(set(brute_groups(fps, 3)))


def clustered(r, centres, members, flips):
    """Distinct fingerprints: clusters of variants, and strangers."""
    out = set()
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(members):
            x = c
            for k in r.sample(range(64), r.randint(0, flips)):
                x ^= 1 << k
            out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_a_tree_finds_all_links(radius):
    fp = clustered(random.Random(radius), 6, 60, 6)
    bucket = np.arange(len(fp)) % 3
    forest = simhash.plant(fp, bucket)
    assert len(forest.fp) == len(fp)
    for k, (p, e) in enumerate(zip(forest.parent, forest.edge)):
        assert p < k and (p < 0 or int(forest.fp[k] ^ forest.fp[p]).bit_count() == e)
    for parts in (1, 4):
        pairs = [(int(a), int(b)) for k in range(parts) for x, y in simhash.search(forest, radius, k, parts) for a, b in zip(x, y)]
        assert all((a ^ b).bit_count() <= radius for a, b in pairs)
        for b in range(3):
            own = [int(x) for x in fp[bucket == b]]
            at = {x: i for i, x in enumerate(own)}
            root = list(range(len(own)))
            for x, y in pairs:
                if x in at and y in at:
                    i, j = root[at[x]], root[at[y]]
                    root = [min(i, j) if v in (i, j) else v for v in root]
            want = brute_groups(own, radius)
            assert [root.index(v) for v in root] == [want.index(v) for v in want]
        assert parts > 1 or len(pairs) < len(fp)


def test_large_buckets_are_dealt_again(spark):
    """Buckets of more than 20 are dealt by further bands; no pair within the radius is lost, and links stay fewer than entries in a task."""
    r = random.Random(4)
    fp = clustered(r, 5, 150, 4)
    entries = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    dealt = simhash.buckets(entries, 3, 20).collect()
    assert {x.band for x in dealt} & set(range(4, 84))
    held = {}
    for x in dealt:
        held.setdefault((x.band, x.key), []).append(x.fp & (1 << 64) - 1)
    met = {(a, b) for v in held.values() for a in v for b in v if a < b}
    values = [int(x) for x in fp]
    close = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}
    assert close and close <= met
    links = [(x.a & (1 << 64) - 1, x.b & (1 << 64) - 1) for x in simhash.near_links(entries, 3, 20, 64).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    want = brute_groups(values, 3)
    got = [top(v) for v in values]
    assert [got.index(v) for v in got] == [want.index(v) for v in want]


def test_masks():
    masks = simhash.band_masks(3)
    assert len(masks) == 4 + 16 + 64
    assert masks[0] | masks[1] | masks[2] | masks[3] == (1 << 64) - 1
    for b in range(20):
        assert all(masks[4 * (b + 1) + j] & masks[b] == masks[b] for j in range(4))
        union = 0
        for j in range(4):
            union |= masks[4 * (b + 1) + j]
        assert union == (1 << 64) - 1
