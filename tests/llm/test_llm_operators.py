"""Each numbered operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefgrid.llm import bpe, fingerprints, language_id, line_dedup, links, lm_scoring, mixing, ngram_join, substring_dedup, token_counts, topk

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket string"


def words(t):
    return WORD.findall(t or "")


def corpus():
    """Copies, near copies, shared passages, odd blanks, nulls, empty and long texts; also columns of clashing names."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 9))) for _ in range(120)]
    passage = [r.choice(vocab) for _ in range(60)]
    texts = [None, "", "   ", "\n\n", "one", "One", "two words", "  x", "a" * 3000, " ".join(["again"] * 90)]
    for k in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(1, 200))]
        if k % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        texts.append("\n".join(" ".join(w[i : i + 17]) + r.choice([".", "", " ,"]) for i in range(0, len(w), 17)))
    texts += [texts[20], texts[20], texts[33].upper(), texts[40].replace(" ", "  ")]
    for k in (15, 25, 35, 45):
        w = texts[k].split(" ")
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), " ".join(w[:-1])]
    r.shuffle(texts)
    return [(i * 3, t, [None, "xx", "yy"][i % 3], [None, "b", "a", "Z"][i % 4], 1, "s", "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- op1


@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_lm_scores(docs, rows, min_count):
    got = by_id(lm_scoring.score_documents(docs, min_count))
    uni, bi, first = Counter(), Counter(), Counter()
    for _, t, *_ in rows:
        w = words(t)
        uni.update(w)
        bi.update(zip(w, w[1:]))
        first.update(w[:-1])
    total = sum(uni.values())
    for i, t, *_ in rows:
        w = words(t)
        assert got[i].n_words == len(w)
        if not w:
            assert got[i].score is None
            continue
        s = math.log(uni[w[0]] / total)
        for a, b in zip(w, w[1:]):
            s += math.log(bi[a, b] / first[a]) if bi[a, b] >= min_count else math.log(0.4 * uni[b] / total)
        assert got[i].score == pytest.approx(s / len(w), abs=2e-6)


@pytest.mark.parametrize("min_count", [1, 2])
def test_lm_scores_with_light_words(docs, monkeypatch, min_count):
    """The same with next to no broadcast words or hot bigrams and with many buckets."""
    full = by_id(lm_scoring.score_documents(docs, min_count))
    monkeypatch.setattr(lm_scoring, "HEAVY", 3)
    monkeypatch.setattr(lm_scoring, "KNOWN", 30)
    monkeypatch.setattr(lm_scoring, "TASK_BIGRAMS", 700)
    monkeypatch.setattr(lm_scoring, "BUCKET_WORDS", 500)
    light = by_id(lm_scoring.score_documents(docs, min_count))
    assert {k: (v.n_words, v.score) for k, v in full.items()} == {k: (v.n_words, v.score) for k, v in light.items()}


def test_lm_scores_no_rows_no_ids(spark, empty):
    assert lm_scoring.score_documents(empty).collect() == []
    d = spark.createDataFrame([(None, "a b a"), (4, None), (5, "b"), (5, "a b")], "doc_id long, text string")
    got = by_id(lm_scoring.score_documents(d))
    low = -(1 << 63)
    assert {k: v.n_words for k, v in got.items()} == {low: 3, 4: 0, 5: 3}
    # a occurs 3 times of 6 and starts 2 bigrams, both "a b"; b starts one, "b a"
    assert got[low].score == pytest.approx(math.log(1 / 2) / 3, abs=2e-6)
    assert got[4].score is None
    assert got[5].score == pytest.approx(2 * math.log(1 / 2) / 3, abs=2e-6)


# --- op2


def test_language_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    found = language_id.identify(d.where(held), language_id.train(d.where(~held))).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_id_edges(spark, docs, rows, empty):
    model = language_id.train(docs)
    got = by_id(language_id.identify(docs, model))
    for i, t, *_ in rows:
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert language_id.identify(empty, model).count() == 0
    none = by_id(language_id.identify(docs, language_id.train(empty)))
    assert {r.lang_pred for r in none.values()} == {"und"}
    placed = by_id(language_id.relabel(docs, model))
    for i, *_ in rows:
        assert (i in placed) == (got[i].lang_pred != "und" and got[i].score >= 0.5)
        assert i not in placed or placed[i].lang == got[i].lang_pred


def plain_features(text):
    """The n-grams of a text, one by one, as strings."""
    out, kept = [], ""
    for c in (text or "").lower() + "\n":
        kept += c if c.isalpha() else " " if kept and kept[-1] != " " else ""
    kept = kept if any(c.isalpha() for c in kept) else ""
    for n in (1, 2, 3):
        out += [kept[k : k + n] for k in range(len(kept) - n + 1)]
    return out


def test_predictions_by_plain_counts(spark):
    """Naive Bayes over the n-grams themselves, without hashing, picks the same language for nearly every text."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    labelled = [r for r in rows if r[1] is not None and r[2] is not None]
    counts, docs = defaultdict(Counter), Counter()
    for _, t, lang in labelled:
        counts[lang].update(plain_features(t))
        docs[lang] += 1
    total, every = {x: sum(c.values()) for x, c in counts.items()}, sum(docs[x] + 1 for x in counts)
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(counts)
    same, asked = 0, [r for r in rows if plain_features(r[1])]
    got, score = model.predict([r[1] for r in asked])
    for (_, t, _), g, s in zip(asked, got, score):
        f = plain_features(t)
        sums = {x: math.log((docs[x] + 1) / every) + sum(math.log((counts[x][g] + 0.5) / (total[x] + 0.5 * 2**language_id.BITS)) for g in f) for x in counts}
        best = max(sorted(sums), key=sums.get)
        same += best == g
        assert s >= 1 / len(counts) - 1e-9
    assert same >= 0.98 * len(asked)


def test_language_id_brute(docs, rows):
    model = language_id.train(docs)
    labelled = [r for r in rows if r[1] is not None and r[2] is not None]
    f, row = language_id.features([r[1] for r in labelled])
    for k, lang in enumerate(model.languages):
        n = Counter(x for x, i in zip(f.tolist(), row.tolist()) if labelled[i][2] == lang)
        total = sum(n.values())
        p = [math.log((n[x] + 0.5) / (total + 0.5 * 2**language_id.BITS)) for x in range(0, 2**language_id.BITS, 997)]
        assert np.allclose(model.log_p[k, ::997], p)


# --- op3


def brute_top(vectors, k):
    out = set()
    for q, a in vectors.items():
        if q % 20 == 0:
            ranked = sorted(((-sum(x * y for x, y in zip(a, b)), v) for v, b in vectors.items() if v != q))[:k]
            out |= {(q, n + 1, v, -s) for n, (s, v) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("n", [0, 5, 90, 400])
def test_top_k(spark, n, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    r = random.Random(n)
    vectors = {i: [r.choice([-1.0, 0.0, 0.5, 0.26]) for _ in range(6)] for i in range(n)}
    rows = [(i, v) for i, v in vectors.items()] + [(5 * n + 1, None), (5 * n + 2, [1.0, None]), (5 * n + 20, [float("nan")]), (5 * n + 40, [float("inf")]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>")
    v = topk.integer_vectors(df)
    got = topk.top_k(v, v.where("vec_id % 20 = 0"))
    want = brute_top({i: [math.floor(64 * np.float64(np.float32(x))) for x in a] for i, a in vectors.items()}, 20)
    assert {tuple(x) for x in got.collect()} == want


def test_top_k_sends_less_than_all(spark):
    """Entries below the uniform threshold stay where they are, and some partial scores are looked up in phase 3."""
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)], 1, 2) for i in range(2000)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, query_id int"))
    sent, _, least = topk.sent_entries(v, v.where("vec_id % 20 = 0"))
    n, both = sent.count(), sent.groupBy("query_id", "vec_id").count().where(f"count < {topk.LISTS}").count()
    assert least.count() == 100 * topk.LISTS and n < 0.2 * 100 * 2000 * topk.LISTS and both > 0


# --- op4


def test_fingerprints(docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 4096)
    got = by_id(fingerprints.edited_fingerprints(docs))
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    after = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    at = dict(order)
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    nexts = {i: order[(k + 1) % len(order)][0] for k, (i, _) in enumerate(order)}
    for i, t in order:
        n = len(t) // 3
        edited = t[: len(t) - n] + after[i][:n]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == plain[i]
        assert (got[i].fingerprint == got[i].edited_fingerprint) or edited != t
        if edited == t:
            assert got[i].near_edited == 1.0
        if at[nexts[i]] == t:
            assert got[i].near_next == 1.0
    for i, t in order:
        for j, u in order:
            cut = lambda x: sorted(p for p in re.split(fingerprints.PARAGRAPH, x) if p)
            assert (plain[i] == plain[j]) == (cut(t) == cut(u))


def test_buckets_in_steps(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "FAN", 4)
    r = random.Random(1)
    for m in (0, 1, 4, 5, 15, 16, 17, 40, 63):
        cuts = sorted(r.sample(range(1000), m))
        d = spark.createDataFrame([(r.randrange(1000),) for _ in range(200)] + [(c,) for c in cuts], "id long")
        assert all(b == sum(c < i for c in cuts) for i, b in d.select("id", fingerprints._bucket(F.col("id"), cuts)).collect())


def brute_likeness(a, b):
    """The likeness of two texts' paragraphs by their +-1 lanes, from the fingerprints' digits alone."""
    lanes = lambda f: [(x - 65536 if x >= 32768 else x) for x in (int(f[64 + 4 * k : 68 + 4 * k], 16) for k in range(fingerprints.LANES))]
    x, y = lanes(a), lanes(b)
    whole = sum(i * i for i in x) + sum(i * i for i in y)
    return 1.0 if not whole else max(0.0, min(1.0, 1 - sum((i - j) ** 2 for i, j in zip(x, y)) / whole))


def test_likeness_is_that_of_the_fingerprints(docs, rows):
    got = by_id(fingerprints.edited_fingerprints(docs))
    order = sorted((i for i, *_ in rows), reverse=True)
    for k, i in enumerate(order):
        assert got[i].near_edited == pytest.approx(brute_likeness(got[i].fingerprint, got[i].edited_fingerprint), abs=1e-6)
        assert got[i].near_next == pytest.approx(brute_likeness(got[i].fingerprint, got[order[(k + 1) % len(order)]].fingerprint), abs=1e-6)


def test_fingerprints_add_up(spark, empty):
    parts = [("one line", "two lines.\nthree"), ("a, b", ""), ("x", "x")]
    for a, b in parts:
        d = spark.createDataFrame([(1, a), (2, b), (3, f"{b}\n{a}")], "doc_id long, text string")
        f = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(d).collect()}
        both = spark.createDataFrame([(f[1], f[2], f[3])], "a string, b string, c string")
        r = both.select(fingerprints.combine(F.col("a"), F.col("b")), fingerprints.combine(F.col("c"), F.col("b"), -1)).first()
        assert tuple(r) == (f[3], f[1])
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


# --- op5


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone |= set(range(k, k + 20))
            seen.add(key)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 10_000)
    got = {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in by_id(substring_dedup.remove_repeats(docs)).items()}
    assert got == brute_repeats(rows)
    assert any(x[1] for x in got.values())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_fm_index_intervals():
    r = np.random.default_rng(3)
    text = np.append(r.integers(1, 5, 399), 0)
    index = substring_dedup.FmIndex(text, 4, 20)
    for size in (1, 3, 7):
        p = np.stack([text[k : k + size] for k in range(0, 380, 7)])
        lo, hi = index.search(p)
        for q, a, b in zip(p, lo, hi):
            at = {k for k in range(400 - size + 1) if (text[k : k + size] == q).all()}
            assert at == set(index.suffixes[a:b].tolist())


# --- op6


def test_bpe_equals_the_library(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    got = by_id(bpe.encode_documents(docs, path))
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_on_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, own = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    r = random.Random(1)
    pool = "aabcdeéèüßñΣσİıſKÅ1２½²Ⅷ'’\"!?.,-_|<>@#́  \u0085᠎\x1c\x00\n\t  日本語한국어🙂👩‍👩‍👧المdž_中"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b <|startoftext|>", "it's THE'RE 'll 'sample", "x" * 700, "ΑΣ ΑΣΑ", "</w> <w/>", "aaaaaaaaaaaaaaaaaaaaaaa", "!!!!!!??!!...,,"]
    with open(__file__, encoding="utf-8") as f:
        texts.append(f.read())
    for x in texts:
        raw, said = own.encode(x)
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u2").tolist() == want, repr(x)
        assert own.decode(np.frombuffer(raw, "<u2")).decode() == t.decode(want, skip_special_tokens=False)
        assert said[1:] == " ".join(map(str, want))


# --- op7


def brute_links(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [8, 1])
@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_ngram_join(docs, rows, n, num, den, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    got = {k: (r.n_shingles, r.component_id) for k, r in by_id(ngram_join.link_documents(docs, n, num, den)).items()}
    assert got == brute_links(rows, n, num, den)


def test_ngram_join_empty(empty):
    assert ngram_join.link_documents(empty).count() == 0
    assert ngram_join.dedup_documents(empty).columns == empty.columns


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(links.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


# --- op8


def brute_targets(sizes, share=1.5, most=2):
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    return target


@pytest.mark.parametrize("range_rows", [65536, 2])
def test_mixing(docs, rows, range_rows):
    got = by_id(mixing.mix_sources(docs, range_rows=range_rows))
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    target, taken = brute_targets(sizes), defaultdict(int)
    for i, t, _, s, *_ in rows:
        r = got[i]
        assert (r.size, r.source_size) == (len(words(t)), sizes[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes)
    again = by_id(mixing.mix_sources(docs.repartition(2), range_rows=3))
    assert {k: r.taken for k, r in again.items()} == {k: r.taken for k, r in got.items()}


def test_columns_of_any_name(spark):
    """Columns named as the operators' own pass through, and rows that share an id or have none are documents of their own."""
    names = ["kept", "id_", "target", "taken", "size", "row_", "doc", "source_size", "part_", "take"]
    texts = ["one two three\nfour five six seven", "another line here\nfour five six seven", "one two three\nlast of all", None, ""]
    rows = [([3, 3, None, None, 9][k], t, "s", *[k * 10 + j for j in range(len(names))]) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in names))
    got = line_dedup.dedup_lines(d).collect()
    assert sorted((x.kept, x.text is None, x.part_) for x in got) == [(k * 10, t is None, k * 10 + 8) for k, t in enumerate(texts)]
    lines = [x for r in got for x in (r.text or "").split("\n") if x]
    assert sorted(lines) == sorted({x for t in texts for x in (t or "").split("\n") if x})
    mixed = mixing.mixed_documents(d).collect()
    assert {x.taken for x in mixed} <= {r[2 + 4] for r in rows} and mixed[0].asDict().keys() == dict.fromkeys(d.columns).keys()
    assert {x.size for x in ngram_join.dedup_documents(d, 2).collect()} <= {k * 10 + 4 for k in range(5)}
    decided = line_dedup.line_decisions(d).collect()
    assert len(decided) == 5 and all(x.n_removed >= 0 and x.n_removed == x.n_lines - len(x.kept_lines) for x in decided)


def test_mixed_documents(docs, rows, empty):
    got = mixing.mixed_documents(docs.drop("size", "bucket")).collect()
    n = Counter()
    for r in got:
        n[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in n.items() if v} == {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect() if r.taken}
    assert mixing.mix_sources(empty).count() == 0


# --- op9


def brute_lines(rows):
    shingle = lambda line: {line[k : k + 8] for k in range(max(1, len(line) - 7))}
    at = []
    for i, t, *_ in sorted(rows):
        at += [(i, k, x.strip(" \n\t")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \n\t")]
    texts = list(dict.fromkeys(x for _, _, x in at))
    sets, root = [shingle(x) for x in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o >= 0.8 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    of, seen, kept = {x: find(k) for k, x in enumerate(texts)}, set(), defaultdict(list)
    for i, k, x in at:
        if of[x] not in seen:
            seen.add(of[x])
            kept[i].append(k)
    return kept


def test_line_dedup(docs, rows, empty):
    got = by_id(line_dedup.line_decisions(docs))
    want = brute_lines(rows)
    same = sum(got[i].kept_lines == want[i] for i, *_ in rows)
    assert same >= 0.97 * len(rows)  # MinHash may miss a pair near the threshold
    assert any(r.n_removed for r in got.values())
    assert line_dedup.line_decisions(empty).count() == 0
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    for i, t, *_ in rows:
        lines = None if t is None else [x for k, x in enumerate(t.split("\n")) if k in got[i].kept_lines or not x.strip(" \n\t")]
        assert texts[i] == (None if t is None else "\n".join(lines))


# --- op10


def test_token_counts_equal_the_library(docs, rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.piece_scores(path)
    t = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    low = min(s for _, s in pieces)
    assert low <= 0  # so that the library's unknown cost is the same
    got = by_id(token_counts.count_tokens(docs, path))
    for i, text, *_ in rows:
        assert (got[i].n_words, got[i].n_tokens) == (len(words(text)), sum(len(t.encode("▁" + w).ids) for w in words(text)))
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_count_ties_and_unknown():
    r = random.Random(2)
    for _ in range(300):
        pool = ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(12)]
        pieces = [(p, float(-r.randint(1, 4))) for p in dict.fromkeys(pool)]
        t = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *pieces], 0, False))
        c = token_counts.Counter(pieces)
        for _ in range(20):
            w = "".join(r.choice("abcd") for _ in range(r.randint(1, 12)))
            assert c.count(w) == len(t.encode(w).ids), (pieces, w)
