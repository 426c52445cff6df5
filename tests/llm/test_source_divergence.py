"""op13 against its SQL and a dense brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from reliefgrid.llm import source_divergence as S

SCHEMA = "doc_id long, text string, lang string, source string, n long, p double, term string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def corpus():
    r = random.Random(13)
    vocab = [["Wort", "naïve", "été", "zz", "aa", "Ab", "ÄB", "bb"] + ["".join(r.choice("abcß") for _ in range(4)) for _ in range(60)] for _ in range(3)]
    rows = []
    for k in range(260):
        lang = [None, "", "en", "xx", "yy"][k % 5]
        source = r.choice([None, "", "s1", "S2", "é", "s10"])
        w = [r.choice(vocab[k % 3][: r.choice([8, 30, 68])]) for _ in range(r.randint(0, 60))]
        rows.append((k, r.choice([" ", "1", "\n", ".. "]).join(w), lang, source, 1, 0.5, "t"))
    rows += [(1000 + k, None, "en", f"void{k}", 1, 0.5, "t") for k in range(2)]
    rows += [(2000, "only here", "few", "s1", 1, 0.5, "t"), (None, "aa", "few", "s2", 1, 0.5, "t"), (None, " ".join(["aa bb"] * 20_000), "en", "s1", 1, 0.5, "t"), (5, "aa", "en", "s1", 1, 0.5, "t"), (5, "aa", "en", "s1", 1, 0.5, "t")]
    return rows


def brute(rows, least=10):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        t, lang, source = TERM.findall(low), lang or "", source or ""
        groups.add((lang, source))
        count[lang, source].update(t)
        count[lang].update(t)
        df[lang].update(set(t))
    kept = {g: sorted(t for t in df[g] if df[g][t] >= least) for g in {x for x, _ in groups}}

    def p(key, lang):
        n, v = sum(count[key][t] for t in kept[lang]), len(kept[lang])
        return [1 + 1_000_000_000 * (count[key][t] + 2) // (n + 2 * v) for t in kept[lang]]

    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in groups:
        own, whole = p((lang, source), lang), p(lang, lang)
        pairs = [(sum(map(f, own, p((lang, s), lang))), s) for g, s in groups if g == lang and s != source]
        each = [(f(a, b), t) for t, a, b in zip(kept[lang], own, whole) if count[lang, source][t] and a > b]
        for part, values, most in (("pair", pairs, None), ("term", each, 10)):
            values.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, k) for k, (v, item) in enumerate(values[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [10, 3, 10_000])
def test_equals_brute_force(spark, least):
    rows = corpus()
    got = S.audit(spark.createDataFrame(rows, SCHEMA).repartition(4), least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least)


def test_equals_sql(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.execute(S.SQL).fetchall()) == sorted(map(tuple, S.audit(docs).collect()))


def test_empty_tables_and_one_group(spark):
    assert S.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    assert S.audit(spark.createDataFrame([(1, "a", "en", "s", 1, 0.0, "")], SCHEMA)).collect() == []


def test_no_step_leaves_64_bits(spark):
    n = 9 * 10**15
    rows = [(0, n, 1), (n, n, 10), (123456789012345, 123456789012345678 // 20, 4), (7, 20, 3)]
    d = spark.createDataFrame(rows, "c long, n long, v long")
    got = [r[0] for r in d.select(S.probability(d.c, d.n, d.v)).collect()]
    assert got == [1 + 10**9 * (c + 2) // (m + 2 * v) for c, m, v in rows]


def test_a_task_hands_on_what_it_holds(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(S, "TASK_TERMS", 50)
    from pyspark.sql import functions as F

    d = S.term_counts(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    got = d.where("term IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"), F.count_distinct("source", "term").alias("k")).collect()
    want = defaultdict(int)
    for _, t, lang, *_ in rows:
        want[lang or ""] += len(TERM.findall(t or ""))
    assert {r.lang: r.n for r in got} == {k: v for k, v in want.items() if v}
