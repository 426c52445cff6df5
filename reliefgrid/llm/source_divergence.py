"""Source divergence audit: how far the sources of a language differ in their use of its terms, and in which terms most.

Each language keeps the terms of at least `least` of its documents. A group is a language and a source. With c the term's
occurrences in a group, N those of all kept terms there and V their number, p = 1 + floor(UNIT * (c + 2) / (N + 2 V)); the
same for the whole language. f(p, q) = floor((p - q)^2 / (p + q)). All in whole numbers.

The divergence of two groups A and B is the sum of f over all kept terms. No row is made for a term that neither has:

    sum over A of f(p(c), q(0))  +  sum over B of f(p(0), q(c))  +  (V - |A| - |B|) f(p(0), q(0))
      +  sum over terms of both of  f(p(c), q(d)) - f(p(c), q(0)) - f(p(0), q(d)) + f(p(0), q(0))

1. Documents are cut into terms; a task adds up (language, source, term): occurrences and documents.
2. One-sided terms need only how many terms of a group have each count: a histogram per group, met with the zero values of the
   language's other groups. Its rows grow with the distinct counts, about the square root of the terms' number.
3. Terms of both groups are met by joining postings, a row for each group and term, on (language, term): a language's source
   pairs are what is asked for, each once, and sums are taken within the task first.

The result has a row for each pair of sources of a language by definition. Nothing is broadcast that Spark hasn't measured.

Nulls: a null text, lang or source counts as ''. A group without terms has c = 0 throughout; a language that keeps no term
has value 0 in all pairs. doc_id is not read: each row is a document. Ties in value rank by item. An empty table gives an
empty table. Other columns are not read. Texts are never cut. Whole numbers hold for up to 9 * 10^15 occurrences of a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.common import chunks, materialize
from reliefgrid.operators.keys import top_by

#: Bytes that end a term are those of ASCII but the letters; A-Z become a-z, all others stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNIT = 1_000_000_000
#: Distinct (language, source, term) that a task adds up before it hands them on.
TASK_TERMS = 1 << 18
RANKS = 10


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it), added up by task; a row with a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in held.items():
                k = len(n) + 1
                columns = [pa.array([*n, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(of.__getitem__, n), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), *columns], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in chunks(batches):
            for t, *group in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "source")], strict=True):
                n, of = held.setdefault(tuple(group), (Counter(), Counter()))
                before, found = len(n), terms(t)
                n.update(found)
                of.update(set(found))
                size += len(n) - before + (before == 0)
                if size > TASK_TERMS:
                    yield from out()
                    size = 0
        yield from out()

    d = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    return d.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (c + 2) / (n + 2 v)), by long division in steps of 1000, so that nothing leaves 64 bits."""
    d, q, r = n + 2 * v, F.lit(0).cast("long"), c + 2
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + _div(r, d), r % d
    return q + 1


def _div(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers that aren't negative."""
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its divergence from each other source of its language (`pair`), and
    the `ranks` terms that it has oftenest against its language (`term`: the divergence of its p from the language's)."""
    counts = materialize(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = counts.where("term IS NULL").select("lang", "source")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    posted = materialize(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]))
    sizes = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("held"))
    whole = kept.groupBy("lang").agg(F.count("term").alias("v"), F.sum("lang_n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.join(whole, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = groups.select("lang", "source", zero("v"), zero("lang_total"), zero("total"), zero("held"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.col("v")))))
    p = probability(F.col("n"), F.col("total"), F.col("v"))
    held = materialize(posted.join(groups.select("lang", "source", "v", "total", "lang_total", "p0"), ["lang", "source"]).withColumn("p", p))

    # one side alone, by the counts' histogram: p depends on the group's count only
    histogram = held.groupBy("lang", "source", "p").agg(F.count("term").alias("times"))
    of = lambda d, s, *cols: d.select("lang", *[F.col(c).alias(f"{s}_{c}") for c in cols])
    l = of(histogram, "l", "source", "p", "times")
    one = l.join(of(groups, "r", "source", "p0"), "lang").where("l_source <> r_source")
    one = one.groupBy("lang", "l_source", "r_source").agg(F.sum(F.col("l_times") * divergence(F.col("l_p"), F.col("r_p0"))).alias("value"))
    one = one.select("lang", F.least("l_source", "r_source").alias("a"), F.greatest("l_source", "r_source").alias("b"), "value")
    # neither side; a language that keeps no term has nothing to add
    none = of(groups, "l", "source", "v", "held", "p0").join(of(groups, "r", "source", "held", "p0"), "lang").where("l_source < r_source")
    rest = (F.col("l_v") - F.col("l_held") - F.col("r_held")) * divergence(F.col("l_p0"), F.col("r_p0"))
    none = none.select("lang", F.col("l_source").alias("a"), F.col("r_source").alias("b"), F.coalesce(rest, F.lit(0).cast("long")).alias("value"))
    # both sides: what the terms above priced twice, and wrongly
    side = lambda s: held.select("lang", "term", *[F.col(c).alias(f"{s}_{c}") for c in ("source", "p", "p0")])
    both = side("l").join(side("r"), ["lang", "term"]).where("l_source < r_source")
    f = lambda x, y: divergence(F.col(f"l_{x}"), F.col(f"r_{y}"))
    both = both.groupBy("lang", F.col("l_source").alias("a"), F.col("r_source").alias("b")).agg(F.sum(f("p", "p") - f("p", "p0") - f("p0", "p") + f("p0", "p0")).alias("value"))
    pair = materialize(one.union(none).union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    way = lambda x, y: pair.select("lang", F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), "value")
    order = [F.desc("value"), F.asc("item")]
    pairs = way("a", "b").union(way("b", "a")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    own = held.withColumn("q", probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return pairs.union(top_by(own, ["lang", "source"], order, ranks, "rank"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
each AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM each GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT e.lang, e.source, e.term, count(*) AS c FROM each e JOIN kept k USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c, k.c AS lang_c FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sized AS (
  SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, count(*) OVER (PARTITION BY lang, source) AS v, sum(lang_c) OVER (PARTITION BY lang, source) AS lang_n FROM dense),
priced AS (
  SELECT lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 2) // (n + 2 * v) AS p, 1 + 1000000000::HUGEINT * (lang_c + 2) // (lang_n + 2 * v) AS q FROM sized),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM priced WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM own))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
