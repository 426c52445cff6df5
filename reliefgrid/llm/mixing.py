"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums.

Each document gets the MD5 of a seed and its id as key. The key's first hexadecimal digits split every source into
equal key ranges, so that a hot source is dealt over as many tasks as its size asks for; range totals are summed over
each source (one row a range), and a running sum within a range completes the prefix sum of words before a document.
The cut is exact: whole epochs first, then the documents in key order up to the budget, of the last one a part.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null id is hashed as 'null'.
Rows that repeat a doc_id are documents of their own; ties of the key go by doc_id, then size. An empty table gives
an empty table. Columns beyond doc_id, text and source are not read; `mixed_documents` passes them on, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.common import WORD


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """For each (no_source, src) of sizes: source_size and target. One row a source passes through the ordering window.

    Water filling: sources are capped in order of cap / weight; the level is that of the first source that needs no cap.
    """
    by_name, by_ratio = Window.orderBy("no_source", "src"), Window.orderBy("ratio", "no_source", "src")
    every = Window.partitionBy()
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("weight", F.element_at(wheel, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("place", F.row_number().over(by_ratio))
    t = t.withColumn("level", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    free = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(every)
    return t.select("no_source", "src", "source_size", F.coalesce(F.least("cap", F.col("weight") * free["level"]), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix", keep: bool = False, range_rows: int = 65_536) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs; with keep, after all columns of docs."""
    n = docs.select("source").count()
    digits = max(1, math.ceil(math.log(max(n, 1) / range_rows, 16)))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    put = {"size": size, "no_source": F.col("source").isNull(), "src": F.coalesce("source", F.lit("")), "mix_key": key, "mix_range": F.substring(key, 1, digits)}
    own = [c for c in docs.columns if c not in put] if keep else ["doc_id", "source"]
    sized = docs.select(*own, *[v.alias(k) for k, v in put.items()]).repartition("no_source", "src", "mix_range")
    ranges = sized.groupBy("no_source", "src", "mix_range").agg(F.sum("size").alias("size"))
    up_to = Window.partitionBy("no_source", "src").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("no_source", "src", "mix_range", F.coalesce(F.sum("size").over(up_to), F.lit(0)).alias("range_start"))
    starts = starts.join(source_targets(ranges, weights, share, epochs), ["no_source", "src"])
    within = Window.partitionBy("no_source", "src", "mix_range").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["no_source", "src", "mix_range"])
    budget = F.floor("target")
    whole = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0))
    rest = budget - whole * F.col("source_size") - F.col("range_start") - F.col("within")
    taken = (whole * F.col("size") + F.least("size", F.greatest(rest, F.lit(0)))).cast("long")
    return out.select(*own, "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, same columns: each whole epoch is a row, and the part that the exact cut leaves of a
    document is its first words, joined by a space. Documents without words, of which nothing can be taken, go."""
    d = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("doc"))
    m = mix_sources(d, keep=True, **options).where("taken > 0")
    takes = F.concat(F.array_repeat("size", F.floor(F.col("taken") / F.col("size")).cast("int")), F.array((F.col("taken") % F.col("size")).cast("long")))
    m = m.withColumn("take", F.explode(F.filter(takes, lambda x: x > 0)))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("take").cast("int")), " ")
    m = m.withColumn("text", F.when(F.col("take") < F.col("size"), part).otherwise(F.col("text")))
    put = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return m.select(*[(put[c] if c in put else F.col("doc").getField(c)).alias(c) for c in docs.columns])


SQL = """
WITH sized AS (
  SELECT doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS mix_key
  FROM documents),
totals AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1)] AS weight FROM totals),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM weighed),
levels AS (
  SELECT *, row_number() OVER (ORDER BY ratio, no_source, src) AS place,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM capped),
targets AS (
  SELECT no_source, src, source_size,
    coalesce(least(cap, weight * (SELECT arg_min(level, place) FROM levels WHERE ratio >= level)), cap) AS target FROM levels),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY no_source, src ORDER BY mix_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized JOIN targets USING (no_source, src))
SELECT doc_id, size, source_size, round(target, 3) AS target,
  (coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) * size
   + least(size, greatest(0, floor(target)::BIGINT - coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) * source_size - before)))::BIGINT AS taken
FROM placed
"""
