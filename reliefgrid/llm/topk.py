"""Exact top-k inner-product search in three phases with one uniform threshold.

A score is the sum of LISTS partial scores, over as many slices of the components. Slices live apart: a slice's vectors and
queries are dealt into blocks of their own, and a pair of a query block and a vector block of one slice is one task's work. No
task sees a vector's other slices until phase 3.

1. Each pair gathers, for every query, its list's k best vectors by partial score, and the least and largest partial score.
   A vector's partial scores that are known, with the list's least score where none is, bound its score from below; of the
   SURE * k vectors with the best bounds the scores are completed, and the k-th best of these is a safe cutoff: the query's k-th
   best score is no less.
2. The cutoffs go to the pairs. A score of at least the cutoff has a partial score of at least cutoff / LISTS in some list:
   each pair sends the entries that reach this uniform threshold, and that could reach the cutoff with the other lists'
   largest scores. That suffices.
3. A vector that wasn't sent by a list has less than cutoff / LISTS there. Vectors that can't reach the cutoff so go; of the
   rest the missing partial scores are looked up and worked out exactly, those below the cutoff go, and the first k by
   (score, vec_id) are taken.

Components are integers, and blocks are multiplied in the narrowest floating type that holds every score exactly, else
in 64-bit integers. Nulls: vectors that are null or hold null or non-finite components, and rows without an id, take no
part. Shorter vectors count as filled up with zeros. Ties go to the smaller vec_id. A query's own row is every row with
its vec_id. Rows that repeat a vec_id with equal components count once; with other components they are vectors of their own,
of which the first by components counts. Fewer than k candidates: all are returned. An empty table gives an empty table.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.common import materialize

LISTS = 2
BLOCK = 4096
#: Vectors, times k, whose scores are completed for the cutoff.
SURE = 4


def integer_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id (each once), v: components floor(scale * x), x as double."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _packed(rows: DataFrame, key: str, dim: int, cut: bool = False) -> DataFrame:
    """One row for each slice and value of key: its ids, components and, with cut, thresholds, as bytes. Keys hold about BLOCK rows."""

    def pack(table: pa.Table) -> pa.Table:
        n = table.num_rows
        v = table.column("v").combine_chunks()
        size = np.diff(v.offsets.to_numpy())
        m = np.zeros((n, dim), np.int64)
        m[np.arange(dim) < size[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
        wide = m.astype(np.int16) if not m.size or np.abs(m).max() < 1 << 15 else m
        out = {"lst": table.column("lst")[:1], key: table.column(key)[:1], f"{key}_ids": [table.column("vec_id").to_numpy().tobytes()], f"{key}_m": [wide.tobytes()]}
        if cut:
            out[f"{key}_cut"] = [table.column("least").to_pandas().to_numpy(np.float64, na_value=-np.inf).tobytes()]
        return pa.table(out)

    return rows.groupBy("lst", key).applyInArrow(pack, f"lst int, {key} int, {key}_ids binary, {key}_m binary" + f", {key}_cut binary" * cut)


def _partial(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids, and the slice's partial scores."""
    q, v = (np.frombuffer(row[f"{k}_ids"], np.int64) for k in "qv")
    a, b = (np.frombuffer(row[f"{k}_m"], np.int16 if len(row[f"{k}_m"]) == 2 * dim * len(x) else np.int64).reshape(len(x), dim) for k, x in (("q", q), ("v", v)))
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
    return q, v, a.astype(kind) @ b.astype(kind).T


def _heads(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, lst, low, high, ids, partials: the k best of a block in one list, and its extremes; the query's own row left out."""
    for batch in batches:
        for row in batch.to_pylist():
            q, v, p = _partial(row, dim)
            other = q[:, None] != v
            q, p, other = (x[other.any(1)] for x in (q, p, other))
            if not len(q):
                continue
            big = np.array(np.inf if p.dtype.kind == "f" else np.iinfo(p.dtype).max, p.dtype)
            low, high = np.where(other, p, big).min(1), np.where(other, p, -big).max(1)
            best = np.argpartition(-np.where(other, p, -big), min(k, len(v)) - 1, 1)[:, :k]
            line = np.arange(len(q))[:, None]
            held = other[line, best]
            size = np.append(0, np.cumsum(held.sum(1))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(size), pa.array(x[held])) for x in (v[best], p[line, best].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array([row["lst"]] * len(q), pa.int32()), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64)), *lists], ["query_id", "lst", "low", "high", "ids", "partials"])


def _sent(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, lst, p: the entries of a list that reach the query's threshold there."""
    for batch in batches:
        for row in batch.to_pylist():
            q, v, p = _partial(row, dim)
            i, j = np.nonzero((p >= np.frombuffer(row["q_cut"], np.float64)[:, None]) & (q[:, None] != v))
            yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(v[j]), pa.array([row["lst"]] * len(i), pa.int32()), pa.array(p[i, j].astype(np.int64))], ["query_id", "vec_id", "lst", "p"])


def _resolved(known: DataFrame, slices: DataFrame) -> DataFrame:
    """known (query_id, vec_id, known, missing) with `score`: the missing lists' partial scores are looked up and added."""
    ask = known.where(F.size("missing") > 0).select("query_id", "vec_id", F.explode("missing").alias("lst"))
    own = slices.select(F.col("vec_id").alias("query_id"), "lst", F.col("v").alias("qv"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    found = ask.join(slices, ["vec_id", "lst"]).join(own, ["query_id", "lst"]).groupBy("query_id", "vec_id").agg(F.sum(dot).alias("rest"))
    return known.join(found, ["query_id", "vec_id"], "left").withColumn("score", F.col("known") + F.coalesce("rest", F.lit(0).cast("long")))


def _missing() -> Column:
    return F.array_except(F.array(*[F.lit(j) for j in range(LISTS)]), F.collect_set("lst")).alias("missing")


def _cutoffs(heads: DataFrame, slices: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, cutoff), without queries that have fewer than k candidates, and (query_id, lst, low, high)."""
    ends = heads.groupBy("query_id", "lst").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    known = heads.select("query_id", "lst", F.explode(F.arrays_zip("ids", "partials")).alias("x")).select("query_id", "lst", F.col("x.ids").alias("vec_id"), F.col("x.partials").alias("p"))
    bounds = known.join(ends, ["query_id", "lst"]).groupBy("query_id", "vec_id").agg(F.sum(F.col("p") - F.col("low")).alias("over"), F.sum("p").alias("known"), _missing())
    first = lambda d, by, m: d.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id"))).where(F.col("place") <= m)
    exact = _resolved(first(bounds, "over", SURE * k).select("query_id", "vec_id", "known", "missing"), slices)
    kth = first(exact, "score", k).groupBy("query_id").agg(F.count("score").alias("n"), F.min("score").alias("cutoff"))
    return kth.where(F.col("n") == k).select("query_id", "cutoff"), ends


def sent_entries(vectors: DataFrame, queries: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phases 1 and 2: (query_id, vec_id, lst, p), the slices (vec_id, lst, v) of all vectors and queries, and the cutoffs."""
    n, dim = vectors.agg(F.count("vec_id"), F.max(F.size("v"))).first()
    dim = max(dim or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    wide = max(1, math.ceil(dim / LISTS))
    q_shards, v_shards = max(1, math.ceil(queries.count() / BLOCK)), max(1, math.ceil(n / BLOCK))
    shard = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    spread = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    sliced = lambda d: d.select("vec_id", F.posexplode(F.array(*[F.slice("v", 1 + k * wide, wide) for k in range(LISTS)])).alias("lst", "v"))
    blocks = _packed(sliced(vectors).withColumn("vb", shard(v_shards)), "vb", wide)
    blocks = blocks.select("lst", "vb", F.col("vb_ids").alias("v_ids"), F.col("vb_m").alias("v_m"), spread(q_shards, "qb"))

    def pairs(least: DataFrame | None) -> DataFrame:
        q = sliced(queries).withColumn("qb", shard(q_shards))
        if least is not None:
            q = q.join(least.withColumnRenamed("query_id", "vec_id"), ["vec_id", "lst"], "left")
        q = _packed(q, "qb", wide, least is not None)
        held = [F.col(f"qb_{x}").alias(f"q_{x}") for x in ("ids", "m", "cut")[: 2 + (least is not None)]]
        return blocks.join(q.select("lst", "qb", *held, spread(v_shards, "vb")), ["lst", "qb", "vb"]).drop("qb", "vb")

    heads = materialize(pairs(None).mapInArrow(lambda b: _heads(b, wide, k), "query_id long, lst int, low long, high long, ids array<long>, partials array<long>"))
    slices = sliced(vectors.union(queries).distinct())
    cutoffs, ends = _cutoffs(heads, slices, k)
    top = ends.groupBy("query_id").agg(F.sum("high").alias("top"))
    least = ends.join(top, "query_id").join(cutoffs, "query_id").select("query_id", "lst", F.greatest(F.col("cutoff") / LISTS, F.col("cutoff") - (F.col("top") - F.col("high"))).cast("double").alias("least"), "cutoff", "high")
    least = materialize(least)
    sent = pairs(least.select("query_id", "lst", "least")).mapInArrow(lambda b: _sent(b, wide), "query_id long, vec_id long, lst int, p long")
    return materialize(sent), slices, least


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query. Both tables: vec_id (each once), v (array of long)."""
    sent, slices, least = sent_entries(vectors, queries, k)
    known = sent.groupBy("query_id", "vec_id").agg(F.sum("p").alias("known"), _missing())
    # what a list didn't send is below its threshold there, and no more than its largest score
    most = least.groupBy("query_id").agg(F.first("cutoff").alias("cutoff"), F.map_from_entries(F.collect_list(F.struct("lst", F.least("least", F.col("high").cast("double")).alias("m")))).alias("most"))
    known = known.join(most, "query_id", "left")
    reach = F.col("known") + F.aggregate("missing", F.lit(0.0), lambda s, j: s + F.col("most")[j])
    known = known.where(F.col("cutoff").isNull() | (F.size("missing") == 0) | (reach >= F.col("cutoff")))
    full = _resolved(known, slices)
    full = full.where(F.col("cutoff").isNull() | (F.col("score") >= F.col("cutoff")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
