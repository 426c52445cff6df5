"""Row choice by key: unique keys, first and top rows, latest snapshots, audits of keys and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from reliefgrid.functions.formats import markdown_cell
from reliefgrid.sources.storage import checkpoint, stored


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error if two of its rows agree in all keys."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {keys} are not unique")
    return df


def assert_complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """df, or an error if a column has nulls."""
    if any(df.agg(*[F.count_if(F.col(c).isNull()) for c in cols]).first()):
        raise ValueError(f"nulls in {cols}")
    return df


def top_by(df: DataFrame, keys: list[str], order: list[Column | str], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; order has to end in a unique column. Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank or "rank_", F.row_number().over(w)).where(F.col(rank or "rank_") <= k)
    return out if rank else out.drop("rank_")


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the rows' numbers 1, 2, ... in order, which has to be unique: a range sort, and offsets from its partitions' counts."""
    at = F.monotonically_increasing_id()
    held = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).alias("part_"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at_")))
    count = held.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = count.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))  # one row a partition
    return held.join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "before_")


def latest_snapshot(df: DataFrame, keys: list[str], time: str, tie: list[str]) -> DataFrame:
    """Of the globally latest time, the last row of each key that isn't null."""
    at = df.agg(F.max(time).alias("latest_"))
    last = df.join(F.broadcast(at), F.col(time) == F.col("latest_")).drop("latest_")
    for c in keys:
        last = last.where(F.col(c).isNotNull())
    return top_by(last, keys, [F.desc(c) for c in tie])


def column_profile(df: DataFrame) -> DataFrame:
    """column_name, non_null, null_pct for each column: one aggregation, then unpivoted."""
    one = df.agg(F.count(F.lit(1)).alias("rows_"), *[F.count(c).alias(c) for c in df.columns])
    out = one.unpivot("rows_", df.columns, "column_name", "non_null")
    return out.select("column_name", "non_null", F.round(F.try_divide((F.col("rows_") - F.col("non_null")) * 100.0, F.col("rows_")), 4).alias("null_pct"))


def column_samples(df: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """column_name, type, non_null, null_pct, samples: each column's type in Spark's words, how much of it is null (percent, two digits)
    and its first k values that aren't null, by the rows' order, which has to be unique (such as a file and its row index), joined by
    a comma. Binary values aren't shown; texts are made cells of a table. Columns of `order` whose names begin with an
    underscore aren't profiled. A table without rows has no percentage, a column without values an empty sample.

    Each sample is an aggregation of its own over the values after the one before, so that no task holds more than a row.
    """
    names = [c for c in df.columns if not (c in order and c.startswith("_"))]
    kinds = {c: df.schema[c].dataType for c in names}
    at = F.struct(*order)

    def shown(c: str) -> Column:
        return F.lit("<binary>") if kinds[c] == BinaryType() else markdown_cell(F.col(c).cast("string"))

    first, found = None, []
    for _ in range(k):
        later = (lambda c: F.col(c).isNotNull()) if first is None else (lambda c: F.col(c).isNotNull() & (at > F.col(f"s_.{c}.at")))
        d = df if first is None else df.join(F.broadcast(first))
        first = stored(d.agg(*[F.min(F.when(later(c), F.struct(at.alias("at"), shown(c).alias("text")))).alias(c) for c in names]).select(F.struct(*names).alias("s_")))
        found.append(first.select(F.struct(*[F.col(f"s_.{c}.text").alias(c) for c in names]).alias(f"s{len(found)}_")))
    one = df.agg(F.count(F.lit(1)).alias("rows_"), *[F.count(c).alias(c) for c in names])
    for d in found:
        one = one.join(F.broadcast(d))
    row = lambda c: F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c].simpleString()).alias("type"), F.col(c).alias("non_null"), F.round(F.try_divide((F.col("rows_") - F.col(c)) * 100.0, F.col("rows_")), 2).alias("null_pct"), F.concat_ws(", ", *[F.col(f"s{n}_.{c}") for n in range(k)]).alias("samples"))
    return one.select(F.inline(F.array(*[row(c) for c in names])))


def transpose(df: DataFrame, name: str, columns: list[str], values: list[str]) -> DataFrame:
    """Indicators as rows, the listed values of `name` as columns."""
    return df.unpivot(name, columns, "indicator", "value").groupBy("indicator").pivot(name, values).agg(F.first("value"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, with all rows of the keys that new has replaced by new's."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def signature(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the number of rows and an order-free digest, the sum of 60 bits of the SHA-256 of each row's canonical JSON; rows
    that repeat count as often as they stand there."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def agreement(first: dict[str, tuple[DataFrame, list[str]]], again: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """part, n, digest, n_again, digest_again, agrees: for each named part of a result (its table, and the columns that make it) the
    signatures of two runs, which agree if both are the same. A part that one run lacks doesn't agree."""
    def signed(parts: dict[str, tuple[DataFrame, list[str]]], end: str) -> DataFrame:
        each = [signature(d, cols).select(F.lit(p).alias("part"), F.col("n").alias(f"n{end}"), F.col("digest").alias(f"digest{end}")) for p, (d, cols) in parts.items()]
        return reduce(DataFrame.unionByName, each)

    d = signed(first, "").join(signed(again, "_again"), "part", "full_outer")
    return d.withColumn("agrees", F.coalesce((F.col("n") == F.col("n_again")) & (F.col("digest") == F.col("digest_again")), F.lit(False)))
