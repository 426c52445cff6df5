"""Result tables: chains of joins, overrides, dissolved areas, inventories, ordinal sorts and checks of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.operators.keys import number_rows, top_by

# The distances of access, in metres, that may be used.
APPROVED_THRESHOLDS = (250.0, 500.0, 1000.0)


def single_value(df: DataFrame, c: str):
    """The one value that all rows share; an error if there are several, or none."""
    got = df.agg(F.min(c), F.max(c), F.count_if(F.col(c).isNull())).first()
    if got[0] is None or got[0] != got[1] or got[2]:
        raise ValueError(f"{c} has no single value")
    return got[0]


def approved(thresholds: list[float]) -> list[float]:
    if sorted(thresholds) != sorted(APPROVED_THRESHOLDS):
        raise ValueError(f"thresholds other than {APPROVED_THRESHOLDS}")
    return sorted(thresholds)


def municipal_table(rolled: DataFrame, latest: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Rolled-up rows with the latest report of their municipality (report, status_time, tanker columns) and its area. Where
    there is no report the roll-up's snapshot_time stands in. Every row stays."""
    d = rolled.join(latest, key, "left").join(areas, key, "left")
    return d.withColumn("status_time", F.coalesce("status_time", "snapshot_time"))


def positive_panel(rolled: DataFrame, key: str, cases: list[str], main: str) -> DataFrame:
    """key, people by case (one column each), ratio and status of the municipalities with people affected in the main case."""
    by_case = rolled.groupBy(key).pivot("population_case", cases).agg(F.first("affected"))
    return by_case.where(F.col(main) > 0).join(rolled.groupBy(key).agg(F.max("ratio").alias("ratio"), F.max("status").alias("status")), key)


def panel_summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: how many values are known, positive, zero and unknown, and their sum."""
    v = F.col(value)
    return rows.agg(F.count(v).alias("known"), F.count_if(v > 0).alias("positive"), F.count_if(v == 0).alias("zero"), F.count_if(v.isNull()).alias("unknown"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"))


def with_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str], values: list[str], status: str, label: str) -> DataFrame:
    """rows whose values are null with those of the override of their keys, and `label` as status; a row that still has none is an
    error when it is read."""
    o = overrides.select(*keys, *[F.col(v).alias(f"{v}_new") for v in values])
    missing = F.col(values[0]).isNull()
    d = rows.join(o, keys, "left")
    open_ = missing & F.col(f"{values[0]}_new").isNull()
    ok = F.when(~open_, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no override for "), F.concat_ws(", ", *keys))).cast("boolean"))
    out = {v: F.when(missing, F.col(f"{v}_new")).otherwise(F.col(v)) for v in values} | {status: F.when(missing, F.lit(label)).otherwise(F.col(status))}
    return d.where(ok).select(*[(out[c] if c in out else F.col(c)).alias(c) for c in rows.columns])


def group_access(groups: DataFrame, access: DataFrame, meshes: DataFrame, group: str) -> DataFrame:
    """groups with their access (one row each, or the group goes) and the values of their representative mesh (nulls without)."""
    return groups.join(access, group).join(meshes, F.col("representative") == F.col("mesh"), "left").drop("mesh")


def base_edges(bases: DataFrame, edges: DataFrame) -> DataFrame:
    """bases with the ends and weights of their access edge; a base whose edge isn't in the network goes."""
    return bases.join(edges, "edge_id")


def complete_by_unit(units: DataFrame, rows: DataFrame, unit: str, values: list[str]) -> DataFrame:
    """Each unit's row, of several the first by the values in turn; a unit without one, or with a null among the values, is an error
    when it is read."""
    d = units.select(unit).join(top_by(rows, [unit], [F.asc_nulls_last(v) for v in values]), unit, "left")
    gap = F.greatest(*[F.col(v).isNull().cast("int") for v in values]) if len(values) > 1 else F.col(values[0]).isNull().cast("int")
    return d.where(F.when(gap == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no values for "), F.col(unit).cast("string"))).cast("boolean")))


def dissolve(areas: DataFrame, key: str, geometry: str) -> DataFrame:
    """key, parts (how many areas), geometry: the areas' rings as one multi-part geometry. A point lies in it if it lies in a part."""
    return areas.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_list(geometry)).alias(geometry))


def total_bounds(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def feature_inventory(features: DataFrame, by: list[str]) -> DataFrame:
    """Features (properties: map, geometry: JSON) by layer: their number, property names, geometry types and colours."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("properties")))))
    value = lambda c: F.array_sort(F.collect_set(c))
    return features.groupBy(*by).agg(F.count(F.lit(1)).alias("features"), names.alias("names"), value(F.get_json_object("geometry", "$.type")).alias("types"), value(F.col("properties")["color"]).alias("colours"))


def status_counts(df: DataFrame, status: str, labels: list[str]) -> DataFrame:
    """One row with how many rows have each label, and how many another or none."""
    c = F.col(status)
    return df.agg(*[F.count_if(c == x).alias(x) for x in labels], F.count_if(~F.coalesce(c.isin(labels), F.lit(False))).alias("other"))


def order_breaks(df: DataFrame, keys: list[str], order: str, value: str, slack: float = 1e-9) -> DataFrame:
    """keys, breaks: how often a value is lower than the one before it; 0 where values never fall."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("fall_", (F.col(value) < before - slack)).groupBy(*keys).agg(F.count_if("fall_").alias("breaks"))


def sequential_ids(df: DataFrame, order: list[str], prefix: str, name: str) -> DataFrame:
    """df with ids such as RR-000001 in order, which has to be unique."""
    return number_rows(df, order, "no_").withColumn(name, F.format_string(f"{prefix}-%06d", "no_")).drop("no_")


def ordinal(c: Column, labels: list[str]) -> Column:
    """The place of a label in a fixed order, for sorting; what isn't listed comes last."""
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in enumerate(labels) for x in (v, k)])[c], F.lit(len(labels)))


def ascii_names(df: DataFrame) -> DataFrame:
    """df, or an error if a column's name has characters beyond ASCII."""
    if bad := [c for c in df.columns if not c.isascii()]:
        raise ValueError(f"names beyond ASCII: {bad}")
    return df
