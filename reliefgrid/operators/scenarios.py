"""Bounded demand scenarios from outage snapshots and population cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.nulls import guarded, null_clip, null_min, safe_ratio
from reliefgrid.functions.stats import weighted_quantile

# Litres a person and day.
DEMAND_LEVELS = (("minimum", 3.0), ("basic", 10.0), ("extended", 20.0))


def parameters(rows: DataFrame, name: str) -> DataFrame:
    """(level, value) of a parameter table whose values are text; texts that are no numbers are an error."""
    got = rows.where(F.col("name") == name).select("level", F.col("value").try_cast("double").alias("value"))
    if not got.where("value IS NULL").isEmpty():
        raise ValueError(f"{name} has values that are not numbers")
    return got


# Fixed output values: the statuses of `outage_status`, and the three cases of `demand_scenarios`.


def outage_status(observed: Column, ratio: Column, households: Column, known: Column) -> Column:
    """The later rule wins: capped, positive, zero, assumed zero, unmatched."""
    return (
        F.when(~known, "unmatched_geography").when(observed.isNull(), "assumed_zero_no_official_outage_listing")
        .when(observed > households, "reported_positive_ratio_capped").when(observed > 0, "reported_positive").otherwise("reported_zero")
    )


def household_outages(units: DataFrame, outages: DataFrame, group: str) -> DataFrame:
    """units (group, people, households) with group totals, shares, outage ratio and status; outages: (group, out), latest."""
    d = units.join(outages.withColumnRenamed("out", "observed"), group, "left")
    totals = units.groupBy(F.col(group).alias("group_")).agg(F.sum("households").alias("group_households"))  # no window: a group of any size is summed in all tasks
    d = d.join(totals, F.col(group).eqNullSafe(F.col("group_")), "left").drop("group_")
    d = d.withColumn("share", F.when(F.col(group).isNotNull(), safe_ratio("households", "group_households")))
    out = F.when(F.col(group).isNotNull(), F.coalesce("observed", F.lit(0.0)))
    d = d.withColumn("out", out).withColumn("ratio", null_clip(safe_ratio("out", "group_households"), 0.0, 1.0))
    return d.withColumn("status", outage_status(F.col("observed"), F.col("ratio"), F.col("group_households"), F.col(group).isNotNull()))


def scenario_rows(d: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """`household_outages` rows, nine each: three bounds of the people affected x three demand levels (litres a person), exploded in
    place. columns: which of d's stay."""
    sized = d.where(F.col("households") > 0).withColumn("size_", F.col("people") / F.col("households"))
    p90 = weighted_quantile(sized.where(F.col(group).isNotNull()), [group], "size_", "households", 0.9, "p90")
    d = d.join(p90, group, "left").withColumn("h", guarded(lambda a, b: a * b, "out", "share"))
    cases = [("lower_one_person_per_household", null_min("people", "h")), ("proportional_central", guarded(lambda a, b: a * b, "people", "ratio")), ("upper_p90_household_size", null_min("people", F.col("h") * F.col("p90")))]
    grid = F.array(*[F.struct(F.lit(c).alias("population_case"), p.alias("affected"), F.lit(n).alias("demand_case"), F.lit(q).alias("litres"), (p * q).alias("demand")) for c, p in cases for n, q in DEMAND_LEVELS])
    return d.select(*columns, F.explode(grid).alias("x")).select(*columns, "x.*")


def demand_scenarios(units: DataFrame, outages: DataFrame, group: str, unit: str) -> DataFrame:
    """Nine rows a unit, as `scenario_rows`."""
    return scenario_rows(household_outages(units, outages, group), group, [unit, group, "status"]).drop("litres")


def roll_up(scenarios: DataFrame, group: str) -> DataFrame:
    """Sums by group and case; a null group stays, sums of nothing are 0, demand of nothing null. The status is that of the
    group's first unit (by the column `unit`)."""
    return scenarios.groupBy(group, "population_case", "demand_case").agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum("affected"), F.lit(0.0)).alias("affected"), F.sum("demand").alias("demand"), F.min_by("status", "unit").alias("status"))
