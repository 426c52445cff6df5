"""Municipalities: demand of cells rolled up with all that it carries, the latest report of each municipality, and the table of those
that reported outages.

Cells without a municipality are kept as one of their own, with a null code and name, through all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.keys import latest_snapshot, number_rows
from reliefgrid.operators.scenarios import household_outages, scenario_rows

#: Vehicles of a report: all, and those of each operator.
TANKERS = ("tankers", "tankers_ministry", "tankers_waterworks", "tankers_defence")
#: What a municipality's rows may differ by, relatively, and still be taken for one value: sums in another order.
AGREE = 1e-9

# Fixed output values: the cases that make the columns of `positive_table`, and the status that it takes.
PEOPLE = (("lower_one_person_per_household", "people_lower"), ("proportional_central", "people_central"), ("upper_p90_household_size", "people_upper"))
WATER = (("minimum", "water_minimum"), ("basic", "water_basic"), ("extended", "water_extended"))
CENTRAL, POSITIVE = "proportional_central", "reported_positive"


def latest_reports(reports: DataFrame, crosswalk: DataFrame, unit: list[str], tie: list[str] = []) -> DataFrame:  # noqa: B006
    """code, report, status_time, most, out and the vehicles: each municipality's last row (by report, then `tie`) of the latest time that
    a matched report has. reports: (*unit, report, status_time, most, out, *TANKERS); crosswalk: (*unit, code, match_status), a row
    a unit. Units that aren't matched exactly take no part, not even in what is latest; without any match there is no row."""
    mapped = reports.join(crosswalk.where("match_status = 'exact'").select(*unit, "code"), unit)
    return latest_snapshot(mapped, ["code"], "status_time", ["report", *tie]).select("code", "report", "status_time", "most", "out", *TANKERS)


def cell_scenarios(cells: DataFrame, latest: DataFrame) -> DataFrame:
    """Nine rows for each cell (unit, code, name, people, households), with all that the roll-up needs: the municipality's reported
    households, their time, ratio and status. A municipality without a report has 0, as of the latest report; a cell without a
    municipality has nulls."""
    d = household_outages(cells, latest.select("code", "out", F.col("status_time").alias("snapshot_time")), "code")
    top = latest.agg(F.max("status_time").alias("top_"))  # one row
    at = F.when(F.col("code").isNotNull(), F.coalesce("snapshot_time", "top_"))
    d = d.join(F.broadcast(top)).withColumn("snapshot_time", at).drop("top_")
    return scenario_rows(d, "code", ["unit", "code", "name", "people", "households", "snapshot_time", "out", "ratio", "status"])


def municipal_roll_up(scenarios: DataFrame) -> DataFrame:
    """`cell_scenarios` by code, name, both cases and litres a person, nulls of these kept: people and households (nothing known
    counts 0), the greatest time, households out and ratio, the first cell's status, and the people affected and their demand
    (nothing known is null). Cells are summed in each task before they move, so that a municipality of any size meets as few rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast(scenarios.schema[c].dataType)).alias(c)
    keys = ["code", "name", "population_case", "demand_case", "litres"]
    return scenarios.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), total("people"), total("households"), F.max("snapshot_time").alias("snapshot_time"), F.max("out").alias("out"),
        F.min_by("status", "unit").alias("status"), F.max("ratio").alias("ratio"), F.sum("affected").alias("affected"), F.sum("demand").alias("demand"),
    )


def demand_table(rolled: DataFrame, latest: DataFrame, areas: DataFrame) -> DataFrame:
    """The roll-up with the latest report's number, time, greatest households and vehicles, and the geometry (areas: code, geometry,
    a row a code). Without a report the time is the roll-up's; every row of the roll-up stays."""
    d = rolled.join(latest.drop("out"), "code", "left").join(areas.select("code", "geometry"), "code", "left")
    d = d.withColumn("status_time", F.coalesce("status_time", "snapshot_time"))
    return d.select("code", "name", "geometry", "report", "status_time", "most", "out", "status", *TANKERS, "people", "households", "ratio", "population_case", "affected", "demand_case", "litres", "demand")


def _one(value: Column, where: Column, what: str) -> Column:
    """The one value of a group's rows, or of those where a condition holds: null if all are null, an error, when read, if they differ."""
    v = F.when(where, value)
    known, rows = F.count(v), F.count_if(where)
    apart = F.max(v) - F.min(v) > F.greatest(F.abs(F.max(v)), F.abs(F.min(v))) * AGREE
    return F.when((F.coalesce(apart, F.lit(False))) | ((known > 0) & (known < rows)) | (rows == 0), F.raise_error(F.lit(f"{what} has no single value")).cast("double")).otherwise(F.max(v))


def positive_table(table: DataFrame) -> DataFrame:
    """place, name, out, ratio, people in three cases, and the central case's water at three levels: a row for each municipality of a
    `demand_table` whose status is POSITIVE, most households out first, then by name. A municipality whose rows don't agree in a
    value, or lack a case, is an error when it is read."""
    every = F.lit(True)
    people = [_one(F.col("affected"), F.col("population_case") == case, f"affected of {case}").alias(c) for case, c in PEOPLE]
    water = [_one(F.col("demand"), (F.col("population_case") == CENTRAL) & (F.col("demand_case") == level), f"demand of {level}").alias(c) for level, c in WATER]
    one_status = F.when(F.count_distinct("status") == 1, F.min("status")).otherwise(F.raise_error(F.lit("status has no single value")))
    d = table.groupBy("code").agg(F.min("name").alias("name"), one_status.alias("status"), _one(F.col("out").cast("double"), every, "out").alias("out"), _one(F.col("ratio"), every, "ratio").alias("ratio"), *people, *water)
    d = d.where(F.col("status") == POSITIVE).drop("status")
    return number_rows(d, [F.desc("out"), F.asc("name"), F.asc("code")], "place").select("place", "name", "out", "ratio", *[c for _, c in (*PEOPLE, *WATER)])
