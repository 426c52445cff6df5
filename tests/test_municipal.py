"""Roll-up of cells, latest reports, and the table of municipalities with outages, by hand and by pandas."""

import datetime

import pandas as pd
import pytest

from reliefgrid.operators import municipal

DAY = datetime.date
REPORT = "kind string, unit string, report long, status_time date, most double, out double, tankers long, tankers_ministry long, tankers_waterworks long, tankers_defence long"
CELLS = "unit long, code string, name string, people double, households double"


def reports(spark):
    rows = [
        ("city", "A", 1, DAY(2020, 7, 1), 9.0, 5.0, 1, 1, 0, 0), ("city", "A", 2, DAY(2020, 7, 2), 9.0, 4.0, 2, 1, 1, 0), ("city", "A", 3, DAY(2020, 7, 2), 8.0, 3.0, 3, 1, 1, 1),
        ("city", "B", 3, DAY(2020, 7, 1), 7.0, 7.0, 0, 0, 0, 0), ("joint", "A", 9, DAY(2020, 7, 9), 6.0, 6.0, 0, 0, 0, 0), ("city", "C", 3, DAY(2020, 7, 2), None, 0.0, None, None, None, None),
        (None, None, 5, DAY(2020, 7, 8), 1.0, 1.0, 0, 0, 0, 0),
    ]
    known = spark.createDataFrame([("city", "A", "01", "exact"), ("city", "B", "02", "exact"), ("city", "C", "03", "exact"), ("joint", "A", None, "joint_operator_unallocated")], "kind string, unit string, code string, match_status string")
    return municipal.latest_reports(spark.createDataFrame(rows, REPORT), known, ["kind", "unit"])


def cells(spark):
    rows = [(1, "01", "a", 10.0, 4.0), (2, "01", "a", 5.0, 2.0), (3, "02", "b", 8.0, 3.0), (4, "03", "c", 0.0, 0.0), (5, None, None, 6.0, 2.0), (6, None, None, None, None), (7, "04", "d", None, None)]
    return spark.createDataFrame(rows, CELLS)


def test_latest_reports_are_those_of_matched_units(spark):
    got = {r.code: (r.report, r.out, r.tankers) for r in reports(spark).collect()}
    assert got == {"01": (3, 3.0, 3), "03": (3, 0.0, None)}  # the joint operator's later report doesn't move the latest time


def test_roll_up_keeps_all_keys_and_nulls(spark):
    latest = reports(spark)
    rolled = municipal.municipal_roll_up(municipal.cell_scenarios(cells(spark), latest))
    assert rolled.count() == 5 * 9
    central = {r.code: r for r in rolled.where("population_case = 'proportional_central' AND demand_case = 'basic'").collect()}
    a = central["01"]
    assert (a.units, a.people, a.households, a.out, a.status, a.ratio, a.affected, a.demand, a.litres, a.snapshot_time) == (2, 15.0, 6.0, 3.0, "reported_positive", 0.5, 7.5, 75.0, 10.0, DAY(2020, 7, 2))
    b = central["02"]
    assert (b.status, b.out, b.affected, b.snapshot_time) == ("assumed_zero_no_official_outage_listing", 0.0, 0.0, DAY(2020, 7, 2))
    c = central["03"]  # no households: neither ratio nor people affected are known
    assert (c.status, c.out, c.ratio, c.affected, c.demand) == ("reported_zero", 0.0, None, None, None)
    n = central[None]
    assert (n.units, n.people, n.households, n.out, n.status, n.affected, n.snapshot_time) == (2, 6.0, 2.0, None, "unmatched_geography", None, None)
    assert (central["04"].people, central["04"].affected) == (0.0, None)


def test_demand_table_joins_the_latest_report_and_the_area(spark):
    latest = reports(spark)
    rolled = municipal.municipal_roll_up(municipal.cell_scenarios(cells(spark), latest))
    t = municipal.demand_table(rolled, latest, spark.createDataFrame([("01", "g1"), ("02", "g2")], "code string, geometry string"))
    assert len(t.columns) == 20 and t.count() == rolled.count()
    one = {r.code: r for r in t.where("population_case = 'proportional_central' AND demand_case = 'basic'").collect()}
    assert (one["01"].geometry, one["01"].report, one["01"].most, one["01"].tankers_defence) == ("g1", 3, 8.0, 1)
    assert (one["02"].report, one["02"].status_time, one["02"].tankers) == (None, DAY(2020, 7, 2), None)
    p = municipal.positive_table(t).collect()
    assert [(r.place, r.name, r.out, r.people_lower, r.people_central, r.water_extended) for r in p] == [(1, "a", 3.0, 3.0, 7.5, 150.0)]


def test_positive_table_sorts_and_refuses_what_differs(spark):
    rows = [(c, c, "reported_positive", out, 0.5, case, 2.0, level, 2.0 * q) for c, out in (("x", 5.0), ("b", 7.0), ("a", 5.0)) for case, _ in municipal.PEOPLE for level, q in (("minimum", 3), ("basic", 10), ("extended", 20))]
    cols = "code string, name string, status string, out double, ratio double, population_case string, affected double, demand_case string, demand double"
    made = lambda r: municipal.positive_table(spark.createDataFrame(r, cols).repartition(5))
    assert [(r.place, r.name) for r in sorted(made(rows).collect())] == [(1, "b"), (2, "a"), (3, "x")]
    nearly = [(*r[:3], r[3] * (1 + 1e-15), *r[4:]) for r in rows[:3]] + rows[3:]
    assert made(nearly).count() == 3
    for bad in ([(*rows[0][:3], 6.0, *rows[0][4:]), *rows[1:]], [(*rows[0][:2], "reported_zero", *rows[0][3:]), *rows[1:]], [r for r in rows if r[5] != "proportional_central"]):
        with pytest.raises(Exception, match="no single value"):
            made(bad).collect()
    assert made([]).count() == 0


def test_roll_up_against_pandas(spark):
    rows = [(k, None if k % 7 == 0 else f"0{k % 4}", None if k % 7 == 0 else f"n{k % 4}", float(k * 37 % 101), float(k * 13 % 29)) for k in range(1, 200)]
    s = municipal.cell_scenarios(spark.createDataFrame(rows, CELLS), reports(spark))
    keys = ["code", "name", "population_case", "demand_case", "litres"]
    f = s.toPandas().sort_values("unit")
    want = f.groupby(keys, dropna=False).agg(people=("people", "sum"), out=("out", "max"), status=("status", "first"), affected=("affected", lambda v: v.sum(min_count=1)), demand=("demand", lambda v: v.sum(min_count=1))).reset_index()
    got = municipal.municipal_roll_up(s).toPandas()[list(want.columns)]
    order = lambda d: d.fillna({"code": "", "name": ""}).sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-12)
