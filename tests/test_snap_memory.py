"""Snapping in dense places: a row for each point, and first edges without a sort of all ends."""

import random

import pytest

from reliefgrid.operators import facilities, geo


@pytest.mark.parametrize("most", [3, 1 << 14])
def test_nearest_within_a_limit_as_by_brute_force(spark, most):
    rng = random.Random(2)
    n = [(k, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for k in range(60)] + [(900, None, 1.0), (901, float("nan"), 1.0), (None, 1.0, 1.0)]
    p = [(k, rng.randint(-20, 60) / 2, rng.randint(-20, 60) / 2) for k in range(80)] + [(500, None, 0.0), (501, float("inf"), 0.0), (502, 500.0, 500.0)]
    at = lambda k: f"{k} long, x double, y double"
    got = {x.pid: (x.distance, x.nid) for x in geo.nearest_within(spark.createDataFrame(p, at("pid")), spark.createDataFrame(n, at("nid")), 3.0, most).collect()}
    want = {}
    for k, x, y in p:
        d = [] if k >= 500 else [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, i) for i, u, v in n[:60]]
        want[k] = min((q for q in d if q[0] <= 3), default=(None, None))
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and None in {v[1] for k, v in want.items() if k < 500}
    assert all(got[k][0] == pytest.approx(d) for k, (d, _) in want.items())


def test_a_task_gives_a_row_for_each_point():
    import pyarrow as pa

    one = lambda k: pa.table({k: list(range(400)), "x": [k_ % 20 / 10 for k_ in range(400)], "y": [k_ // 20 / 10 for k_ in range(400)]})
    rows = geo._nearest_in(9.0)(one("pid"), one("nid")).to_pylist()
    assert rows == [{"pid": k, "nid": k, "distance": 0.0} for k in range(400)]


def test_first_edges_are_no_sort(spark):
    e = spark.createDataFrame([(5, 1, 2), (3, 2, 1), (4, 7, 7), (9, 1, None), (2, 8, 9), (2, 9, 8)], "edge_id long, a long, b long")
    d = facilities.first_edges(e)
    assert {x.nid: (x.edge_id, x.fraction) for x in d.collect()} == {1: (3, 1.0), 2: (3, 0.0), 7: (4, 0.0), 8: (2, 0.0), 9: (2, 0.0)}
    assert "SortAggregate" not in d._jdf.queryExecution().sparkPlan().toString()
