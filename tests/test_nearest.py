"""The nearest node however far it is, against brute force: dense places, equal places, ties, far points, nulls."""

import math
import random

import pytest

from reliefgrid.operators import facilities, geo


@pytest.mark.parametrize("leaf", [256, 5])
def test_nearest_node(spark, leaf):
    r = random.Random(leaf)
    nodes = [(k, r.uniform(-4000, 4000), r.uniform(-4000, 4000)) for k in range(80)]
    nodes += [(100 + k, 500 + r.gauss(0, 0.5), 500 + r.gauss(0, 0.5)) for k in range(80)]  # a dense place
    nodes += [(300 + k, -77.0, 33.0) for k in range(30)] + [(400, 60_000.0, 0.0), (401, 60_000.0, 200.0), (None, 0.0, 0.0), (402, None, 1.0)]
    points = [(k, r.uniform(-6000, 6000), r.uniform(-6000, 6000)) for k in range(60)]
    points += [(100, -77.0, 33.0), (101, 60_000.0, 100.0), (102, 1e6, -1e6), (103, None, 5.0), (104, 500.0, 500.0)]
    p, n = spark.createDataFrame(points, "pid long, x double, y double"), spark.createDataFrame(nodes, "nid long, x double, y double")
    got = {x.pid: x for x in geo.nearest_node(p, n, 250.0, leaf).collect()}
    assert len(got) == len(points) and tuple(got[103]) == (103, None, None, None)
    whole = [x for x in nodes if x[0] is not None and x[1] is not None]
    for i, x, y in points:
        if x is not None:
            d, best = min((math.hypot(x - a, y - b), k) for k, a, b in whole)
            assert got[i].nid == best and got[i].distance == pytest.approx(d) and got[i].accepted == (d <= 250)
    assert got[100].nid == 300 and got[101].nid == 400


def test_refused_points_keep_their_distance(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0), (3, None, None)], "pid long, x double, y double")
    n = spark.createDataFrame([(7, 3.0, 4.0)], "nid long, x double, y double")
    e = spark.createDataFrame([(5, 7, 8), (4, 9, 7)], "edge_id long, a long, b long")
    got = sorted(tuple(x) for x in facilities.attach_nearest_node(p, n, e).collect())
    assert got == [(1, 7, 5.0, True, 4, 1.0), (2, None, pytest.approx(math.hypot(897, 4)), False, None, None), (3, None, None, None, None, None)]
    none = facilities.attach_nearest_node(p, n.where("false"), e).collect()
    assert {tuple(x)[1:] for x in none} == {(None,) * 5}
