"""Reference systems there and back, at any depth of geometry, and against numerical meridian arcs."""

import math

import pytest
from pyspark.sql import functions as F

from reliefgrid.functions import projections as P
from reliefgrid.sources.storage import crs_of


def arc(lat):
    """Metres along the meridian from the equator, by Simpson's rule."""
    e2 = P.GRS80_F * (2 - P.GRS80_F)
    f = lambda t: P.GRS80_A * (1 - e2) / (1 - e2 * math.sin(t) ** 2) ** 1.5
    n, top = 2000, math.radians(lat)
    h = top / n
    return h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(k * h) for k in range(n + 1))


def test_there_and_back(spark):
    for code in ("EPSG:6669", "EPSG:6670", "EPSG:6680", "EPSG:6687"):
        lon0, lat0 = P.PLANES[code]
        rows = [(lon0 + a / 4, lat0 + b / 2) for a in range(-8, 9) for b in range(-6, 7)]
        d = spark.createDataFrame([(x, y) for x, y in rows], "x double, y double").select("x", "y", F.struct("x", "y").alias("p"))
        d = d.withColumn("plane", P.convert(F.col("p"), "EPSG:6668", code)).withColumn("back", P.convert(F.col("plane"), code, "EPSG:4326"))
        for r in d.collect():
            assert math.hypot((r.back.x - r.x) * 111_000, (r.back.y - r.y) * 111_000) < 1e-3
            if r.x == lon0:
                assert r.plane.x == pytest.approx(0, abs=1e-6)
                assert r.plane.y == pytest.approx((arc(r.y) - arc(lat0)) * P.PLANE_SCALE, abs=1e-3)


def test_layers_of_any_depth(spark):
    place = "struct<x: double, y: double, name: string>"
    p = {"x": 131.2, "y": 32.8, "name": "n"}
    rows = [(p, [p, None], [[p], []], [[[p, p]], None]), (None, None, None, None), ({"x": None, "y": 1.0, "name": "m"}, [], [], [])]
    d = spark.createDataFrame(rows, f"a {place}, b array<{place}>, c array<array<{place}>>, d array<array<array<{place}>>>")
    for c in "abcd":
        d = P.reproject_layer(d, c, "EPSG:6670", "EPSG:6668")
        assert crs_of(d, c) == "EPSG:6670"
    first, second, third = d.collect()
    x, y = first.a.x, first.a.y
    assert 18_000 < x < 19_000 and -23_000 < y < -22_000 and first.a.name == "n"
    assert (first.b[0].x, first.b[1], first.c[0][0].y, first.c[1], first.d[0][0][1].x, first.d[1]) == (x, None, y, [], x, None)
    assert tuple(second) == (None,) * 4 and (third.a.x, third.a.y, third.b) == (None, None, [])
    over = P.reproject_layer(P.reproject_layer(d, "a", "EPSG:6669"), "a", "EPSG:4326").first().a
    assert (over.x, over.y) == (pytest.approx(131.2, abs=1e-9), pytest.approx(32.8, abs=1e-9))


def test_unknown_systems_are_errors(spark):
    d = spark.createDataFrame([((1.0, 2.0),)], "g struct<x: double, y: double>")
    with pytest.raises(ValueError, match="says of no"):
        P.reproject_layer(d, "g", "EPSG:6670")
    with pytest.raises(ValueError, match="no such"):
        P.reproject_layer(d, "g", "EPSG:3857", "EPSG:4326")
    with pytest.raises(ValueError, match="not of"):
        P.reproject_layer(P.with_crs(d, "g", "EPSG:6668"), "g", "EPSG:6670", "EPSG:4326")
    with pytest.raises(ValueError, match="no geometry"):
        P.reproject_layer(d.select(F.lit(1).alias("g")), "g", "EPSG:6670", "EPSG:4326")
