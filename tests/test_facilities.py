"""Facilities, matching and formats on small fixtures with results worked out by hand."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from reliefgrid.functions import formats
from reliefgrid.operators import facilities, geo, matching


def one(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def value(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_segment_distances(spark):
    n = [F.lit(float(k)) for k in range(11)]
    assert value(spark, matching.segment_distance(n[5], n[3], n[0], n[0], n[10], n[0]), matching.segment_distance(n[3], n[4], n[0], n[0], n[0], n[0])) == (3.0, 5.0)
    crossing = matching.segments_distance([n[0], n[0], n[4], n[4]], [n[0], n[4], n[4], n[0]])
    apart = matching.segments_distance([n[0], n[0], n[4], n[0]], [n[0], n[2], n[4], n[3]])
    assert value(spark, crossing, apart) == (0.0, 2.0)


def test_match_ladder(spark):
    o = spark.createDataFrame([(1, True, "r", 0.0, 0.0), (2, True, None, 0.0, 400.0), (3, True, "r", 5000.0, 0.0)], "oid int, is_point boolean, route string, ax double, ay double")
    o = o.withColumn("bx", F.col("ax")).withColumn("by", F.col("ay"))
    e = spark.createDataFrame([(10, "r", -50.0, 60.0, 50.0, 60.0), (11, "q", -50.0, -90.0, 50.0, -90.0), (12, "r", -50.0, 200.0, 50.0, 200.0), (13, "r", 0.0, 260.0, 0.0, 300.0)], "edge_id int, route string, ax double, ay double, bx double, by double")
    got = one(matching.match_restrictions(o, e))
    assert got == [
        (1, 10, 60.0, True, 2, "point_nearest_100m", "matched_primary"), (1, 11, 90.0, False, 2, "point_nearest_100m", "matched_primary"),
        (2, 13, 100.0, None, 1, "point_nearest_100m", "matched_primary"), (3, None, None, None, 0, "none", "unmatched"),
    ]
    assert one(matching.closed_edges(e.withColumn("hazard", F.col("edge_id") == 12), matching.match_restrictions(o, e)))[:3] == [("matched", 10), ("matched", 11), ("matched", 13)]


def test_clipped_area_of_a_triangle(spark):
    d = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], (0.0, 0.0, 2.0, 2.0)), ([(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)], (0.0, 0.0, 2.0, 2.0)), ([(-1.0, -1.0), (5.0, -1.0), (5.0, 5.0), (-1.0, 5.0)], (0.0, 0.0, 2.0, 3.0))], "ring array<struct<x:double,y:double>>, box struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r[0] for r in d.select(matching.clipped_area(F.col("ring"), F.col("box"))).collect()] == [4.0, 0.0, 6.0]


def test_cells_link_by_middle_then_by_overlap(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 9.0, 0.0, 11.0, 2.0), (3, 50.0, 50.0, 52.0, 52.0), (4, 9.5, 9.0, 11.5, 11.0)], "cid int, x0 double, y0 double, x1 double, y1 double")
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    a = spark.createDataFrame([(7, box(-1.0, -1.0, 9.9, 9.9)), (8, box(9.9, -1.0, 20.0, 9.9))], "gid int, ring array<struct<x:double,y:double>>")
    assert one(matching.link_cells(c, a, 5.0)) == [(1, 7, "point_unique"), (2, 8, "point_unique"), (3, None, "unmatched"), (4, 8, "maximum_overlap")]


def test_locations_snaps_and_ends(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, None), ("c", None, 5.0), (None, None, None)], "name string, x double, y double")
    known = spark.createDataFrame([("b", 3.0, 4.0), ("b", 3.0, 4.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0)], "name string, x double, y double")
    assert {r[0]: tuple(r)[1:] for r in facilities.resolve_location(rows, known, "name").collect()} == {
        "a": (1.0, 2.0, "existing_coordinates"), "b": (3.0, 4.0, "unique_facility_name"), "c": (None, None, "unresolved"), None: (None, None, "unresolved"),
    }
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0)], "pid int, x double, y double")
    n = spark.createDataFrame([(5, 30.0, 40.0), (6, 200.0, 0.0)], "nid int, x double, y double")
    e = spark.createDataFrame([(100, 6, 5), (101, 5, 6)], "edge_id int, a int, b int")
    assert one(facilities.snap_to_network(p, n, e)) == [(1, 5, 50.0, True, 100, 1.0), (2, None, None, False, None, None)]
    assert value(spark, *facilities.nearest_end(F.lit(0.5), F.lit(1), F.lit(2), F.lit(10.0))) == (1, 5.0)


def test_routes_sites_and_gaps(spark):
    arcs = spark.createDataFrame([(1, "s"), (2, "t")], "unit int, site string")
    routes = spark.createDataFrame([("s", 3), ("u", 5)], "site string, trips int")
    assert one(facilities.route_capacity(arcs, routes, "site", "trips", 2.0)) == [(6.0,)]
    left = facilities.without_site([arcs, routes], spark.createDataFrame([("s",)], "site string"), "site")
    assert [d.count() for d in left] == [1, 1]
    b = spark.createDataFrame([(1, 8, 2.0), (1, 7, 2.0), (2, 8, 1.0)], "refill int, base int, minutes double")
    assert one(facilities.nearest_base(b, "refill", "base", "minutes")) == [(1, 7, 2.0), (2, 8, 1.0)]
    d = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0)], "unit int, distance double")
    after = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, None), (4, 99.0)], "unit int, distance double")
    assert one(facilities.recovered_coverage(d, after, "unit", 10.0)) == [(1, "retained"), (2, "gained"), (3, "lost"), (4, "not_covered")]
    u = spark.createDataFrame([("g", 4.0, 1.0), ("g", 6.0, None), ("h", 2.0, 99.0)], "grp string, people double, d double")
    assert one(facilities.access_gaps(u, "grp", "d", [("people", 10.0)])) == [("g", 10.0, 4.0, 6.0, 40.0), ("h", 2.0, 0.0, 2.0, 0.0)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("x", [0.0, 1.0, -2.5, 130.70812345678, 1e-300, -6.25e17])
def test_points_from_wkb(spark, order, x):
    d = spark.createDataFrame([(bytearray(struct.pack(order + "BIdd", order == "<", 1, x, 32.5)),), (bytearray(struct.pack(order + "BIdd", order == "<", 2, x, 1.0)),), (None,)], "w binary")
    assert [tuple(r) for r in d.select(*formats.point_from_wkb("w")).collect()] == [(x, 32.5), (None, None), (None, None)]


def test_plane_coordinates_follow_the_meridian_arc(spark):
    e2 = formats.GRS80_F * (2 - formats.GRS80_F)
    arc = lambda a, b, n=20000: sum(formats.GRS80_A * (1 - e2) / (1 - e2 * math.sin(math.radians(a + (b - a) * (k + 0.5) / n)) ** 2) ** 1.5 for k in range(n)) * math.radians(b - a) / n
    x, y = value(spark, *formats.plane_xy(F.lit(131.0), F.lit(32.2), 131.0, 33.0))
    assert abs(x) < 1e-6 and abs(y - 0.9999 * arc(33.0, 32.2)) < 1e-3
    # a small step east has the length of the parallel's arc, times the scale
    x, _ = value(spark, *formats.plane_xy(F.lit(131.001), F.lit(32.2), 131.0, 33.0))
    s = math.sin(math.radians(32.2))
    assert abs(x - 0.9999 * formats.GRS80_A / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(32.2)) * math.radians(0.001)) < 1e-3


def test_formats(spark):
    d = spark.createDataFrame([("a|b",), ("x" * 61,), (None,)], "s string")
    assert [r[0] for r in d.select(formats.markdown_cell("s")).collect()] == ["a\\|b", "x" * 57 + "...", None]
    assert value(spark, formats.thousands(F.lit(1234567.5), 1), formats.percent(F.lit(0.1234))) == ("1,234,567.5", "12.3%")
    assert value(spark, formats.translate_exact(F.lit("a"), {"a": "b"}), formats.graticule(F.lit(0.4), F.lit(1.6), 0.5)) == ("b", [0.5, 1.0, 1.5])
    assert value(spark, formats.valid_geometry(F.lit('{"type":"Point"}')), formats.valid_geometry(F.lit("[1]")), formats.geometry_type(F.lit('{"type":"Point"}'))) == ('{"type":"Point"}', None, "Point")
    assert str(value(spark, formats.mixed_timestamp(F.lit("2026/07/01 09:30"), ("yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm"), "Asia/Tokyo"))[0]) == "2026-07-01 00:30:00"
    with pytest.raises(Exception, match="no translation of z"):
        value(spark, formats.translate_exact(F.lit("z"), {"a": "b"}))


def test_ladder_makes_far_pairs_only_for_what_has_no_near_one(spark, monkeypatch):
    made = []

    def counted(left, lkey, right, rkey, limit, *args, **kw):
        out = within(left, lkey, right, rkey, limit, *args, **kw)
        made.append((limit, out.count()))
        return out

    within = matching.lines_within
    monkeypatch.setattr(matching, "lines_within", counted)
    at = "oid int, is_point boolean, route string, ax double, ay double, bx double, by double"
    o = spark.createDataFrame([(1, True, "r", 0.0, 0.0, 0.0, 0.0), (2, False, "r", 9000.0, 0.0, 9010.0, 0.0)], at)
    e = spark.createDataFrame([(k, "r", x, 0.0, x, 1.0) for k, x in enumerate([90.0, *[120.0] * 30, 9100.0, 9120.0])], "edge_id int, route string, ax double, ay double, bx double, by double")
    got = one(matching.match_restrictions(o, e))
    assert [x[:5] for x in got] == [(1, 0, 90.0, True, 1), (2, 31, 90.0, True, 2)]
    assert made == [("limit", 1), (matching.FALLBACK_LIMIT, 2)]


def test_cells_link_as_by_brute_force(spark):
    import random

    rng = random.Random(3)
    cells = [(k, x, y, x + 5.0, y + 4.0) for k in range(40) for x, y in [(rng.uniform(0, 60), rng.uniform(0, 60))]]
    cells += [(40 + k, 100.0 + k, 100.0, 101.0 + k, 101.0) for k in range(6)]
    areas = [(k, [(x, y), (x + rng.uniform(3, 30), y + 2), (x + 8, y + rng.uniform(5, 30)), (x - 3, y + 9)]) for k in range(30) for x, y in [(rng.uniform(0, 60), rng.uniform(0, 60))]]
    areas += [(99 - k, [(90.0, 90.0), (110.0, 90.0), (110.0, 110.0), (90.0, 110.0)]) for k in range(3)]  # equal overlaps: the least gid
    c = spark.createDataFrame(cells, "cid int, x0 double, y0 double, x1 double, y1 double")
    a = spark.createDataFrame(areas, "gid int, ring array<struct<x: double, y: double>>")
    d = c.crossJoin(a).select("cid", "gid", geo.in_ring((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("ring")).alias("hit"), F.round(matching.clipped_area(F.col("ring"), F.struct("x0", "y0", "x1", "y1")), 6).alias("area"))
    by = {}
    for x in d.collect():
        by.setdefault(x.cid, []).append(x)
    want = []
    for k, rows in sorted(by.items()):
        hits = [x.gid for x in rows if x.hit]
        best = min(((-x.area, x.gid) for x in rows if x.area > 0), default=(0, None))[1]
        want.append((k, hits[0], "point_unique") if len(hits) == 1 else (k, best, "maximum_overlap" if best is not None else "unmatched"))
    assert len({x[2] for x in want}) > 1 and want[-1] == (45, 97, "maximum_overlap")
    for width, most in ((50.0, 1 << 14), (7.0, 1 << 14), (50.0, 4)):
        assert one(matching.link_cells(c, a, width, most)) == sorted(want, key=repr)


def test_cells_meet_areas_without_a_row_for_each_pair():
    box = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    import pyarrow as pa

    a = pa.table({"cid": list(range(50)), "x0": [1.0] * 50, "y0": [1.0] * 50, "x1": [2.0] * 50, "y1": [2.0] * 50, "gx": [0] * 50, "gy": [0] * 50, "cx": [0] * 50, "cy": [0] * 50})
    b = pa.table({"gid": list(range(60)), "ring": pa.array([[{"x": x, "y": y} for x, y in box]] * 60), "hx": [0] * 60, "hy": [0] * 60})
    rows = matching._met_cells(a, b).to_pylist()
    assert rows == [{"cid": k, "hits": 60, "hit": 0, "overlap": 1.0, "gid": 0} for k in range(50)]
