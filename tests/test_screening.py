"""Packing from a pool, checks of solutions, result tables and sinks, by brute force and on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from reliefgrid.functions import formats, text
from reliefgrid.operators import keys, screening, tables
from reliefgrid.sources import storage


def brute_pack(rows, capacity):
    left, out = capacity, set()
    for d, w, u, s in sorted(rows):
        if 0 < w <= left + 1e-9:
            out.add((u, s))
            left -= w
    return out


@pytest.mark.parametrize("fold", [4096, 5])
def test_pool_packing(spark, fold):
    r = random.Random(4)
    sets = {k: [(float(r.randint(0, 20)), float(r.randint(0, 30)), u, r.randint(0, 3)) for u in range(60)] for k in range(5)}
    sets[5] = [(1.0, 50.0, 1, 1), (2.0, 0.0, 2, 1)]
    rows = [(k, *x, 40.0 + 25 * k) for k, v in sets.items() for x in v]
    d = spark.createDataFrame(rows, "k int, distance double, water double, unit int, site int, capacity double")
    got = screening.pack_pool(d, ["k"], ["distance", "water", "unit", "site"], "water", "capacity", fold).collect()
    for k, v in sets.items():
        mine = {(x.unit, x.site) for x in got if x.k == k}
        assert mine == brute_pack(v, 40.0 + 25 * k)


def test_greedy_order(spark):
    d = spark.createDataFrame([(0, float(i), float(w), i, 0, 10.0) for i, w in enumerate([5, 9, 3, 2, 1])], "k int, distance double, water double, unit int, site int, capacity double")
    got = screening.pack_pool(d, ["k"], ["distance", "water", "unit", "site"], "water", "capacity")
    assert sorted(x.water for x in got.collect()) == [2.0, 3.0, 5.0]


def test_factorial_of_an_empty_structure(spark):
    arcs = spark.createDataFrame([("open", "all", 1, 7, 3.0), ("open", "all", 2, 7, 5.0)], "road_state string, point_state string, unit int, site int, distance double")
    cells = spark.createDataFrame([(u, "c", "m", 4.0, 12.0) for u in (1, 2, 3)], "unit int, outage_case string, demand_case string, people double, water double")
    routes = spark.createDataFrame([(7, 1), (8, 5)], "site int, trips int")
    got = {(x.road_state, x.fleet): x for x in screening.screen_factorial(arcs, cells, routes, [("open", "all"), ("shut", "all")], [1, 2], 12.0).collect()}
    assert len(got) == 4 and got["shut", 2].feasible == "No" and got["shut", 2].unmet == 36.0 and got["shut", 2].share == 0.0 and got["shut", 2].mean_access is None
    assert got["open", 1].share == pytest.approx(1 / 3) and got["open", 1].mean_access == 3.0
    assert got["open", 2].share == pytest.approx(2 / 3) and got["open", 2].mean_access == 4.0 and got["open", 2].sites_used == 1


def test_solution_checks_find_faults(spark):
    arcs = spark.createDataFrame([(1, 7, 5.0), (2, 7, 6.0), (3, 8, 1.0)], "unit int, site int, demand double")
    cap = spark.createDataFrame([(7, 8.0), (8, 4.0)], "site int, capacity double")
    bad = spark.createDataFrame([(1, 7, 5.0, "served"), (2, 7, 7.0, "served"), (2, 8, 1.0, "served"), (3, None, 1.0, "unserved")], "unit int, site int, demand double, status string")
    assert [x.violations for x in screening.solution_checks(bad, arcs, cap).collect()] == [1, 0, 1, 1, 1, 1]


def test_replay_and_overrides_want_every_row(spark):
    arcs = spark.createDataFrame([(1, 7, 2.0)], "unit int, site int, distance double")
    ask = spark.createDataFrame([(1, 7), (2, 7)], "unit int, site int")
    assert screening.replay(ask.where("unit = 1"), arcs, ["unit", "site"]).first().distance == 2.0
    with pytest.raises(Exception, match="no arc for 2, 7"):
        screening.replay(ask, arcs, ["unit", "site"]).collect()
    rows = spark.createDataFrame([("a", None, "open"), ("b", 3.0, "own")], "name string, x double, status string")
    o = spark.createDataFrame([("a", 9.0), ("b", 8.0)], "name string, x double")
    assert {tuple(x) for x in tables.with_overrides(rows, o, ["name"], ["x"], "status", "map").collect()} == {("a", 9.0, "map"), ("b", 3.0, "own")}
    with pytest.raises(Exception, match="no override for a"):
        tables.with_overrides(rows, o.where("name = 'b'"), ["name"], ["x"], "status", "map").collect()
    with pytest.raises(Exception, match="no values for 2"):
        tables.complete_by_unit(spark.createDataFrame([(1,), (2,)], "unit int"), arcs, "unit", ["distance"]).collect()


def test_small_asserts(spark):
    d = spark.createDataFrame([(1, "x"), (1, "y")], "a int, b string")
    assert tables.single_value(d, "a") == 1
    for c in ("b",):
        with pytest.raises(ValueError, match="no single value"):
            tables.single_value(d, c)
    assert tables.approved([1000.0, 250.0, 500.0]) == [250.0, 500.0, 1000.0]
    with pytest.raises(ValueError, match="thresholds"):
        tables.approved([250.0])
    assert tables.ascii_names(d) is d
    with pytest.raises(ValueError, match="ASCII"):
        tables.ascii_names(d.withColumnRenamed("a", "水"))
    twice = d.unionByName(d)
    assert keys.signature(twice, ["a", "b"]).first() != keys.signature(d.where("false"), ["a", "b"]).first()
    assert keys.signature(twice, ["a", "b"]).first() == keys.signature(twice.orderBy("b"), ["a", "b"]).first()


def test_point_encoding(spark):
    import struct

    r = random.Random(2)
    values = [0.0, -0.5, 1.0, 130.7, 32.55, 1e300, -1e-300, 3.0, 0.1, 2.0**-1022] + [r.uniform(-200, 200) for _ in range(100)]
    d = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(values, values[::-1]))] + [(1000, None, 1.0), (1001, float("nan"), 1.0)], "k int, x double, y double")
    x2, y2 = formats.point_from_wkb(formats.point_wkb("x", "y"))
    for row in d.select("k", "x", "y", formats.point_wkb("x", "y").alias("w"), x2.alias("x2"), y2.alias("y2")).collect():
        if row.k >= 1000:
            assert row.w is None
        else:
            assert bytes(row.w) == struct.pack("<BIdd", 1, 1, row.x, row.y) and (row.x2, row.y2) == (row.x, row.y)


def test_geometry_tables_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "g1", 'a|b "q"'), (2, None, None)], "id int, geometry string, name string")
    storage.write_geo(d, f"{tmp_path}/geo", "geometry", "EPSG:6668")
    assert storage.geo_table(spark, f"{tmp_path}/geo", ["id", "geometry"], "geometry", "EPSG:6668").count() == 2
    with pytest.raises(ValueError, match="EPSG:6668"):
        storage.geo_table(spark, f"{tmp_path}/geo", ["geometry"], "geometry", "EPSG:4326")
    assert storage.table_shape(spark, f"{tmp_path}/geo") == (2, 3)
    storage.write_csv(d, f"{tmp_path}/csv")
    assert {tuple(x) for x in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()} == {("1", "g1", 'a|b "q"'), ("2", None, None)}
    for _ in range(2):
        storage.write_audit(d, f"{tmp_path}/audit")
    assert spark.read.json(f"{tmp_path}/audit").count() == 2
    one = storage.feature_collections(d.withColumn("geometry", F.lit('{"type":"Point"}')), [], "geometry", ["id"]).first().value
    assert one == '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point"},"properties":{"id":1}},{"type":"Feature","geometry":{"type":"Point"},"properties":{"id":2}}]}'
    assert [x.value for x in storage.markdown_rows(d.orderBy("id")).collect()] == ['| 1 | g1 | a\\|b "q" |', "| 2 |  |  |"] and storage.markdown_head(d)[1] == "|---|---|---|"
    t = F.lit("# A\nx\n## Questions (1)\none\ntwo\n# B\ny")
    assert spark.range(1).select(storage.markdown_section(t, "Questions (1)"), storage.markdown_section(t, "C")).first()[:] == ("one\ntwo", None)
    assert storage.keyed_lookup(d.select("id"), d.select("id", "name"), ["id"]).count() == 2


def test_report_values(spark):
    d = spark.createDataFrame([("２０２６年　8月 6日 10:00 頃", "８：３０～１７：００", "12.5", "国道　３号・（下り）", " "), ("x", "8時", "不明", None, "1.234")], "a string, b string, c string, d string, e string")
    opening, closing = text.time_range("b")
    got = d.select(text.japanese_timestamp("a").cast("string"), opening, closing, text.household_count("c"), text.route_name("d"), text.route_name(F.lit(" 　")), text.household_count("e"), text.facility_name_short("d")).collect()
    assert tuple(got[0]) == ("2026-08-06 01:00:00", "08:30", "17:00", 12.5, "国道3号下り", None, None, "国道3号下り")
    assert tuple(got[1]) == (None, None, None, None, None, None, 1234.0, None)


def test_plane_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((131.0, 33.0), (131.1, 33.0))])
    got = spark.range(1).select(formats.plane_ring(ring, 131.0, 33.0).alias("r")).first().r
    assert abs(got[0].x) < 1e-6 and abs(got[0].y) < 1e-6 and 9300 < got[1].x < 9400


def test_pool_of_many_rows_is_not_written(spark, monkeypatch):
    """Rounds write the rows that they can reach, not all; null, negative and equal distances and twin rows keep the rule."""
    r = random.Random(11)
    rows = [(k % 2, None if u % 97 == 0 else float(r.randint(-3, 400)), u, float(r.randint(1, 9)), 60.0 + 40 * k) for k in range(3) for u in range(400)]
    rows += rows[:40]
    wrote = []
    monkeypatch.setattr(screening, "_running", lambda d, *a, f=screening._running: (wrote.append(d.count()), f(d, *a))[1])
    rows = [(k, d, u, w, 60.0 + 40 * k) for k, d, u, w, _ in rows]
    d = spark.createDataFrame(rows, "k long, distance double, unit long, water double, cap double").repartition(5)
    got = screening.pack_pool(d, ["k"], ["distance", "unit", "water"], "water", "cap", fold=8).collect()
    want = []
    for k in (0, 1):
        room = 60.0 + 40 * k
        for row in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0.0, x[2], x[3])):
            if row[3] <= room + 1e-9:
                room -= row[3]
                want.append(row)
    key = lambda x: (x[0], x[1] is not None, x[1] or 0.0, *x[2:])
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)
    assert wrote and max(wrote) < len(rows) / 4


def test_arcs_found_with_the_search_are_those_of_the_matrix(spark):
    from reliefgrid.operators import network

    graph = network.build_graph(spark.createDataFrame([(k, k + 1, 1.0 + k % 3) for k in range(30)] + [(50, 51, 1.0)], "x long, y long, w double"), "x", "y", "w")
    sites = spark.createDataFrame([(k, 3 * k, k % 3 / 2.0) for k in range(9)] + [(9, 50, 0.0)], "site long, node long, connector double")
    edges = spark.createDataFrame([(k, k, k + 1, 1.0 + k % 3) for k in range(30)] + [(40, 29, 51, 20.0)], "edge_id long, a long, b long, length double")
    units = spark.createDataFrame([(k, k, k % 4 / 4.0, k % 2 * 0.5) for k in range(30)] + [(40, 40, 0.05, 0.0)], "unit long, edge_id long, fraction double, snap double")
    matrix = network.nearest_distance(graph, sites.selectExpr("site", "node", "0D AS offset"), cutoff=7.0, by=["site"])
    want = screening.feasible_arcs(matrix, units, edges, sites, 7.5)
    got = screening.reachable_arcs(graph, units, edges, sites, 7.0, 7.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 40


def test_no_more_units_go_to_a_pool_than_fill_it(spark, monkeypatch):
    """400 units that ask for one of three amounts, at many distances: pools of 24 and 96 litres get a few of them, and serve those that a
    plain pass over all units serves."""
    r, seen, pack = random.Random(11), [], screening.pack_pool
    monkeypatch.setattr(screening, "pack_pool", lambda rows, *a: seen.append(rows.count()) or pack(rows, *a))
    units = [(u, r.randrange(100, 100000), r.choice([1.0, 3.0, 4.0])) for u in range(400)]
    arcs = spark.createDataFrame([("open", "all", u, u % 5, float(d)) for u, d, _ in units], "road_state string, point_state string, unit long, site long, distance double")
    cells = spark.createDataFrame([(u, o, "one", p, p * k) for u, _, p in units for o, k in (("low", 2.0), ("high", 7.0))], "unit long, outage_case string, demand_case string, people double, water double")
    routes = spark.createDataFrame([(s, 2) for s in range(5)], "site long, trips int")
    got = {(x.outage_case, x.fleet): x for x in screening.screen_factorial(arcs, cells, routes, [("open", "all")], [1, 4], 12.0).collect()}
    for case, k in (("low", 2.0), ("high", 7.0)):
        for fleet in (1, 4):
            room, people, way = fleet * 24.0, 0.0, 0.0
            for d, w, _, p in sorted((d, p * k, u, p) for u, d, p in units):
                if w <= room:
                    room, people, way = room - w, people + p, way + p * d
            x = got[case, fleet]
            assert x.share == pytest.approx(people / sum(p for _, _, p in units)) and x.mean_access == pytest.approx(way / people) and x.feasible == "Yes"
    assert seen[0] < 400
