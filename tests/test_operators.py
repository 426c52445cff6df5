"""Operators on small fixtures with results worked out by hand."""

import heapq
import random

from pyspark.sql import functions as F

from reliefgrid.functions import nulls, stats, text
from reliefgrid.operators import geo, keys, linkage, network, scenarios, tanker
from reliefgrid.plans import catalog
from reliefgrid.sources import storage
from reliefgrid.streaming import latest


def one(df):
    return [tuple(r) for r in df.collect()]


def test_null_min_keeps_null(spark):
    d = spark.createDataFrame([(None, 3), (2, 3), (None, None)], "a int, b int")
    assert one(d.select(nulls.null_min("a", "b"))) == [(None,), (2,), (None,)]


def test_weighted_quantile_does_not_interpolate(spark):
    d = spark.createDataFrame([("g", 1.0, 9.0), ("g", 2.0, 1.0), ("h", 4.0, 1.0), ("h", None, 5.0)], "k string, v double, w double")
    assert dict(one(stats.weighted_quantile(d, ["k"], "v", "w", 0.9, "q"))) == {"g": 1.0, "h": 4.0}


def test_shortest_paths(spark):
    g = network.build_graph(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (2, 1, 4.0), (9, 9, 1.0)], "x int, y int, w double"), "x", "y", "w")
    s = spark.createDataFrame([(1, 30.0), (1, 10.0)], "node int, offset double")
    assert dict(one(network.nearest_distance(g, s))) == {1: 10.0, 2: 11.0, 3: 12.0}
    assert dict(one(network.nearest_distance(g, s, cutoff=11.0))) == {1: 10.0, 2: 11.0}


def test_distance_matrix_equals_dijkstra(spark):
    r = random.Random(4)
    edges = [(r.randrange(40), r.randrange(40), float(r.randint(1, 9))) for _ in range(90)]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    want = {}
    for s in (0, 7):
        heap, done = [(0.0, s)], {}
        while heap:
            d, n = heapq.heappop(heap)
            if n not in done:
                done[n] = d
                for m, w in near.get(n, []):
                    heapq.heappush(heap, (d + w, m))
        want |= {(s, n): d for n, d in done.items()}
    g = network.build_graph(spark.createDataFrame(edges, "x int, y int, w double"), "x", "y", "w")
    seeds = spark.createDataFrame([(0, 0, 0.0), (7, 7, 0.0)], "source int, node int, offset double")
    assert {(a, b): d for a, b, d in one(network.nearest_distance(g, seeds, by=["source"]))} == want


def test_numbers_over_ranges(spark):
    d = spark.createDataFrame([(k * 7919 % 1000, k % 3) for k in range(1000)], "a long, b long").repartition(5)
    got = one(keys.number_rows(d, ["a", "b"], "no"))
    assert sorted(got) == [(a, b, k + 1) for k, (a, b) in enumerate(sorted((k * 7919 % 1000, k % 3) for k in range(1000)))]
    assert keys.number_rows(d.where("a < 0"), ["a", "b"], "no").count() == 0


def test_whole_network_equals_dijkstra(spark):
    sf = "/root/testdata/sf0.001"
    near, heap, want = {}, [(0.0, r.s_suppkey + 100000000) for r in storage.table(spark, sf, "supplier").collect()], {}
    lines = storage.table(spark, sf, "lineitem").collect()
    closed = {(r.l_orderkey, r.l_linenumber) for r in lines if r.l_returnflag == "R"}
    for r in [r for r in lines if (r.l_orderkey, r.l_linenumber) not in closed]:
        a, b = r.l_partkey, r.l_suppkey + 100000000
        near.setdefault(a, []).append((b, r.l_quantity))
        near.setdefault(b, []).append((a, r.l_quantity))
    while heap:
        d, n = heapq.heappop(heap)
        if n not in want:
            want[n] = d
            for m, w in near.get(n, []):
                heapq.heappush(heap, (d + w, m))
    assert dict(one(catalog.QUERIES["nearest_source_distance"](spark, sf))) == want


def test_access_over_an_edge(spark):
    units = spark.createDataFrame([(1, 1, 0.25, 5.0, True), (2, 1, 0.25, 5.0, False)], "unit int, edge_id int, fraction double, snap double, accepted boolean")
    edges = spark.createDataFrame([(1, "a", "b", 100.0)], "edge_id int, a string, b string, length double")
    dist = spark.createDataFrame([("a", 10.0), ("b", 500.0)], "node string, dist double")
    assert dict(one(network.attach_unit_distance(units, edges, dist).select("unit", "distance"))) == {1: 40.0, 2: None}


def test_greedy_skips_and_goes_on(spark):
    d = spark.createDataFrame([("s", k, float(q)) for k, q in enumerate([5, 9, 3, 2, 1])], "site string, o int, q double")
    assert one(tanker.pack_units(d, ["site"], ["o"], "q", F.lit(10.0), "q").select("delivered", "units")) == [(10.0, 3)]


def test_trips(spark):
    d = spark.createDataFrame([(30.0, 20.0), (30.0, 100.0), (30.0, None)], "b double, l double")
    assert one(d.select(tanker.feasible_trips(10, F.col("b"), F.col("l"), 60.0, 5))) == [(5,), (2,), (0,)]


def test_latest_and_assumed_zero(spark):
    d = spark.createDataFrame([("A", 1, 5), ("B", 2, 6), ("B", 2, 7), ("C", 1, 8), (None, 2, 1)], "u string, t int, v int")
    assert one(keys.latest_snapshot(d, ["u"], "t", ["v"])) == [("B", 2, 7)]
    u = spark.createDataFrame([("A", 1, 10.0, 4.0), ("A", 2, 2.0, 1.0), ("C", 3, 5.0, 2.0), (None, 4, 1.0, 1.0)], "g string, unit int, people double, households double")
    o = spark.createDataFrame([("A", 10.0)], "g string, out double")
    s = {r.unit: (r.status, r.ratio) for r in scenarios.household_outages(u, o, "g").collect()}
    assert s == {1: ("reported_positive_ratio_capped", 1.0), 2: ("reported_positive_ratio_capped", 1.0), 3: ("assumed_zero_no_official_outage_listing", 0.0), 4: ("unmatched_geography", None)}
    q = scenarios.demand_scenarios(u, o, "g", "unit").collect()
    assert len(q) == 36 and all(r.demand is None for r in q if r.unit == 4)
    assert {r.demand for r in q if r.unit == 1 and r.population_case == "proportional_central"} == {30.0, 100.0, 200.0}


def test_report_text(spark):
    d = spark.createDataFrame([("8：30〜17:00", "1.234", "2026年7月4日9:05"), ("none", "約 2,500", None), (None, "不明", "")], "t string, h string, j string")
    a, b = text.time_range("t")
    assert one(d.select(a, b, text.minutes_between(a, b), text.household_count("h"))) == [("08:30", "17:00", 510, 1234), (None, None, None, 2500), (None, None, None, None)]
    assert one(d.select(text.japanese_timestamp("j").cast("string"))) == [("2026-07-04 00:05:00",), (None,), (None,)]


def test_facility_names(spark):
    d = spark.createDataFrame([("北 コミセン（東）",), ("ｱ小学校体育館",), (None,)], "n string")
    assert one(d.select(text.facility_name("n"), text.facility_name("n", False))) == [("北コミュニティセンター東",) * 2, ("ア小学校", "ア小学校体育館"), ("", "")]


def test_unique_names(spark):
    f = spark.createDataFrame([("a", "g1"), ("a", "g1"), ("b", "g1"), ("b", "g2")], "n string, g string")
    r = spark.createDataFrame([("a",), ("b",), ("c",)], "n string")
    assert sorted(one(linkage.unique_match(r, f, "n", "g"))) == [("a", 2, 1, "g1"), ("b", 2, 2, None), ("c", 0, 0, None)]


def test_html(spark):
    d = spark.createDataFrame([("<p>one&amp;two <b> three </b><br> </p>",)], "h string")
    assert one(d.select(text.html_chunks("h"))) == [(["one&two", "three"],)]


def test_boxes(spark):
    box = lambda *x: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(x, ("x0", "y0", "x1", "y1"))])
    assert one(spark.range(1).select(geo.overlap_area(box(0, 0, 2, 2), box(1, 1, 3, 3)), geo.overlap_area(box(0, 0, 1, 1), box(2, 2, 3, 3)))) == [(1.0, 0.0)]


def test_allocation_is_sound(spark):
    s = storage.table(spark, "/root/testdata/sf0.001", "supplier")
    cap = s.select(F.col("s_suppkey").alias("site"), F.floor(F.abs("s_acctbal")).cast("double").alias("capacity"))
    got = catalog.QUERIES["allocation_solution"](spark, "/root/testdata/sf0.001")
    assert tanker.violations(got, cap, "site", "unit", "demand").count() == 0
    again = catalog.QUERIES["allocation_solution"](spark, "/root/testdata/sf0.001")
    assert one(keys.signature(got, got.columns)) == one(keys.signature(again, again.columns))


def test_allocation_goes_on_to_sites_with_room(spark):
    arcs = [(1, "A", 5.0, 1.0), (2, "A", 5.0, 2.0), (3, "A", 4.0, 3.0), (3, "B", 4.0, 9.0), (4, "A", 5.0, 4.0), (4, "B", 5.0, 5.0), (4, "C", 5.0, 8.0), (5, "A", 2.0, 5.0), (6, "D", 1.0, 1.0)]
    cap = spark.createDataFrame([("A", 12.0), ("B", 4.0), ("C", 5.0)], "site string, capacity double")
    d = spark.createDataFrame(arcs, "unit long, site string, demand double, distance double")
    got = tanker.allocate(d, cap, "site", "unit", "demand", "distance")
    assert {(r.unit, r.site, r.status) for r in got.collect()} == {(1, "A", "served"), (2, "A", "served"), (3, "B", "served"), (4, "C", "served"), (5, "A", "served"), (6, None, "unserved")}
    assert tanker.violations(got, cap, "site", "unit", "demand").count() == 0 and got.first().accepted


def test_stream_of_snapshots(spark, tmp_path):
    spark.createDataFrame([("u", "2024-01-01 01:00:00", 1), ("u", "2024-01-01 05:00:00", 2), ("v", "2024-01-01 02:00:00", 3)], "k string, t string, v int").selectExpr("k", "cast(t as timestamp) t", "v").write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("k string, t timestamp, v int").parquet(f"{tmp_path}/in")
    q = latest.latest_by_key(feed, "k", "t", ["v"]).writeStream.format("memory").queryName("latest_rows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.v) for r in spark.table("latest_rows").collect()} == {("u", 2), ("v", 3)}


def test_sources(spark, tmp_path):
    (tmp_path / "20260704_0905_x.geojson").write_text('{"features": [{"properties": {"a": "1"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}')
    f = storage.geojson_features(spark, str(tmp_path)).first()
    assert f.properties == {"a": "1"} and str(f.snapshot_time) == "2026-07-04 09:05:00" and '"Point"' in f.geometry
    assert storage.file_manifest(spark, str(tmp_path)).first().bytes > 0
