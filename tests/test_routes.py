"""Routes over refill points against a search of all bases, refill points and sites by hand; eligible edges."""

import random

from test_network import dijkstra, graph, grid

from reliefgrid.operators import network, routes

BASES = "base long, candidate boolean, accepted boolean, edge_id long, fraction double, snap double, name string"
REFILLS = "refill long, x double, y double, historical boolean, name string"


def test_eligible_edges(spark):
    rows = [(1, 2, True, True, 5.0), (2, 1, True, True, 3.0), (2, 3, True, None, 1.0), (2, 3, None, True, 1.0), (2, 3, False, True, 1.0), (1, 9, True, True, 1.0), (9, 1, True, True, 1.0), (2, None, True, True, 1.0), (1, 3, True, True, None)]
    edges = spark.createDataFrame(rows, "a long, b long, ok boolean, fit boolean, w double")
    nodes = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "node long")
    got = network.build_graph(network.eligible_edges(edges, nodes, "a", "b", "ok", "fit"), "a", "b", "w")
    assert [tuple(r) for r in got.collect()] == [(1, 2, 3.0)]


def test_order_and_conditions_of_bases_and_refills(spark):
    edges = spark.createDataFrame([(1, 10, 20, 8.0)], "edge_id long, a long, b long, minutes double")
    rows = [
        (1, True, True, 1, 0.5, 100.0, None), (2, True, True, 1, 0.75, 0.0, "b"), (3, None, True, 1, 0.0, 0.0, "a"), (4, True, False, 1, 0.0, 0.0, "a"), (5, True, True, 2, 0.0, 0.0, "a"),
        (6, True, True, 1, 3.0, 0.0, "a"), (7, True, True, 1, None, 0.0, "a"), (8, True, True, 1, 0.0, None, "a"), (9, True, True, None, 0.0, 0.0, "a"),
    ]
    got = routes.base_nodes(spark.createDataFrame(rows, BASES), edges, ["name"]).orderBy("no")
    assert [(r.base, r.node, r.offset) for r in got.collect()] == [(6, 20, 0.0), (2, 20, 2.0), (1, 10, 4.3)]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], "nid long, x double, y double")
    rows = [(1, 0.0, 250.0, True, "z"), (2, 0.0, 251.0, True, "a"), (3, 990.0, 0.0, False, None), (4, 990.0, 0.0, None, "b"), (5, None, 0.0, True, "b")]
    got = routes.snapped_refills(spark.createDataFrame(rows, REFILLS), nodes, ["name"]).orderBy("no").collect()
    assert [(r.refill, r.node, r.snap, r.accepted) for r in got] == [(2, 1, 251.0, False), (4, 2, 10.0, False), (5, None, None, False), (1, 1, 250.0, True), (3, 2, 10.0, False)]


def by_hand(edges, sites, refills, bases, hours, service, limit, k):
    """refills: (refill, no, node, snap, accepted), bases: (base, no, node, offset), sites: (site, node, connector)."""
    points, legs = {}, {}
    minutes = lambda m: m / 1000 / 20 * 60
    for refill, no, node, snap, ok in refills:
        if not ok:
            continue
        dist = dijkstra(edges, [(node, 0.0)])
        ways = [(dist[n] + off, b_no, b) for b, b_no, n, off in bases if n in dist]
        if not ways or 2 * (min(ways)[0] + minutes(snap)) > 60 * hours:
            continue
        out = min(ways)[0] + minutes(snap)
        points[refill] = (min(ways)[2], out)
        for site, n, connector in sites:
            if n in dist:
                leg = dist[n] + minutes(connector) + minutes(snap)
                trips = min(limit, int((60 * hours - 2 * out) // (2 * leg + service)) if 2 * leg + service else 0)
                if trips >= 1:
                    legs.setdefault(site, []).append((2 * leg + service + 2 * out / max(limit, 1), no, refill, trips))
    return points, {s: [(r, t, m) for m, _, r, t in sorted(v)[:k]] for s, v in legs.items()}


def test_route_productivity_against_all_ways(spark):
    r = random.Random(5)
    edges = grid(r, 9)
    refills = [(100 + n, n, r.randrange(81), r.choice([0.0, 100.0, 200.0]), n % 5 > 0) for n in range(14)]
    bases = [(200 + n, n, r.randrange(81) if n else 500, r.choice([0.0, 1.5, 3.0])) for n in range(8)]
    sites = [(300 + n, r.randrange(81) if n else 500, r.choice([0.0, 100.0])) for n in range(40)]
    split = network.split_graph(graph(spark, edges), part_edges=60, cluster=8)
    frames = spark.createDataFrame(sites, "site long, node long, connector double"), spark.createDataFrame(refills, "refill long, no long, node long, snap double, accepted boolean"), spark.createDataFrame(bases, "base long, no long, node long, offset double")
    for hours, service, limit, k in ((1.0, 4.0, 3, 3), (0.5, 0.0, 5, 1), (0.2, 1.0, 2, 3)):
        got, points = routes.route_productivity(split, *frames, hours, service, limit, k)
        want_points, want = by_hand(edges, sites, refills, bases, hours, service, limit, k)
        rows = points.collect()
        assert len(rows) == len(refills)
        assert {p.refill: (p.base, round(p.base_minutes, 9)) for p in rows if p.accepted} == {p: (b, round(m, 9)) for p, (b, m) in want_points.items()}
        have = {}
        for x in got.orderBy("site", "route_rank").collect():
            have.setdefault(x.site, []).append((x.refill, x.trips, round(x.minutes, 9)))
        assert have == {s: [(p, t, round(m, 9)) for p, t, m in v] for s, v in want.items()}
        assert len(want) > 5 or hours < 0.5
    none, points = routes.route_productivity(split, *frames[:2], frames[2].where("false"), 1.0, 1.0, 3)
    assert none.count() == 0 and points.where("accepted OR base IS NOT NULL").count() == 0
