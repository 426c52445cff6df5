"""Curves of fleets by catchment, and the audit of linkages, by hand."""

from pyspark.sql import functions as F

from reliefgrid.operators import linkage, screening


def by_hand(arcs, units, catchments, fleets, load):
    need = {u: d for u, d in units if d and d > 0}
    total, out = sum(need.values()), {}
    near = {}
    for u, _, d in arcs:
        if u in need:
            near[u] = min(d, near.get(u, d))
    for name, limit in catchments:
        before = None
        for n in fleets:
            room = n * load
            for _, u in sorted((d, u) for u, d in near.items() if d <= limit):
                if need[u] <= room:
                    room -= need[u]
            share = (n * load - room) / total
            out[name, n] = (n * load - room, share, sum(need[u] for u, d in near.items() if d <= limit) / total, None if before is None else (share - before[1]) * 100 / (n - before[0]))
            before = (n, share)
    return out


def test_resource_curve(spark):
    arcs = [(u, s, float((u * 7 + s * 11) % 50)) for u in range(40) for s in range(3) if (u + s) % 4] + [(99, 0, 1.0)]
    units = [(u, float(u * 5 % 9)) for u in range(40)] + [(70, 12.0), (71, None), (72, -3.0)]
    catchments, fleets = [("none", -1.0), ("near", 10.0), ("far", 100.0)], [0, 1, 3, 50]
    a, u = spark.createDataFrame(arcs, "unit long, site long, distance double").repartition(5), spark.createDataFrame(units, "unit long, demand double")
    got = {(r.catchment, r.fleet): r for r in screening.resource_curve(a, u, catchments, [50, 0, 3, 1, 3], 13.0).collect()}
    want = by_hand(arcs, units, catchments, fleets, 13.0)
    assert set(got) == set(want)
    total = sum(d for _, d in units if d and d > 0)
    for k, (delivered, share, ceiling, gain) in want.items():
        r = got[k]
        assert (r.delivered, r.unmet) == (delivered, total - delivered)
        assert abs(r.share - share) < 1e-12 and abs(r.ceiling - ceiling) < 1e-12
        assert (r.gain is None) == (gain is None) and (gain is None or abs(r.gain - gain) < 1e-9)
    assert got["far", 50].share == got["far", 50].ceiling
    none = screening.resource_curve(a, u.where("false"), catchments[:1], [0, 1], 5.0).orderBy("fleet").collect()
    assert [(r.delivered, r.share, r.unmet, r.ceiling, r.gain) for r in none] == [(0.0, None, 0.0, None, None)] * 2


def test_coverage_audit(spark):
    d = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, None, 1), (2, "a", 2), (None, "b", 1), (3, "b", 1)], "id long, status string, at int")
    hit = F.col("status") == "a"
    parts = [linkage.Component("rows", d, hit, "r"), linkage.Component("any", d, hit, "r", ("id",)), linkage.Component("first", d, hit, "r", ("id",), F.col("at")), linkage.Component("none", d.where("false"), hit, "r"), linkage.Component("none by key", d.where("false"), hit, "r", ("id",))]
    got = [(r.component, r.total, r.success, r.unmatched, r.rate) for r in linkage.coverage_audit(parts).orderBy("place").collect()]
    assert got == [("rows", 6, 2, 4, 2 / 6), ("any", 4, 2, 2, 0.5), ("first", 4, 0, 4, 0.0), ("none", 0, 0, 0, None), ("none by key", 0, 0, 0, None)]


def test_the_audit_counts_lines_without_their_pairs(spark, monkeypatch):
    """Of the restriction query it asks only which observations have an edge."""
    from reliefgrid.operators import matching
    from reliefgrid.plans import catalog

    def pairs(*args, **kw):
        raise AssertionError("pairs of lines were made")

    sf = "/root/testdata/sf0.001"
    want = catalog.QUERIES["restriction_line_match"](spark, sf).groupBy("oid").agg({"status": "min"}).where("`min(status)` <> 'unmatched'").count()
    monkeypatch.setattr(matching, "match_ladder", pairs)
    monkeypatch.setattr(matching, "lines_within", pairs)
    got = matching.matched_lines(*catalog.facility_queries._polylines(spark, sf))
    assert got.where("matched").count() == want and got.count() == 150
    rows = {r.component: r for r in catalog.QUERIES["linkage_coverage_audit"](spark, sf).collect()}
    assert (rows["restrictions by road"].total, rows["restrictions by road"].success) == (150, want)
