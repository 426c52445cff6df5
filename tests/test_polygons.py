"""Union of areas and points inside them, on lattices, shared borders with unlike places, holes and corners."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from reliefgrid.operators import polygons as P

RINGS = f"array<{P.POINTS}>"


def areas(spark, rows):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings] if rings is not None else None) for k, rings in rows], f"key string, rings {RINGS}")


def square(x, y, s=1, way=1):
    r = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    return r[::way]


def found(df):
    return sorted((r.key, round(r.area, 9), len(r.ring)) for r in df.collect())


def test_two_squares_and_a_hole(spark):
    ring8 = [("frame", [square(i, j)]) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    rows = [("two", [square(0, 0)]), ("two", [square(1, 0, way=-1)]), ("one", [square(5, 5) + [(5, 5)]]), *ring8, ("corner", [square(0, 0)]), ("corner", [square(1, 1)])]
    d = areas(spark, rows)
    assert found(P.dissolve_rings(d, "key", 1.0)) == [("corner", 1, 4), ("corner", 1, 4), ("frame", -1, 4), ("frame", 9, 12), ("one", 1, 4), ("two", 2, 6)]
    got = {r.key: (r.parts, [len(p) for p in r.polygons], r.area) for r in P.dissolve_areas(d, "key", 1.0).collect()}
    assert got == {"two": (2, [1], 2.0), "one": (1, [1], 1.0), "frame": (8, [2], 8.0), "corner": (2, [1, 1], 2.0)}


def test_borders_with_unlike_places(spark):
    """A wide area under two narrow ones: its upper border has no place where they meet."""
    rows = [("t", [[(0, 0), (4, 0), (4, 1), (0, 1)]]), ("t", [[(0, 1), (2, 1), (2, 3), (0, 3)]]), ("t", [[(2, 1), (4, 1), (4, 2), (2, 2)]])]
    rings = P.dissolve_rings(areas(spark, rows), "key", 1.0).collect()
    assert [r.area for r in rings] == [10.0]
    lone = [("s", [[(0, 0), (3, 1), (3, 4), (0, 3)]]), ("s", [[(0, 0), (1.5, 0.5), (1.5, -2)]]), ("s", [[(1.5, 0.5), (3, 1), (1.5, -2)]])]
    assert [r.area for r in P.dissolve_rings(areas(spark, lone), "key", 1.0, 1e-9).collect()] == [pytest.approx(9 + 1.875 + 1.875)]


def test_holes_of_an_area_stay_or_are_filled(spark):
    hole = [square(0, 0, 9), square(3, 3, 3), square(4, 4, 1, -1)]  # an island in the hole
    rows = [("a", hole), ("b", hole), ("b", [square(3, 3, 3)[::-1], square(4, 4)]), ("none", None), ("empty", []), ("flat", [[(0, 0), (1, 1), (2, 2)]]), ("dots", [[(0, 0), (0, 0), (1, 0)]])]
    d = areas(spark, rows)
    assert found(P.dissolve_rings(d, "key", 5.0)) == [("a", -9, 4), ("a", 1, 4), ("a", 81, 4), ("b", 81, 4)]
    got = {r.key: (r.parts, r.polygons and sorted(len(p) for p in r.polygons), r.area) for r in P.dissolve_areas(d, "key", 5.0).collect()}
    assert got["a"] == (1, [1, 2], 73.0) and got["b"] == (2, [1], 81.0)
    assert got["none"] == got["empty"] == got["flat"] == got["dots"] == (1, None, None)


def test_overlaps_are_an_error(spark):
    d = areas(spark, [("x", [square(0, 0)]), ("x", [square(0, 0)])])
    with pytest.raises(Exception, match="areas overlap in x"):
        P.dissolve_rings(d, "key", 1.0).collect()


def test_a_comb_of_many_places(spark):
    """One ring of 2000 places takes about eleven rounds of doubling, and its places come in turn."""
    top = [(k, 1 + k % 2 * 0.5) for k in range(1000, -1, -1)]
    low = [(k, 0) for k in range(1001)]
    (r,) = P.dissolve_rings(areas(spark, [("c", [low + top])]), "key", 10.0).collect()
    assert len(r.ring) == 2002 and r.area == pytest.approx(1250.0)
    want = low + [(float(x), float(y)) for x, y in top]
    at = want.index((r.ring[0].x, r.ring[0].y))
    assert [(p.x, p.y) for p in r.ring] == [*want[at:], *want[:at]]


def test_random_lattices(spark):
    r = random.Random(3)
    cells = [(g, i, j) for g in "pq" for i in range(12) for j in range(12) if r.random() < 0.6]
    got = P.dissolve_rings(areas(spark, [(g, [square(i, j, way=r.choice([1, -1]))]) for g, i, j in cells]), "key", 3.0).collect()
    for g in "pq":
        own = {(i, j) for k, i, j in cells if k == g}
        assert sum(x.area for x in got if x.key == g) == len(own)
        border = sum((i + a, j + b) not in own for i, j in own for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert sum(len(x.ring) for x in got if x.key == g) == border
        seen, parts = set(), 0
        for c in own:
            if c not in seen:
                parts, todo = parts + 1, [c]
                while todo:
                    i, j = todo.pop()
                    if (i, j) in own and (i, j) not in seen:
                        seen.add((i, j))
                        todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        assert sum(x.area > 0 for x in got if x.key == g) == parts


def inside(x, y, rings):
    n = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                n += 1
    return n % 2 == 1


def test_points_lie_inside(spark):
    r = random.Random(9)
    shapes = [[square(0, 0)], [[(0, 0), (9, 0), (9, 9), (8, 9), (8, 1), (1, 1), (1, 9), (0, 9)]], [square(0, 0, 9), square(1, 1, 7)], [[(0, 0), (4, 2), (0, 4), (1, 2)]]]
    for _ in range(60):
        n = r.randint(3, 12)
        shapes.append([[(math.cos(2 * math.pi * k / n) * (s := r.uniform(1, 9)), math.sin(2 * math.pi * k / n) * s) for k in range(n)]])
    rows = [(str(k), x) for k, x in enumerate(shapes)] + [("none", None), ("empty", []), ("line", [[(0, 0), (1, 0)]]), ("flat", [[(0, 0), (1, 1), (2, 2)]])]
    got = {r.key: r.p for r in areas(spark, rows).select("key", P.point_on_surface(F.col("rings")).alias("p")).collect()}
    for k, s in enumerate(shapes):
        assert inside(got[str(k)].x, got[str(k)].y, s)
    assert got["none"] is got["empty"] is got["line"] is None
    assert tuple(got["1"]) == (0.5, 5.0)  # the left arm


def frames(n):
    """n frames in a row, each with a hole of two squares that touch in a corner, and an island in every third frame."""
    rows = []
    for k in range(n):
        own = [(i, j) for i in range(7) for j in range(7) if not (1 <= i <= 4 and 1 <= j <= 4) and (i, j) != (5, 5)]
        own += [(2, 2)] * (k % 3 == 0)
        rows += [("g", [square(8 * k + i, j)]) for i, j in own]
    return rows


def test_rings_that_are_done_are_read_no_more(spark, monkeypatch):
    """One ring of 802 places, which takes ten rounds, beside 900 of four: the rounds write the short ones three times at most."""
    wide = [(k, 0) for k in range(401)] + [(k, 1 + k % 2) for k in range(400, -1, -1)]
    rows = [("a", [wide])] + [("a", [square(2 * i, 10 + 2 * j)]) for i in range(30) for j in range(30)]
    written, stored = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df: (lambda out: (written.append(out.count()) if "id" in out.columns else None, out)[1])(stored(df)))
    rings = P.dissolve_rings(areas(spark, rows), "key", 5.0).collect()
    assert sorted(len(r.ring) for r in rings) == [4] * 900 + [802]
    steps = 3600 + 802
    assert sum(written) < 5 * steps + 12 * 802


def test_holes_find_their_polygons_without_meeting_all(spark):
    got = P.dissolve_polygons(areas(spark, frames(9)), "key", 2.0)
    assert sorted((len(r.rings), r.area) for r in got.collect()) == [(1, 1.0)] * 3 + [(2, 32.0)] * 9
    for r in got.collect():
        out = r.rings[0]
        for hole in r.rings[1:]:
            assert min(p.x for p in out) < min(p.x for p in hole) and max(p.x for p in hole) < max(p.x for p in out)
    d = P.dissolve_areas(areas(spark, frames(9)), "key", 2.0)
    assert sorted(len(p) for p in d.first().polygons) == [1] * 3 + [2] * 9
    # rings of a key are not joined with all others of it
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[key#\d+\], \[key#\d+\], Inner", plan)


def test_a_hole_beside_holes_and_slanted_borders(spark):
    """Holes in a row, of which only the first has the outer ring to its left, in cells far narrower than the gaps; slanted ones that meet heights of places."""
    holes = [[(10 + 4 * k, 5), (11 + 4 * k, 6), (10 + 4 * k, 7), (9 + 4 * k, 6)] for k in range(12)] + [[(30, 1), (40, 2), (30, 3)], [(20, 1), (22, 2), (20, 3)]]
    rows = [("a", [[(0, 0), (60, 0), (70, 6), (60, 9), (0, 9)], *holes]), ("a", [square(30.25, 5.75, 0.5)]), ("b", [square(0, 0, 9), square(1, 1, 7)])]
    got = P.dissolve_polygons(areas(spark, rows), "key", 0.7)
    found = sorted((r.key, len(r.rings), round(r.area, 6)) for r in got.collect())
    outer = 9 * 60 + 9 * 10 / 2
    assert found == [("a", 1, 0.25), ("a", 15, outer - 12 * 2 - 10 - 2), ("b", 2, 32.0)]
