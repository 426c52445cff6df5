"""Polygons as wholes: union of areas that tile a plane, and points inside them.

Areas are (key, rings): rings an array of arrays of struct<x, y>, in any direction; a ring inside an odd number of others of
its area is a hole. The first place of a ring may be repeated at its end.

Union: each ring is turned so that the inside lies to the left of its steps. Where two areas of a key touch, their common
border is a step there and a step back, and an aggregation cancels both; steps are cut first at the places of the key that
lie on them, so that neighbours need not have the same places. What is left are the union's borders. A step goes on
with that step from its end which comes first clockwise from where it came: the inside stays on the left, and areas that touch
in a place stay apart. Rings are then found by pointer doubling: after k rounds a step knows the least step of the next 2^k,
and how far it is; no ring passes through one task before it is done. A hole belongs to the ring that is met next to its left, or
to that one's, if it is a hole: rings are not held against each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.nulls import bound
from reliefgrid.operators.geo import in_ring
from reliefgrid.operators.keys import number_rows
from reliefgrid.sources.storage import stored

POINTS = "array<struct<x: double, y: double>>"


def signed_area(ring: Column) -> Column:
    """Positive if the ring goes counterclockwise. Taken from the first place, so that far coordinates lose nothing."""
    n, at = F.size(ring), lambda i: F.element_at(ring, (F.pmod(i, F.size(ring)) + 1).cast("int"))
    x0, y0 = ring[0]["x"], ring[0]["y"]
    cross = lambda i: (at(i)["x"] - x0) * (at(i + 1)["y"] - y0) - (at(i + 1)["x"] - x0) * (at(i)["y"] - y0)
    return F.when(n < 3, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + cross(i)) / 2)


def ring_area(rings: Column) -> Column:
    """Of oriented rings: holes, which go clockwise, count below zero."""
    return F.aggregate(F.transform(rings, signed_area), F.lit(0.0), lambda s, a: s + a)


def open_ring(ring: Column) -> Column:
    """The ring without a last place that repeats the first, and without places that repeat the one before."""
    kept = F.filter(ring, lambda p, i: (i == 0) | (p != F.element_at(ring, F.greatest(i, F.lit(1)))))
    return bound(kept, lambda r: F.when((F.size(r) > 1) & (r[0] == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r))


def oriented(areas: DataFrame) -> DataFrame:
    """areas with rings turned: outer ones counterclockwise, holes clockwise; rings of fewer than three places, or without an
    area, go. A ring is a hole if an odd number of the area's other rings hold its lowest step's middle."""
    rings = F.filter(F.transform("rings", open_ring), lambda r: F.size(r) > 2)

    def depth(r: Column, k: Column, all_: Column) -> Column:
        x, y = (r[0]["x"] + r[1]["x"]) / 2, (r[0]["y"] + r[1]["y"]) / 2
        held = F.filter(all_, lambda other, j: (j != k) & in_ring(x, y, other))
        return F.size(held)

    def turn(all_: Column) -> Column:
        right = lambda r, k: (signed_area(r) > 0) == (depth(r, k, all_) % 2 == 0)
        return F.filter(F.transform(all_, lambda r, k: F.when(right(r, k), r).otherwise(F.reverse(r))), lambda r: signed_area(r) != 0)

    return areas.withColumn("rings", bound(rings, turn))


def _steps(areas: DataFrame, key: str) -> DataFrame:
    # outer, so that no filter on what is exploded works it out a second time, before the areas are dealt
    ring = oriented(areas).select(key, F.explode_outer("rings").alias("r")).where("r IS NOT NULL")
    at = lambda i: F.element_at("r", (F.pmod(i, F.size("r")) + 1).cast("int"))
    s = ring.select(key, F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b")))).alias("s"))
    return s.select(key, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def _netted(steps: DataFrame, key: str) -> DataFrame:
    """key, lo, hi, way: how many more times a step goes from lo to hi than back, if not as often. steps have a `way` of their own."""
    forth = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    s = steps.select(key, F.when(forth, a).otherwise(b).alias("lo"), F.when(forth, b).otherwise(a).alias("hi"), F.when(forth, F.col("way")).otherwise(-F.col("way")).alias("way"))
    return s.groupBy(key, "lo", "hi").agg(F.sum("way").alias("way")).where("way <> 0")


def _turned(netted: DataFrame, key: str) -> DataFrame:
    """Netted steps the way they go, `way` times."""
    a, b = F.when(F.col("way") > 0, F.col("lo")).otherwise(F.col("hi")), F.when(F.col("way") > 0, F.col("hi")).otherwise(F.col("lo"))
    return netted.select(key, a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.abs("way").alias("way"))


def _cut(steps: DataFrame, key: str, cell: float, slack: float) -> DataFrame:
    """Steps (each once, with its `way`) cut at the places of their key that lie on them (within slack, but not at their ends)."""
    from reliefgrid.operators.polylines import cells_along

    at = lambda c: F.floor(F.col(c) / cell)
    places = steps.select(key, F.col("ax").alias("x"), F.col("ay").alias("y")).distinct().withColumn("cx", at("x")).withColumn("cy", at("y"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)
    off = F.abs((F.col("x") - F.col("ax")) * dy - (F.col("y") - F.col("ay")) * dx) / F.sqrt(dx * dx + dy * dy)
    ends = ((F.col("x") == F.col("ax")) & (F.col("y") == F.col("ay"))) | ((F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")))
    step = [key, "ax", "ay", "bx", "by"]
    met = cells_along(steps.drop("way"), cell, slack).join(places, [key, "cx", "cy"]).where(~ends & (t > 0) & (t < 1) & (off <= slack))
    cuts = met.groupBy(*step).agg(F.array_sort(F.collect_set(F.struct(t.alias("t"), "x", "y"))).alias("cuts"))
    d = steps.join(cuts, step, "left")
    way = F.concat(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))), F.transform("cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), F.array(F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    way = F.when(F.col("cuts").isNull(), F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).otherwise(way)
    d = d.select(key, "way", way.alias("w"))
    d = d.select(key, "way", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b")))).alias("s"))
    return d.select(key, "way", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def outline_steps(areas: DataFrame, key: str, cell: float, slack: float = 0.0) -> DataFrame:
    """key, ax, ay, bx, by: the steps of the union's borders, the inside to the left. Areas of a key may touch, but not overlap:
    a border that two areas have on the same side is an error when it is read. Steps there and back that are equal cancel before
    any is cut."""
    s = _cut(stored(_turned(_netted(_steps(areas, key).withColumn("way", F.lit(1)), key), key)), key, cell, slack)
    s = _netted(s, key)
    one = F.when(F.abs("way") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("areas overlap in "), F.col(key).cast("string"))).cast("boolean"))
    return _turned(s.where(one), key).drop("way")


def ring_order(steps: DataFrame, key: str) -> DataFrame:
    """steps with `ring` (the least number of its steps) and `place` (0, 1, ... from that step on), by pointer doubling. A step that
    has met the same least number twice has been around its ring, and is read no more; nor is one whose next has."""
    s = stored(number_rows(steps, [key, "ax", "ay", "bx", "by"], "id"))
    # how far clockwise from the way back a step from the end leaves
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    out = s.select(key, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("id").alias("next"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("leaves"))
    turn = F.pmod(F.col("back") - F.col("leaves"), F.lit(2 * 3.141592653589793))
    turn = F.when(turn < 1e-12, F.lit(7.0)).otherwise(turn)  # the way back itself comes last
    go = s.withColumn("back", back).join(out, [key, "bx", "by"]).groupBy("id").agg(F.min(F.struct(turn.alias("turn"), "next")).alias("n")).select("id", F.col("n.next").alias("next"))
    # windows of 2^k steps: the least step in them, and how far it is
    at = stored(go.select("id", "next", F.col("id").alias("ring"), F.lit(0).cast("long").alias("far")))
    done, length = [], 1
    while not at.isEmpty():
        ahead = at.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("ring").alias("other"), F.col("far").alias("more"))
        falls = F.col("other") < F.col("ring")
        around = F.col("then").isNull() | (F.col("other") == F.col("ring"))
        to = at.join(ahead, "next", "left").select("id", F.when(~around, F.col("then")).alias("next"), F.when(falls, F.col("other")).otherwise(F.col("ring")).alias("ring"), F.when(falls, F.col("more") + length).otherwise(F.col("far")).alias("far"))
        at = stored(to)
        done.append(at.where("next IS NULL").select("id", "ring", "far"))
        at, length = at.where("next IS NOT NULL"), 2 * length
    ring = reduce(DataFrame.union, done) if done else at.select("id", "ring", "far")
    size = F.max("far").over(Window.partitionBy("ring")) + 1
    return s.join(ring, "id").withColumn("place", F.pmod(-F.col("far"), size)).select(*steps.columns, "ring", "place")


def _as_rings(placed: DataFrame, key: str) -> DataFrame:
    """key, id (the number of its least step), ring, area."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("ax").alias("x"), F.col("ay").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return placed.groupBy(key, F.col("ring").alias("id")).agg(ring.alias("ring")).withColumn("area", signed_area(F.col("ring")))


def dissolve_rings(areas: DataFrame, key: str, cell: float, slack: float = 0.0) -> DataFrame:
    """key, ring (places in turn; outer ones counterclockwise, holes clockwise), area (holes below zero): the union's rings, one
    row each. cell: width of the grid that finds places on borders, about a border's length."""
    return _as_rings(ring_order(outline_steps(areas, key, cell, slack), key), key).drop("id")


def _left_of(holes: DataFrame, placed: DataFrame, key: str, cell: float) -> DataFrame:
    """hole, up: the ring of the first step to the left of each hole's leftmost place (hole, key, x, y), a hair above it. Between
    them lies the inside, so `up` is the ring around the hole, or another hole of the same polygon. Cells of a row of cells are
    numbered from left to right; a hole looks into its own, then into the next 2, 4, ... that hold steps."""
    from reliefgrid.operators.polylines import cells_along

    in_cells = stored(cells_along(placed.where("ay <> by").select(key, "ax", "ay", "bx", "by", "ring"), cell, 0.0))
    own = stored(holes.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)))
    grid = stored(number_rows(in_cells.select(key, "cy", "cx").union(own.select(key, "cy", "cx")).distinct(), [key, "cy", "cx"], "at"))
    steps = stored(in_cells.join(grid, [key, "cx", "cy"]).select("at", "cx", "ax", "ay", "bx", "by", "ring"))
    first = grid.groupBy(key, "cy").agg(F.min("at").alias("first"))
    todo = stored(own.join(grid, [key, "cx", "cy"]).join(first, [key, "cy"]).select("hole", "x", "y", "at", "first"))
    slope = (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    x = F.when(F.col("ay") == F.col("y"), F.col("ax")).when(F.col("by") == F.col("y"), F.col("bx"))
    x = x.otherwise(F.least(F.greatest("ax", "bx"), F.greatest(F.least("ax", "bx"), F.col("ax") + (F.col("y") - F.col("ay")) * slope)))
    meets = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (x < F.col("x")) & (F.floor(x / cell) == F.col("cx"))
    found, span = [], 1
    while not todo.isEmpty():
        look = todo.select("hole", "x", "y", F.explode(F.sequence(F.greatest("first", F.col("at") - span + 1), "at")).alias("at"))
        hit = stored(look.join(steps, "at").where(meets).groupBy("hole").agg(F.max_by("ring", F.struct(x.alias("x"), slope.alias("slope"))).alias("up")))
        found.append(hit)
        todo = stored(todo.join(hit, "hole", "left_anti").withColumn("at", F.col("at") - span).where("at >= first"))
        span *= 2
    return reduce(DataFrame.union, found) if found else holes.select("hole", F.col("hole").alias("up"))


def dissolve_polygons(areas: DataFrame, key: str, cell: float, slack: float = 0.0) -> DataFrame:
    """key, rings (the outer one first, then its holes), area: the union's polygons, one row each. A hole belongs to the outer ring
    next around it."""
    placed = stored(ring_order(outline_steps(areas, key, cell, slack), key))
    rings = stored(_as_rings(placed, key))
    v = F.array_min("ring")
    at = _left_of(rings.where("area < 0").select(F.col("id").alias("hole"), key, v["x"].alias("x"), v["y"].alias("y")), placed, key, cell)
    # from hole to hole until a ring that is none
    at = stored(at)
    while True:
        ahead = at.select(F.col("hole").alias("up"), F.col("up").alias("then"))
        at = stored(at.join(ahead, "up", "left").select("hole", F.coalesce("then", "up").alias("up"), F.col("then").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
    inner = rings.where("area < 0").select(F.col("id").alias("hole"), "area", "ring").join(at, "hole")
    inner = inner.groupBy(F.col("up").alias("id")).agg(F.array_sort(F.collect_list(F.struct("area", "ring"))).alias("holes"), F.sum("area").alias("less"))
    all_ = F.concat(F.array("ring"), F.coalesce(F.transform("holes", lambda x: x["ring"]), F.array().cast(f"array<{POINTS}>")))
    return rings.where("area > 0").join(inner, "id", "left").select(key, all_.alias("rings"), (F.col("area") + F.coalesce("less", F.lit(0.0))).alias("area"))


def dissolve_areas(areas: DataFrame, key: str, cell: float, slack: float = 0.0) -> DataFrame:
    """key, parts (how many areas it had), polygons (array of arrays of rings, the outer one first, then its holes), area. A key's
    polygons are one value; `dissolve_polygons` gives a row for each."""
    one = dissolve_polygons(areas, key, cell, slack).withColumn("outer", signed_area(F.col("rings")[0]))
    made = one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("outer", "rings"))), lambda x: x["rings"]).alias("polygons"), F.sum("area").alias("area"))
    return areas.groupBy(key).agg(F.count(F.lit(1)).alias("parts")).join(made, key, "left").select(key, "parts", "polygons", "area")


def point_on_surface(rings: Column) -> Column:
    """A place inside an area (rings, in any direction): on the line halfway between the heights of places that are next to its
    middle height, below or at it and above it, the middle of the widest stretch inside (ties: the one to the left). So the
    line meets no place of a ring. Null without an area."""
    ys = F.array_sort(F.array_distinct(F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))))

    def height(y: Column) -> Column:
        mid = (y[0] + F.element_at(y, -1)) / 2
        low, high = F.array_max(F.filter(y, lambda v: v <= mid)), F.array_min(F.filter(y, lambda v: v > mid))
        return F.when(F.size(y) > 1, (low + high) / 2)

    def crossings(y: Column) -> Column:
        def of(r: Column) -> Column:
            at = lambda i: F.element_at(r, (F.pmod(i, F.size(r)) + 1).cast("int"))
            hit = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (at(i)["y"] > y) != (at(i + 1)["y"] > y))
            return F.transform(hit, lambda i: at(i)["x"] + (y - at(i)["y"]) / (at(i + 1)["y"] - at(i)["y"]) * (at(i + 1)["x"] - at(i)["x"]))

        return F.array_sort(F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), of)))

    def widest(x: Column, y: Column) -> Column:
        stretch = F.transform(F.sequence(F.lit(1), (F.size(x) / 2).cast("int")), lambda k: F.struct((F.element_at(x, k * 2) - F.element_at(x, k * 2 - 1)).alias("w"), (-F.element_at(x, k * 2 - 1)).alias("left"), ((F.element_at(x, k * 2) + F.element_at(x, k * 2 - 1)) / 2).alias("x")))
        best = F.array_max(stretch)
        return F.when((F.size(x) > 1) & (best["w"] > 0), F.struct(best["x"].alias("x"), y.alias("y")))

    return bound(bound(ys, height), lambda y: F.when(y.isNotNull(), bound(crossings(y), lambda x: F.when(F.size(x) > 1, widest(x, y)))))
