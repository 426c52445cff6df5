"""Which units a plan reaches: feasible arcs, whole-unit packing from a pool, scenarios of failures, and what points need.

Arcs are (unit, site, distance). Structures are the combinations of a road state and a point state; each has its own arcs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.nulls import safe_ratio
from reliefgrid.operators.keys import top_by
from reliefgrid.operators.network import SplitGraph, along_edge, nearest_distance
from reliefgrid.sources.storage import checkpoint, stored

#: Units of one scenario that are packed by a fold in one row; of more, those that fit by a running sum go first.
FOLD = 4096
#: Rows that may still be served are written when they are one in so many of those that a round reads.
KEEP = 8
#: Kilometres an hour on the connector between a site and its node.
CONNECTOR_SPEED = 20.0
SLACK = 1e-9


def edge_lookup(edges: DataFrame, edge_id: str, order: list[str]) -> DataFrame:
    """One row for each edge id: the first in order."""
    return top_by(edges.where(F.col(edge_id).isNotNull()), [edge_id], [F.asc(c) for c in order])


def connector_minutes(metres: Column) -> Column:
    return metres / 1000 / CONNECTOR_SPEED * 60


def _access_ends(units: DataFrame, edges: DataFrame) -> DataFrame:
    """unit, node, rest: both ends of each unit's access edge, and what is left from there."""
    u = units.select("unit", "edge_id", "fraction", "snap").join(edges.select("edge_id", "a", "b", "length"), "edge_id")
    return u.select("unit", F.col("a").alias("node"), (F.col("fraction") * F.col("length") + F.col("snap")).alias("rest")).union(u.select("unit", "b", (1 - F.col("fraction")) * F.col("length") + F.col("snap")))


def feasible_arcs(matrix: DataFrame, units: DataFrame, edges: DataFrame, sites: DataFrame, limit: float) -> DataFrame:
    """(unit, site, distance) within the limit: the way from the site's node to the nearer end of the unit's access edge, along
    it, and both connectors. matrix: (site, node, dist) within the limit; units: (unit, edge_id, fraction, snap); edges:
    (edge_id, a, b, length); sites: (site, connector). Whether the unit's snap was accepted is not asked."""
    d = matrix.join(_access_ends(units, edges), "node").groupBy("unit", "site").agg(F.min(F.col("dist") + F.col("rest")).alias("way")).join(sites.select("site", "connector"), "site")
    return d.select("unit", "site", (F.col("way") + F.col("connector")).alias("distance")).where(F.col("distance") <= limit)


def reachable_arcs(graph: DataFrame | SplitGraph, units: DataFrame, edges: DataFrame, sites: DataFrame, reach: float, limit: float) -> DataFrame:
    """What `feasible_arcs` gives for the matrix of the sites' nodes (site, node, connector; a node each) within `reach`, without its rows:
    units are met where distances are found. Units and connectors aren't null."""
    least = sites.agg(F.least(F.lit(0.0), F.min("connector"))).first()[0]
    ends = _access_ends(units, edges).select("node", F.col("unit").alias("end"), "rest")
    d = nearest_distance(graph, sites.select("site", "node", F.lit(0.0).alias("offset")), cutoff=reach, by=["site"], ends=ends, most=limit - least)
    d = d.join(F.broadcast(sites.select("site", "connector")), "site")
    return d.select(F.col("end").alias("unit"), "site", (F.col("dist") + F.col("connector")).alias("distance")).where(F.col("distance") <= limit)


def base_seeds(bases: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, offset) of each base (base, edge_id, fraction, connector): both ends of its edge, by minutes of the edge and of the
    connector; the least of a node."""
    d = bases.join(edges.select("edge_id", "a", "b", "minutes"), "edge_id")
    out = connector_minutes(F.col("connector"))
    both = d.select(F.col("a").alias("node"), (out + F.col("fraction") * F.col("minutes")).alias("offset")).union(d.select("b", out + (1 - F.col("fraction")) * F.col("minutes")))
    return both.groupBy("node").agg(F.min("offset").alias("offset"))


def point_minutes(points: DataFrame, dist: DataFrame) -> DataFrame:
    """points (point, node, connector) with the minutes from the nearest base over the network and the connector; null if no base
    reaches the node. dist: (node, dist)."""
    d = points.join(dist.select("node", "dist"), "node", "left")
    return d.select("point", (F.col("dist") + connector_minutes(F.col("connector"))).alias("minutes"))


def demand_units(demand: DataFrame, access: DataFrame, edges: DataFrame) -> DataFrame:
    """The units (unit) with a positive demand, with their access and its edge; a unit without one keeps nulls."""
    return demand.where("water > 0").join(access, "unit", "left").join(edges, "edge_id", "left")


def representative_weights(rows: DataFrame, representative: str, weight: str) -> DataFrame:
    """The weight of all rows that stand behind one representative."""
    return rows.where(F.col(representative).isNotNull()).groupBy(representative).agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias(weight))


def nearest_arc(arcs: DataFrame, by: list[str]) -> DataFrame:
    """Each unit's nearest arc in each structure; of equal distances the lower site."""
    return arcs.groupBy(*by, "unit").agg(F.min(F.struct("distance", "site")).alias("x")).select(*by, "unit", "x.distance", "x.site")


def fail_heaviest(arcs: DataFrame, water: DataFrame, by: list[str]) -> DataFrame:
    """arcs without those of the site that, in its structure, has most water of nearest units (ties: lower site)."""
    load = nearest_arc(arcs, by).join(water, "unit").groupBy(*by, "site").agg(F.sum("water").alias("load"))
    gone = load.groupBy(*by).agg(F.max_by("site", F.struct("load", -F.col("site"))).alias("site"))
    return arcs.join(F.broadcast(gone), [*by, "site"], "left_anti")


def _running(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with `upto_`, the sum of value up to each row: ranges over keys and order, and the ranges' sums before them."""
    d = checkpoint(df.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id()))
    sums = d.groupBy(*keys, "part_").agg(F.sum(value).alias("sum_"))
    before = sums.select(*keys, "part_", (F.sum("sum_").over(Window.partitionBy(*keys).orderBy("part_")) - F.col("sum_")).alias("before_"))
    within = F.sum(value).over(Window.partitionBy(*keys, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("within_", within).join(F.broadcast(before), [*keys, "part_"]).withColumn("upto_", F.col("before_") + F.col("within_")).drop("part_", "before_", "within_")


def _bin(c: Column) -> Column:
    """A whole number that never falls as c grows, null and NaN as Spark sorts them: 1/64 of c's logarithm apart."""
    c = c.cast("double")
    number = F.when(F.isnan(c), 1 << 30).otherwise(F.floor(F.signum(c) * F.log1p(F.abs(c)) * 64))
    return F.coalesce(number, F.lit(-(1 << 30))).cast("int")


def pack_pool(rows: DataFrame, keys: list[str], order: list[str], water: str, capacity: str, fold: int = FOLD) -> DataFrame:
    """The rows that a scenario's pool serves: in order, each unit whole if it fits into what is left, else it is skipped.

    Scenarios with more than `fold` rows first take, in rounds, the rows whose running sum fits: the next one doesn't, and of
    the rows after it only those that fit into the rest stay. The last of them go through a fold of one row a scenario.
    capacity is a column of rows, equal within a scenario; rows without water aren't served. order begins with a number.

    rows are read anew in each round: a scenario's state is what is left of its pool and the last row that it took, and sums by
    bins of the first column of order tell how far a round can come; only rows up to there are sorted. What may still be
    served is written when it has fallen to one KEEP-th of what is read.
    """
    fields = [c for c in rows.columns if c not in keys]
    full = [*order, *[c for c in fields if c not in order]]
    place = F.struct(*full)
    kind = rows.select(place.alias("x")).schema["x"].dataType
    left = rows.where((F.col(water) > 0) & (F.col(water) <= F.col(capacity) + SLACK)).withColumn("room_", F.col(capacity).cast("double"))
    done, state, read = [], None, None

    def open_rows() -> DataFrame:
        on = rows.where((F.col(water) > 0) & (F.col(water) <= top + SLACK)).join(F.broadcast(state), keys)
        return on.where((F.col(water) <= F.col("room_") + SLACK) & (F.col("after_").isNull() | (place > F.col("after_"))))

    while True:
        sums = stored(left.groupBy(*keys, _bin(F.col(order[0])).alias("bin_")).agg(F.sum(water).alias("sum_"), F.count(F.lit(1)).alias("n_"), F.max("room_").alias("room_")))
        before = F.sum("sum_").over(Window.partitionBy(*keys).orderBy("bin_")) - F.col("sum_")
        reach = F.max(F.when(F.col("before_") <= F.col("room_") * (1 + SLACK) + SLACK, F.col("bin_"))).alias("last_")
        ends = stored(sums.withColumn("before_", before).groupBy(*keys).agg(reach, F.sum("n_").alias("n_"), F.max("room_").alias("room_")))
        total, most, last = ends.agg(F.coalesce(F.sum("n_"), F.lit(0)), F.coalesce(F.max("n_"), F.lit(0)), F.max(F.when(F.col("n_") > fold, F.col("last_")))).first()
        if most <= fold:
            break
        if read is None:
            read = total
        elif total * KEEP <= read:
            rows, read = stored(left.select(*rows.columns)), total
            left = open_rows()
        if state is None:
            state = ends.select(*keys, "room_", F.lit(None).cast(kind).alias("after_"))
        now = left.where(_bin(F.col(order[0])) <= last).join(F.broadcast(ends.where(F.col("n_") > fold).select(*keys, "last_")), keys).where(_bin(F.col(order[0])) <= F.col("last_")).drop("last_", "after_")
        run = stored(_running(now, keys, full, water))
        fits = run.where(F.col("upto_") <= F.col("room_") + SLACK)
        done.append(fits.select(*rows.columns))
        moved = fits.groupBy(*keys).agg(F.sum(water).alias("used_"), F.max(place).alias("took_"))
        state = stored(state.join(moved, keys, "left").select(*keys, (F.col("room_") - F.coalesce("used_", F.lit(0.0))).alias("room_"), F.coalesce("took_", "after_").alias("after_")))
        top = state.agg(F.max("room_")).first()[0]
        left = open_rows()
    each = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in fields if c not in order])
    d = left.groupBy(*keys).agg(F.first("room_").alias("room_"), F.array_sort(F.collect_list(each)).alias("u_"))
    step = lambda s, u: F.when(u[water] <= s["room"] + SLACK, F.struct((s["room"] - u[water]).alias("room"), F.lit(True).alias("in"))).otherwise(F.struct(s["room"].alias("room"), F.lit(False).alias("in")))
    # the fold keeps the places of what it takes as a text of 0 and 1
    start = F.struct(F.col("room_").alias("room"), F.lit("").alias("mark"))

    def take(s: Column, u: Column) -> Column:
        now = step(s, u)
        return F.struct(now["room"].alias("room"), F.concat(s["mark"], F.when(now["in"], "1").otherwise("0")).alias("mark"))

    marked = d.withColumn("mark_", F.aggregate("u_", start, take)["mark"])
    kept = F.filter("u_", lambda u, i: F.substring(F.col("mark_"), i + 1, F.lit(1)) == "1")
    folded = marked.select(*keys, F.explode(kept).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in fields]).select(*rows.columns)
    return reduce(DataFrame.unionByName, done, folded)


def screen_factorial(arcs: DataFrame, cells: DataFrame, routes: DataFrame, structures: list[tuple[str, str]], fleets: list[int], litres: float) -> DataFrame:
    """One row for each structure, demand cell and fleet: protected share of people, unmet water, mean distance by people, sites
    used, and whether a route is feasible. Structures without arcs or routes stay, with share 0 and all water unmet.

    arcs: (road_state, point_state, unit, site, distance); cells: (unit, outage_case, demand_case, people, water); routes: (site,
    trips). A fleet's pool is fleet * most trips of a vehicle * litres, over the routes of sites that have an arc.
    """
    by, cell = ["road_state", "point_state"], ["outage_case", "demand_case"]
    spark = arcs.sparkSession
    plan = spark.createDataFrame([(r, p, f) for r, p in structures for f in fleets], "road_state string, point_state string, fleet int")
    trips = arcs.select(*by, "site").distinct().join(routes, "site").groupBy(*by).agg(F.max("trips").alias("trips"))
    plan = plan.join(F.broadcast(trips), by, "left").withColumn("capacity", F.col("fleet") * F.coalesce("trips", F.lit(0)) * F.lit(litres))
    # a row a unit, with its arcs and cells as lists: their pairs are made where they are read
    own = nearest_arc(arcs, by).groupBy("unit").agg(F.collect_list(F.struct(*by, "distance", "site")).alias("n_"))
    asked = cells.where("water > 0").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct(*cell, "people", "water"))).alias("c_"))
    least = F.array_min(F.transform("c_", lambda c: c["water"])).alias("least_")
    near = stored(own.join(asked.select("unit", "c_", F.md5(F.to_json("c_").cast("binary")).alias("same_"), least), "unit"))
    lists = stored(near.groupBy("same_").agg(F.first("c_").alias("c_")))
    # units that ask for the same are taken from a pool in order until one doesn't fit, and none after it: no more than fill the pool
    same = [*by, "same_", "bin_"]
    near = near.select("unit", "same_", "least_", F.inline("n_")).withColumn("bin_", _bin(F.col("distance")))
    ahead = stored(near.groupBy(*same, "least_").agg(F.count(F.lit(1)).alias("n_")))
    before = F.sum("n_").over(Window.partitionBy(*by, "same_").orderBy("bin_")) - F.col("n_")
    pools = plan.where("capacity > 0").select(*by, "fleet", "capacity")
    fits = lambda water: F.col("ahead_") <= F.col("capacity") / F.col(water) + 1
    most = pools.groupBy(*by).agg(F.max("capacity").alias("capacity"))
    reached = ahead.withColumn("ahead_", before).join(F.broadcast(most), by).where(fits("least_")).select(*same, "ahead_")
    open_ = near.join(stored(reached), same).select("unit", *by, "distance", "site", "same_", "ahead_")
    open_ = open_.join(lists, "same_").select("unit", *by, "distance", "site", "ahead_", F.inline("c_")).join(F.broadcast(pools), by).where(fits("water"))
    open_ = stored(open_.drop("ahead_"))
    keys = [*by, *cell, "fleet"]
    served = pack_pool(open_.select(*keys, "distance", "water", "unit", "site", "people", "capacity"), keys, ["distance", "water", "unit", "site"], "water", "capacity")
    got = served.groupBy(*keys).agg(F.sum("people").alias("people"), F.sum("water").alias("water"), F.sum(F.col("people") * F.col("distance")).alias("way"), F.count_distinct("site").alias("sites"))
    all_ = cells.groupBy(*cell).agg(F.sum("people").alias("all_people"), F.sum("water").alias("all_water"))
    feasible = ahead.select(*by, "same_").distinct().join(lists, "same_").select(*by, F.inline("c_")).select(*by, *cell).distinct().withColumn("units", F.lit(True))
    d = plan.join(F.broadcast(all_)).join(F.broadcast(feasible), [*by, *cell], "left").join(got, keys, "left")
    ok = F.coalesce(F.col("units"), F.lit(False)) & (F.col("capacity") > 0)
    some = F.coalesce(F.col("people"), F.lit(0.0))
    return d.select(*keys, F.when(ok, safe_ratio(some, "all_people")).otherwise(0.0).alias("share"), F.greatest(F.lit(0.0), F.col("all_water") - F.coalesce("water", F.lit(0.0))).alias("unmet"), F.when(some > 0, safe_ratio("way", "people")).alias("mean_access"), F.coalesce("sites", F.lit(0)).alias("sites_used"), F.when(ok, "Yes").otherwise("No").alias("feasible"))


def main_summary(factorial: DataFrame, baseline: tuple[str, str], road: str, point: str) -> DataFrame:
    """For each outage, demand and fleet: share, unmet water and access of the baseline, what closing roads and losing the
    point take from the share (percentage points), and the share with both."""
    at = lambda c, r, p: F.max(F.when((F.col("road_state") == r) & (F.col("point_state") == p), F.col(c)))
    base = at("share", *baseline)
    loss = lambda r, p: (F.greatest(F.lit(0.0), base - at("share", r, p)) * 100)
    return factorial.groupBy("outage_case", "demand_case", "fleet").agg(base.alias("share"), at("unmet", *baseline).alias("unmet"), at("mean_access", *baseline).alias("mean_access"), loss(road, baseline[1]).alias("road_loss_pp"), loss(baseline[0], point).alias("point_loss_pp"), at("share", road, point).alias("combined_share"))


def point_capacity(arcs: DataFrame, units: DataFrame, points: DataFrame, routes: DataFrame, work: float, litres: float, most_trips: int) -> DataFrame:
    """For each point that is some unit's nearest: people and water, its best route (most trips in the hours that it is open, then
    the shorter cycle, then the refill point), trips asked for and vehicle days.

    units: (unit, people, water); points: (site, open_minutes); routes: (site, refill, cycle, base_minutes), three a site at most.
    """
    near = arcs.groupBy("unit").agg(F.min(F.struct("distance", "site")).alias("x")).select("unit", "x.site").join(units, "unit")
    need = near.groupBy("site").agg(F.sum("people").alias("people"), F.sum("water").alias("water")).where("water > 0").join(points, "site")
    three = top_by(routes, ["site"], [F.asc("cycle"), F.asc("refill")], 3)
    free = F.least(F.lit(float(work)), F.col("open_minutes")) - F.col("base_minutes")
    trips = F.least(F.lit(most_trips), F.greatest(F.lit(0), F.floor(F.try_divide(free, F.col("cycle"))))).cast("int")
    best = top_by(need.join(three, "site").withColumn("trips", trips), ["site"], [F.desc("trips"), F.asc("cycle"), F.asc("refill")])
    return best.select("site", "people", "water", "refill", "cycle", "trips", F.ceil(F.col("water") / litres).cast("long").alias("daily_trips"), F.try_divide(F.col("water"), F.col("trips") * litres).alias("vehicle_days"))


def solution_checks(solution: DataFrame, arcs: DataFrame, capacity: DataFrame) -> DataFrame:
    """(rule, violations), a row for each of six rules: of a solution (unit, site, demand, status) over arcs (unit, site, demand)
    and capacities (site, capacity)."""
    served = solution.where("status = 'served'")
    n = lambda name, d: d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    load = served.groupBy("site").agg(F.sum("demand").alias("load"))
    rules = [
        n("a unit has one row", solution.groupBy("unit").count().where("count > 1")),
        n("every unit has a row", arcs.select("unit").distinct().join(solution, "unit", "left_anti")),
        n("a served unit has an arc to its site", served.join(arcs, ["unit", "site"], "left_anti")),
        n("its demand is the arc's", served.alias("s").join(arcs.alias("a"), ["unit", "site"]).where("abs(s.demand - a.demand) > 1e-6")),
        n("a site stays within its capacity", load.join(capacity, "site", "left").where("load > coalesce(capacity, 0) + 1e-6")),
        n("an unserved unit has no arc with room", solution.where("status <> 'served'").select("unit").join(arcs, "unit").join(capacity, "site").join(load, "site", "left").where("demand <= capacity - coalesce(load, 0)")),
    ]
    return reduce(DataFrame.unionByName, rules)


def replay(assignments: DataFrame, arcs: DataFrame, keys: list[str]) -> DataFrame:
    """assignments with the columns of their arcs; an assignment without an arc is an error when it is read."""
    d = assignments.join(arcs.withColumn("found_", F.lit(True)), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no arc for "), F.concat_ws(", ", *keys)))
    return d.where(F.when(F.col("found_"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("found_")


def resource_curve(arcs: DataFrame, units: DataFrame, catchments: list[tuple[str, float]], fleets: list[int], load: float) -> DataFrame:
    """catchment, fleet, delivered, share, unmet, ceiling, gain: what fleets deliver of all demand within each catchment (name, metres).

    arcs: (unit, site, distance); units: (unit, demand), one row each. A unit is in a catchment by its nearest site; a fleet's pool is
    fleet * load, and takes whole units by distance, then by unit (`pack_pool`). share and unmet are of the demand of all units,
    with arcs or without; ceiling is the share of units in the catchment; gain is percent points a vehicle more than in the
    fleet before (null for the least one). Fleets that deliver nothing, an empty catchment too, have their rows; without any
    demand shares are null. Units without demand, or below 0, take no part.
    """
    need = units.where("demand > 0").select("unit", F.col("demand").cast("double").alias("demand"))
    near = stored(arcs.groupBy("unit").agg(F.min("distance").alias("distance")).join(need, "unit"))
    spark = arcs.sparkSession
    plan = spark.createDataFrame([(c, float(m), n, n * float(load)) for c, m in catchments for n in sorted(set(fleets))], "catchment string, limit_ double, fleet int, capacity double")  # a few rows
    rows = near.join(F.broadcast(plan), F.col("distance") <= F.col("limit_")).select("catchment", "fleet", "capacity", "distance", "unit", "demand")
    served = pack_pool(rows, ["catchment", "fleet"], ["distance", "unit"], "demand", "capacity").groupBy("catchment", "fleet").agg(F.sum("demand").alias("delivered"))
    inside = near.join(F.broadcast(plan.select("catchment", "limit_").distinct()), F.col("distance") <= F.col("limit_")).groupBy("catchment").agg(F.sum("demand").alias("inside"))
    total = need.agg(F.sum("demand").alias("total"))
    d = plan.join(F.broadcast(served), ["catchment", "fleet"], "left").join(F.broadcast(inside), "catchment", "left").join(F.broadcast(total))
    d = d.withColumn("delivered", F.coalesce("delivered", F.lit(0.0))).withColumn("share", F.try_divide("delivered", "total"))
    w = Window.partitionBy("catchment").orderBy("fleet")
    gain = (F.col("share") - F.lag("share").over(w)) * 100 / (F.col("fleet") - F.lag("fleet").over(w))
    return d.select("catchment", "fleet", "delivered", "share", (F.coalesce("total", F.lit(0.0)) - F.col("delivered")).alias("unmet"), F.try_divide(F.coalesce("inside", F.lit(0.0)), F.col("total")).alias("ceiling"), gain.alias("gain"))
