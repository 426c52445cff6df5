"""Which units a fleet serves, from which sites and refill points: a plan of trips and vehicles, and a bound that proves it.

arcs: (unit, site, demand, distance); routes: (site, refill, cycle), a few a site; refills: (refill, base), minutes a vehicle
needs each day besides its cycles. A vehicle belongs to one refill point for the day, makes `trips` trips at most and has `work`
minutes; the vehicles of a refill point share their trips and minutes. A trip carries `load`. A unit is served whole, by one site.

The bound is a Lagrangian one. With a price for a vehicle, split by a share between its trips and its minutes, a trip of a route costs
so many vehicles (share / trips + (1 - share) * cycle / (work - base)); a site's water is priced by its cheapest route, so that
trips, minutes and sites' capacities go into the price, and what is left is a sum over units: demand * max(0, 1 - price of
its cheapest site). It is convex in the vehicle's price, with its least value at one of the sites' prices: one aggregation by
site, then running sums, give it exactly for each of SHARES. Any share is valid; the least is the bound.

The plan takes sites by vehicles per trip, each with whole trips for the units that it is cheapest for, as many sites as the
fleet allows (bisection: each step is an aggregation over sites); spare trips and minutes of the refill points' vehicles, and
vehicles that are left, go to further sites. Units then go to sites with room in rounds (`tanker.allocate`). What trips are then
still spare go to sites near units that aren't served, over any route, and units are dealt anew, PASSES times at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.operators.keys import number_rows, top_by
from reliefgrid.operators.tanker import allocate
from reliefgrid.sources.storage import stored

#: Parts of a vehicle's price that its trips bear; the rest is borne by its minutes.
SHARES = tuple(k / 10 for k in range(11))
#: A plan is accepted if it falls short of the bound by no more than this part of it.
GAP = 0.01
#: Times that spare trips are spent on units that aren't served.
PASSES = 3


def usable_routes(routes: DataFrame, refills: DataFrame, trips: int, work: float) -> DataFrame:
    """site, refill, cycle, free (minutes of a vehicle of the refill point), use (vehicles that a trip takes if all its vehicle's trips
    are such), for routes of which a vehicle makes a trip."""
    free = F.lit(float(work)) - F.col("base")
    d = routes.join(refills.select("refill", "base"), "refill").withColumn("free", free).where((F.col("cycle") > 0) & (F.col("cycle") <= F.col("free")))
    return d.select("site", "refill", "cycle", "free", F.greatest(F.lit(1.0 / trips), F.col("cycle") / F.col("free")).alias("use"))


def fleet_bound(arcs: DataFrame, usable: DataFrame, fleet: int, trips: int, load: float) -> DataFrame:
    """share, bound: for each of SHARES the least of the dual function, which no plan's delivered demand exceeds."""
    costs = [F.lit(s / trips) + F.lit(1 - s) * F.col("cycle") / F.col("free") for s in SHARES]
    site = usable.groupBy("site").agg(*[F.min(c).alias(f"c{k}") for k, c in enumerate(costs)])
    unit = arcs.join(site, "site").groupBy("unit").agg(F.max("demand").alias("demand"), *[F.min(f"c{k}").alias(f"c{k}") for k in range(len(SHARES))])
    each = unit.select("demand", F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"c{k}").alias("cost")) for k, s in enumerate(SHARES)])).alias("x"))
    by_cost = each.groupBy("x.share", "x.cost").agg(F.sum("demand").alias("demand"))
    w = Window.partitionBy("share").orderBy("cost").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    at = below("demand") - below(F.col("demand") * F.col("cost")) / F.col("cost") + F.lit(fleet * load) / F.col("cost")
    found = by_cost.withColumn("at", at).groupBy("share").agg(F.least(F.min("at"), F.sum("demand")).alias("bound"))
    return found


def plan_sites(arcs: DataFrame, usable: DataFrame, fleet: int, trips: int, load: float) -> tuple[DataFrame, DataFrame]:
    """(site, refill, trips, minutes) of the sites that get trips, and (refill, vehicles)."""
    best = stored(top_by(usable, ["site"], [F.asc("use"), F.asc("cycle"), F.asc("refill")]))
    cheap = arcs.join(best.select("site", "use"), "site").groupBy("unit").agg(F.min_by(F.struct("site", "demand"), F.struct("use", "distance", "site")).alias("x"))
    need = cheap.groupBy("x.site").agg(F.sum("x.demand").alias("need")).where("need > 0")
    n = F.ceil(F.col("need") / load)
    sites = stored(number_rows(best.join(need, "site").select("site", "refill", "cycle", "free", "use", n.alias("n")), ["use", "cycle", "site"], "rank"))

    def vehicles(d: DataFrame) -> DataFrame:
        """By the refill point's pooled trips and minutes."""
        v = F.ceil(F.greatest(F.sum("n") / trips, F.sum(F.col("n") * F.col("cycle")) / F.max("free")) - 1e-9)
        return d.groupBy("refill").agg(v.cast("long").alias("vehicles"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("cycle")).alias("minutes"), F.max("free").alias("free"))

    low, high = 0, sites.count()
    while low < high:
        mid = (low + high + 1) // 2
        used = vehicles(sites.where(F.col("rank") <= mid)).agg(F.sum("vehicles")).first()[0] or 0
        low, high = (mid, high) if used <= fleet else (low, mid - 1)
    taken = sites.where(F.col("rank") <= low)
    own = stored(vehicles(taken))
    left = fleet - (own.agg(F.sum("vehicles")).first()[0] or 0)
    # vehicles that are left go to the refill point of the next site, as far as its demand and those after it need them
    nxt = sites.where(F.col("rank") == low + 1).select("refill", "free").withColumn("more", F.lit(left).cast("long"))
    pool = own.join(nxt.withColumnRenamed("free", "free_"), "refill", "full_outer")
    pool = stored(pool.select("refill", (F.coalesce("vehicles", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("vehicles"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("minutes", F.lit(0.0)).alias("minutes"), F.coalesce("free", "free_").alias("free")))
    spare = pool.select("refill", (F.col("vehicles") * trips - F.col("n")).alias("spare_n"), (F.col("vehicles") * F.col("free") - F.col("minutes")).alias("spare_m"))
    w = Window.partitionBy("refill").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    more = sites.where(F.col("rank") > low).join(spare, "refill")
    room = F.least(F.col("n"), F.col("spare_n") - before("n"), F.floor((F.col("spare_m") - before(F.col("n") * F.col("cycle"))) / F.col("cycle") + 1e-9))
    more = more.withColumn("n", room).where("n > 0")
    trips_of = taken.select("site", "refill", F.col("n").cast("long").alias("trips"), (F.col("n") * F.col("cycle")).alias("minutes"))
    trips_of = trips_of.union(more.select("site", "refill", F.col("n").cast("long"), F.col("n") * F.col("cycle")))
    return stored(trips_of), pool.where("vehicles > 0").select("refill", "vehicles")


def spend_spare(open_: DataFrame, usable: DataFrame, sites: DataFrame, vehicles: DataFrame, trips: int, load: float) -> DataFrame:
    """(site, refill, trips, minutes): further trips of the refill points' vehicles to sites that have arcs (open_) of unserved units, the
    shortest cycles first, as far as their demand asks for them. A site is asked for by one refill point: that of its cheapest
    route among those with a spare trip."""
    used = sites.groupBy("refill").agg(F.sum("trips").alias("n"), F.sum("minutes").alias("m"))
    free = usable.groupBy("refill").agg(F.max("free").alias("free_"))
    spare = vehicles.join(used, "refill", "left").join(free, "refill").select("refill", (F.col("vehicles") * trips - F.coalesce("n", F.lit(0))).alias("spare_n"), (F.col("vehicles") * F.col("free_") - F.coalesce("m", F.lit(0.0))).alias("spare_m"))
    ask = open_.groupBy("site").agg(F.ceil(F.sum("demand") / load).alias("ask"))
    able = usable.join(spare, "refill").where((F.col("spare_n") > 0) & (F.col("cycle") <= F.col("spare_m")))
    one = top_by(able.join(ask, "site"), ["site"], [F.asc("use"), F.asc("cycle"), F.asc("refill")])
    w = Window.partitionBy("refill").orderBy("cycle", "site").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    n = F.least(F.col("ask"), F.col("spare_n") - before("ask"), F.floor((F.col("spare_m") - before(F.col("ask") * F.col("cycle"))) / F.col("cycle") + 1e-9))
    return stored(one.withColumn("n", n).where("n > 0").select("site", "refill", F.col("n").cast("long").alias("trips"), (F.col("n") * F.col("cycle")).alias("minutes")))


def plan_fleet(arcs: DataFrame, routes: DataFrame, refills: DataFrame, fleet: int, trips: int, work: float, load: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four tables. Units: unit, site (null if unserved), demand, status. Sites: site, refill, trips, minutes. Refill points: refill, vehicles.
    One row: delivered, bound, gap (part of the bound that isn't delivered), accepted. Demands that are null or not above 0 take
    no part; of a unit's unlike demands the largest holds for the bound."""
    a = stored(arcs.where("demand > 0 AND unit IS NOT NULL").select("unit", "site", F.col("demand").cast("double").alias("demand"), F.col("distance").cast("double").alias("distance")))
    usable = stored(usable_routes(routes, refills, trips, work))
    a = a.join(usable.select("site").distinct(), "site", "left_semi")
    sites, vehicles = plan_sites(a, usable, fleet, trips, load)
    deal = lambda: stored(allocate(a, sites.groupBy("site").agg((F.sum("trips") * F.lit(float(load))).alias("capacity")), "site", "unit", "demand", "distance").drop("accepted"))
    units = deal()
    for _ in range(PASSES):
        more = spend_spare(a.join(units.where("status = 'unserved'").select("unit"), "unit", "left_semi"), usable, sites, vehicles, trips, load)
        if more.isEmpty():
            break
        sites = stored(sites.union(more).groupBy("site", "refill").agg(F.sum("trips").alias("trips"), F.sum("minutes").alias("minutes")))
        units = deal()
    bound = fleet_bound(a, usable, fleet, trips, load).agg(F.min("bound").alias("bound"))
    done = units.where("status = 'served'").agg(F.coalesce(F.sum("demand"), F.lit(0.0)).alias("delivered"))
    gap: Column = F.coalesce(F.try_divide(F.col("bound") - F.col("delivered"), F.col("bound")), F.lit(0.0))
    summary = done.crossJoin(bound).select("delivered", F.coalesce("bound", F.lit(0.0)).alias("bound"), gap.alias("gap"), (gap <= GAP).alias("accepted"))  # one row each
    return units, sites, vehicles, summary


def plan_checks(arcs: DataFrame, routes: DataFrame, refills: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame, DataFrame], fleet: int, trips: int, work: float, load: float) -> DataFrame:
    """(rule, violations) of a plan, each recomputed from arcs and routes."""
    units, sites, vehicles, summary = plan
    n = lambda name, d: d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    served = units.where("status = 'served'")
    water = served.groupBy("site").agg(F.sum("demand").alias("water"))
    used = sites.join(routes.select("site", "refill", "cycle"), ["site", "refill"], "left").groupBy("refill").agg(F.sum("trips").alias("n"), F.sum(F.col("trips") * F.col("cycle")).alias("m"))
    pool = used.join(vehicles, "refill", "left").join(refills.select("refill", "base"), "refill", "left").withColumn("v", F.coalesce("vehicles", F.lit(0)))
    rules = [
        n("a unit has one row", units.groupBy("unit").count().where("count > 1")),
        n("a served unit has an arc to its site", served.join(arcs, ["unit", "site"], "left_anti")),
        n("a site's water fits its trips", water.join(sites, "site", "left").where(F.col("water") > F.coalesce("trips", F.lit(0)) * load + 1e-6)),
        n("a refill point's trips fit its vehicles", pool.where(F.col("n") > F.col("v") * trips)),
        n("a refill point's minutes fit its vehicles", pool.where(F.col("m").isNull() | (F.col("m") > F.col("v") * (F.lit(work) - F.col("base")) + 1e-6))),
        n("the fleet is not exceeded", vehicles.agg(F.sum("vehicles").alias("v")).where(F.col("v") > fleet)),
        n("the bound is not exceeded", summary.where("delivered > bound + 1e-6")),
        n("the gap is accepted", summary.where("NOT accepted")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def plan_parts(plan: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> dict[str, tuple[DataFrame, list[str]]]:
    """What makes a plan of `plan_fleet`, for `keys.agreement`: units with their sites, trips by route, vehicles by refill point, and what
    is delivered, to six digits. Unserved units and what has no trips or vehicles belong to no part."""
    units, sites, vehicles, total = plan
    return {
        "assignments": (units.where("site IS NOT NULL"), ["unit", "site"]), "routes": (sites.where("trips > 0").select("site", "refill", F.col("trips").cast("long").alias("trips")), ["site", "refill", "trips"]),
        "vehicles": (vehicles.where("vehicles > 0").select("refill", F.col("vehicles").cast("long").alias("vehicles")), ["refill", "vehicles"]),
        "delivered": (total.select(F.round(F.col("delivered").cast("double"), 6).alias("delivered")), ["delivered"]),
    }
