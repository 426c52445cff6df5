"""Vehicle trips, routes, and whole-unit packing under a capacity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.operators.keys import top_by
from reliefgrid.sources.storage import stored


def feasible_trips(work_hours, base_minutes: Column, leg_minutes: Column, service: float, most: int) -> Column:
    """Round trips in a shift: min(most, max(0, floor((60 W - 2 base) / (2 leg + service)))); unreachable gives 0."""
    n = F.floor(F.try_divide(F.lit(60.0) * work_hours - base_minutes * 2, leg_minutes * 2 + service))
    return F.coalesce(F.least(F.lit(most), F.greatest(F.lit(0), n)), F.lit(0)).cast("int")


def effective_minutes(base_minutes: Column, leg_minutes: Column, service: float, trips: Column) -> Column:
    return leg_minutes * 2 + service + base_minutes * 2 / F.greatest(trips, F.lit(1))


def cheapest_routes(routes: DataFrame, site: str, minutes: str, tie: str, k: int = 3) -> DataFrame:
    return top_by(routes, [site], [F.asc(minutes), F.asc(tie)], k, "route_rank")


def best_route(routes: DataFrame, site: str, trips: str, minutes: str, tie: str) -> DataFrame:
    """Most trips, then least minutes, then the tie column."""
    return top_by(routes, [site], [F.desc(trips), F.asc(minutes), F.asc(tie)])


def nearest_site(arcs: DataFrame, unit: str, distance: str, site: str) -> DataFrame:
    return arcs.groupBy(unit).agg(F.min(F.struct(distance, site)).alias("x")).select(unit, f"x.{site}", f"x.{distance}")


def site_load(sites: DataFrame, nearest: DataFrame, site: str, weight: str) -> DataFrame:
    """The weight of each site's nearest units; sites without any have 0."""
    return sites.select(site).distinct().join(nearest.groupBy(site).agg(F.sum(weight).alias("load")), site, "left").withColumn("load", F.coalesce("load", F.lit(0.0)))


def heaviest_site(load: DataFrame, site: str) -> DataFrame:
    return load.orderBy(F.desc("load"), F.asc(site)).limit(1)


def pack_units(units: DataFrame, keys: list[str], order: list[str], demand: str, capacity: Column, weight: str) -> DataFrame:
    """Takes whole units in order while they fit, skips those that don't, for each scenario of keys.

    The rule looks at one unit after the other, so that one fold a scenario is all the parallelism there is; the fold
    runs in Spark, over an array of the scenario's units. A scenario's units have to fit into one row.
    """
    start = F.struct(F.col("cap_").alias("left"), F.lit(0.0).alias("taken"), F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("n"))
    d = units.withColumn("cap_", capacity.cast("double")).groupBy(*keys, "cap_").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(demand).cast("double").alias("d_"), F.col(weight).cast("double").alias("w_")))).alias("u_"))

    def take(s: Column, u: Column) -> Column:
        fits = u["d_"] <= s["left"] + 1e-9
        add = lambda x: F.when(fits, x).otherwise(F.lit(0.0))
        return F.struct((s["left"] - add(u["d_"])).alias("left"), (s["taken"] + add(u["d_"])).alias("taken"), (s["weight"] + add(u["w_"])).alias("weight"), (s["n"] + F.when(fits, 1).otherwise(0)).cast("bigint").alias("n"))

    return d.withColumn("x", F.aggregate("u_", start, take)).select(*keys, F.col("cap_").alias("capacity"), F.col("x.taken").alias("delivered"), F.col("x.weight").alias("served"), F.col("x.n").alias("units"))


def allocate(arcs: DataFrame, capacity: DataFrame, site: str, unit: str, demand: str, distance: str) -> DataFrame:
    """One site for each unit, within each site's capacity, in rounds: an unserved unit bids for its nearest arc with room,
    and each site takes its bids by distance as far as their running sum fits. It ends when no unserved unit has an arc
    with room. Columns: site, unit, demand, status, and accepted with the physical bound's certificate: the gap between what
    is delivered and min(demand that has an arc, all capacity) is at most 0.2 %. Unserved units have no site (and their
    largest demand).

    Bids are range-split by site and distance, so that a site that many units bid for is dealt over as many tasks. A round reads and
    writes the arcs of units that are still unserved and fit, not those before.
    """
    amount = F.col(demand).cast("double").alias(demand)
    a = stored(arcs.select(site, unit, amount, distance))
    room = stored(capacity.select(site, F.col("capacity").cast("double").alias("cap_"), F.lit(0.0).alias("used_")))
    open_, taken_by_round = a, []
    while True:
        left = room.select(site, (F.col("cap_") - F.col("used_")).alias("room_"))
        # room only shrinks: an arc that doesn't fit now never will, and goes
        fits = open_.join(left, site).where(F.col(demand) <= F.col("room_") + 1e-9)
        bids = fits.groupBy(unit).agg(F.min(F.struct(distance, site, demand, "room_")).alias("x")).select(unit, "x.*")
        order = [site, distance, unit]
        bids = stored(bids.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
        sums = bids.groupBy(site, "part_").agg(F.sum(demand).alias("sum_"))
        before = sums.select(site, "part_", (F.sum("sum_").over(Window.partitionBy(site).orderBy("part_")) - F.col("sum_")).alias("before_"))
        upto = F.sum(demand).over(Window.partitionBy(site, "part_").orderBy(distance, unit).rowsBetween(Window.unboundedPreceding, 0))
        taken = bids.withColumn("upto_", upto).join(before, [site, "part_"]).where(F.col("before_") + F.col("upto_") <= F.col("room_") + 1e-9)
        taken = stored(taken.select(site, unit, demand))
        if taken.isEmpty():
            break
        taken_by_round.append(taken)
        more = taken.groupBy(site).agg(F.sum(demand).alias("more_"))
        room = stored(room.join(more, site, "left").select(site, "cap_", (F.col("used_") + F.coalesce("more_", F.lit(0.0))).alias("used_")))
        open_ = stored(fits.join(taken.select(unit), unit, "left_anti").select(site, unit, demand, distance))
    served = reduce(DataFrame.union, taken_by_round) if taken_by_round else taken
    units = a.groupBy(unit).agg(F.max(demand).alias(demand))
    left = units.join(served.select(unit), unit, "left_anti").select(F.lit(None).cast(a.schema[site].dataType).alias(site), unit, demand, F.lit("unserved").alias("status"))
    got = served.withColumn("status", F.lit("served")).union(left)
    reachable = a.join(capacity, site, "left_semi").groupBy(unit).agg(F.max(demand).alias(demand)).agg(F.sum(demand).alias("reachable"))
    bound = reachable.join(F.broadcast(capacity.agg(F.sum("capacity").alias("room"))))
    done = served.agg(F.coalesce(F.sum(demand), F.lit(0.0)).alias("delivered")).join(F.broadcast(bound))
    return got.join(F.broadcast(done.select(((F.least("reachable", "room") - F.col("delivered")) <= F.least("reachable", "room") * 0.002).alias("accepted"))))


def violations(solution: DataFrame, capacity: DataFrame, site: str, unit: str, demand: str) -> DataFrame:
    """What an allocation breaks: a unit served twice, a site over its capacity. Empty if it is sound."""
    twice = solution.groupBy(F.col(unit).cast("string").alias("what")).count().where("count > 1").select(F.lit("unit served twice").alias("rule"), "what")
    over = solution.groupBy(site).agg(F.sum(demand).alias("d")).join(capacity, site).where("d > capacity + 1e-6").select(F.lit("site over capacity").alias("rule"), F.col(site).cast("string").alias("what"))
    return twice.unionByName(over)
