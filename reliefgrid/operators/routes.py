"""Routes of vehicles from bases over refill points to sites, on one graph of minutes.

The graph goes both ways, so that one search from the refill points gives the ways from their bases and to their sites. A way longer
than half a shift leaves no time for a trip, so the search ends there, and no route is lost by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.nulls import null_clip
from reliefgrid.operators.facilities import SNAP_LIMIT, nearest_end
from reliefgrid.operators.geo import nearest_node
from reliefgrid.operators.keys import number_rows, top_by
from reliefgrid.operators.network import SplitGraph, nearest_distance
from reliefgrid.operators.screening import connector_minutes
from reliefgrid.operators.tanker import feasible_trips
from reliefgrid.sources.storage import stored

#: Routes that a site keeps.
ROUTES = 3


def _numbered(df: DataFrame, order: list[str], key: str, name: str) -> DataFrame:
    """df with numbers in order (nulls last, then key): where rows tie, the first one wins."""
    return number_rows(df, [*[F.asc_nulls_last(c) for c in order], F.asc(key)], name)


def snapped_refills(refills: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """refill, no, node, snap (metres), accepted: refill points (refill, x, y, historical, *order) in order with their nearest node
    (nid, x, y), however far it is; accepted if it is within SNAP_LIMIT and the point counts as historical (unknown: no)."""
    near = nearest_node(refills.select(F.col("refill").alias("pid"), "x", "y"), nodes, SNAP_LIMIT)
    d = _numbered(refills.select("refill", "historical", *[c for c in order if c not in ("refill", "historical")]), order, "refill", "no").join(near, F.col("refill") == F.col("pid"), "left")
    return d.select("refill", "no", F.col("nid").alias("node"), F.col("distance").alias("snap"), F.coalesce(F.col("accepted") & F.col("historical"), F.lit(False)).alias("accepted"))


def base_nodes(bases: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """base, no, node, offset: the bases (base, candidate, accepted, edge_id, fraction, snap, *order) that are candidates, accepted, and
    whose edge (edge_id, a, b, minutes: a row an edge) is in the network, numbered in order, with the nearer end of that edge and
    the minutes to it. A base without a fraction or a snap has no offset and goes."""
    d = bases.where("candidate AND accepted").join(edges.select("edge_id", "a", "b", "minutes"), "edge_id")
    node, along = nearest_end(null_clip("fraction", 0.0, 1.0), F.col("a"), F.col("b"), F.col("minutes"))
    d = _numbered(d.select("base", *[c for c in order if c != "base"], node.alias("node"), (connector_minutes(F.col("snap")) + along).alias("offset")), order, "base", "no")
    return d.select("base", "no", "node", "offset").where("offset IS NOT NULL")


def route_productivity(graph: DataFrame | SplitGraph, sites: DataFrame, refills: DataFrame, bases: DataFrame, work_hours: float, service: float, trip_limit: int, k: int = ROUTES) -> tuple[DataFrame, DataFrame]:
    """Routes and refill points.

    Refill points: refill, no, node, snap, accepted, base, base_minutes: `snapped_refills` with the nearest base (`base_nodes`; of equal
    minutes the first), its way to the node and the refill point's own connector. Accepted only if there is a base from which a
    trip fits into the shift; without one base and minutes are null.

    Routes: site, route_rank, refill, base, leg_minutes, base_minutes, cycle, trips, minutes: of each site (site, node, connector in
    metres) the k accepted refill points with the least minutes, which are a cycle (both ways and the service) and the base's share
    at the most trips that are allowed; ties to the first refill point. At least one trip has to fit, and no more than trip_limit
    count. A site that no refill point reaches has no route.
    """
    refills = stored(refills)
    open_ = refills.where("accepted").select("refill", "node", F.lit(0.0).alias("offset"))
    # of the bases of a node the first of the nearest
    at_node = bases.groupBy("node").agg(F.min(F.struct("offset", "no", "base")).alias("b"))
    ends = stored(at_node.select("node").union(sites.select("node")).distinct())
    ways = nearest_distance(graph, open_, cutoff=60.0 * work_hours / 2, by=["refill"], ends=ends.select("node", F.col("node").alias("end"), F.lit(0.0).alias("rest")))
    ways = stored(ways.withColumnRenamed("end", "node"))
    found = ways.join(at_node, "node").groupBy("refill").agg(F.min(F.struct((F.col("dist") + F.col("b.offset")).alias("way"), F.col("b.no").alias("no"), F.col("b.base").alias("base"))).alias("b"))
    d = refills.join(found, "refill", "left").withColumn("base_minutes", F.col("b.way") + connector_minutes(F.col("snap")))
    near = F.col("base_minutes") * 2 <= 60.0 * work_hours
    points = stored(d.select("refill", "no", "node", "snap", (F.col("accepted") & F.coalesce(near, F.lit(False))).alias("accepted"), F.when(near, F.col("b.base")).alias("base"), F.when(near, F.col("base_minutes")).alias("base_minutes")))
    legs = ways.join(sites.select("site", "node", "connector"), "node").join(points.where("accepted").select("refill", "no", "snap", "base", "base_minutes"), "refill")
    legs = legs.withColumn("leg_minutes", F.col("dist") + connector_minutes(F.col("connector")) + connector_minutes(F.col("snap")))
    legs = legs.withColumn("trips", feasible_trips(work_hours, F.col("base_minutes"), F.col("leg_minutes"), service, trip_limit)).where("trips >= 1")
    cycle = F.col("leg_minutes") * 2 + service
    legs = legs.withColumn("cycle", cycle).withColumn("minutes", cycle + F.col("base_minutes") * 2 / max(trip_limit, 1))
    best = top_by(legs, ["site"], [F.asc("minutes"), F.asc("no")], k, "route_rank")
    return best.select("site", "route_rank", "refill", "base", "leg_minutes", "base_minutes", "cycle", "trips", "minutes"), points
