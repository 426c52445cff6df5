"""Facilities on the road network: snapping, inventories, shelters, failures, and gains of recovered points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.nulls import guarded
from reliefgrid.operators.geo import nearest_node, nearest_within
from reliefgrid.operators.keys import number_rows, top_by
from reliefgrid.operators.scenarios import DEMAND_LEVELS

#: Metres within which a facility counts as being on the network.
SNAP_LIMIT = 250.0


def resolve_location(rows: DataFrame, facilities: DataFrame, name: str) -> DataFrame:
    """rows with x and y: their own, else those of the facilities of that name if all of them agree; location_status says which."""
    known = facilities.where("x IS NOT NULL AND y IS NOT NULL").groupBy(name)
    known = known.agg(F.count_distinct("x", "y").alias("places"), F.min(F.struct("x", "y")).alias("at")).where("places = 1").select(name, "at")
    own = F.col("x").isNotNull() & F.col("y").isNotNull()
    d = rows.join(known, name, "left")
    status = F.when(own, "existing_coordinates").when(F.col("at").isNotNull(), "unique_facility_name").otherwise("unresolved")
    d = d.withColumn("location_status", status)
    moved = d.select(*[c for c in rows.columns if c not in ("x", "y")], F.when(own, F.col("x")).otherwise(F.col("at.x")).alias("x"), F.when(own, F.col("y")).otherwise(F.col("at.y")).alias("y"), "location_status")
    return moved.select(*rows.columns, "location_status")


def first_edges(edges: DataFrame) -> DataFrame:
    """nid, edge_id, fraction: the least edge (edge_id, a, b) that ends at each node, 0 at its start, else 1. Both minima are plain
    columns, so that Spark keeps them in a hash table of nodes and doesn't sort all ends."""
    end = lambda c, own, other: edges.where(F.col(c).isNotNull()).select(F.col(c).alias("nid"), F.col("edge_id").alias(own), F.lit(None).cast(edges.schema["edge_id"].dataType).alias(other))
    both = end("a", "s_", "e_").unionByName(end("b", "e_", "s_")).groupBy("nid").agg(F.min("s_").alias("s_"), F.min("e_").alias("e_"))
    start = F.col("e_").isNull() | (F.col("s_") <= F.col("e_"))
    return both.select("nid", F.least("s_", "e_").alias("edge_id"), F.when(start, 0.0).when(F.col("e_").isNotNull(), 1.0).alias("fraction"))


def snap_to_network(points: DataFrame, nodes: DataFrame, edges: DataFrame, limit: float = SNAP_LIMIT) -> DataFrame:
    """points (pid, x, y) with the nearest node within the limit, and the least edge (edge_id, a, b) that ends there.

    fraction is 0 at the edge's start and 1 at its end; a point beyond the limit, or a node without edges, has nulls.
    """
    near = nearest_within(points, nodes, limit)
    first = first_edges(edges)
    return near.join(first, "nid", "left").select("pid", "nid", "distance", F.col("nid").isNotNull().alias("accepted"), "edge_id", "fraction")


def attach_nearest_node(points: DataFrame, nodes: DataFrame, edges: DataFrame, limit: float = SNAP_LIMIT) -> DataFrame:
    """points (pid, x, y) with the distance of the nearest node however far it is, and whether it is within the limit; the node and its
    first edge (edges: edge_id, a, b; the least edge_id; fraction 0 at its start, 1 at its end) only if it is. A point without
    coordinates has nulls throughout."""
    near = nearest_node(points, nodes, limit)
    first = first_edges(edges)
    near = near.withColumn("nid", F.when(F.col("accepted"), F.col("nid")))
    return near.join(first, "nid", "left").select("pid", "nid", "distance", "accepted", "edge_id", "fraction")


def nearest_end(fraction: Column, a: Column, b: Column, length: Column) -> tuple[Column, Column]:
    """The nearer end of an edge and the way to it from the point at this fraction; the middle goes to the start."""
    return F.when(fraction <= 0.5, a).otherwise(b), guarded(lambda f, w: F.least(f, 1 - f) * w, fraction, length)


def site_inventory(announced: DataFrame, staging: DataFrame, columns: list[str]) -> DataFrame:
    """Both lists with site ids as text and their kind; ties between sites go by that text (so 10 comes before 2)."""
    one = lambda d, kind, prefix: d.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("site_id"), F.lit(kind).alias("kind"), *columns)
    return one(announced, "announced", "WATER::").unionByName(one(staging, "staging", "STAGING::"))


def announced_points(water: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """index, site_id, name, temporary, node, connector: the announced points (name, accepted, node, snap, *order) that are accepted and
    have a node, numbered from 0 in the order of their file (order: unique, such as `_file` and `_row`). Of equally near points the
    one with the smaller index comes first; its site_id is a text in which 10 comes before 2, as in `site_inventory`. A node that the
    network (nodes: node) lacks, or a snap that is no number, is an error when it is read."""
    kept = number_rows(water.where("accepted AND node IS NOT NULL").select(F.col("name").cast("string").alias("name"), "node", "snap", *[c for c in order if c not in ("name", "node", "snap")]), order, "no_")
    known = nodes.select(F.col("node").alias("known_")).distinct()
    d = kept.join(known, F.col("node") == F.col("known_"), "left")
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} of the point "), F.coalesce("name", F.lit("without a name"))))
    snap = F.col("snap").try_cast("double")
    node = F.when(F.col("known_").isNotNull(), F.col("known_")).otherwise(fail("unknown node").cast(d.schema["node"].dataType))
    connector = F.when(F.col("snap").isNull() | snap.isNotNull(), snap).otherwise(fail("no number for the snap").cast("double"))
    return d.select((F.col("no_") - 1).alias("index"), F.concat(F.lit("WATER::"), (F.col("no_") - 1).cast("string")).alias("site_id"), "name", F.lit(False).alias("temporary"), node.alias("node"), connector.alias("connector"))


def without_site(tables: list[DataFrame], site: DataFrame, key: str) -> list[DataFrame]:
    """Each table without the rows of the failed site."""
    return [t.join(F.broadcast(site.select(key).limit(1)), key, "left_anti") for t in tables]


def shelter_ledger(shelters: DataFrame) -> DataFrame:
    """Evacuees' demand by level: three rows a shelter, a ledger of its own that isn't added to the residents' demand."""
    levels = F.array(*[F.struct(F.lit(n).alias("demand_case"), F.lit(q).alias("litres")) for n, q in DEMAND_LEVELS])
    d = shelters.withColumn("l", F.explode(levels))
    return d.select(*shelters.columns, F.col("l.demand_case").alias("demand_case"), (F.col("evacuees") * F.col("l.litres")).alias("demand"), F.lit("separate_not_added").alias("ledger_status"))


def recovered_coverage(before: DataFrame, after: DataFrame, unit: str, limit: float) -> DataFrame:
    """(unit, status): retained, gained, lost or not_covered, from the distances with and without the recovered points."""
    d = before.select(unit, F.col("distance").alias("d0")).join(after.select(unit, F.col("distance").alias("d1")), unit, "full_outer")
    old, new = F.coalesce(F.col("d0") <= limit, F.lit(False)), F.coalesce(F.col("d1") <= limit, F.lit(False))
    return d.select(unit, F.when(old & new, "retained").when(new, "gained").when(old, "lost").otherwise("not_covered").alias("status"))


def access_gaps(units: DataFrame, group: str, distance: str, thresholds: list[tuple[str, float]]) -> DataFrame:
    """For each group and (weight column, limit): all weight, the weight within the limit, what is left, and the share (percent)."""
    aggs = []
    for c, limit in thresholds:
        inside = F.sum(F.when(F.col(distance) <= limit, F.col(c)).otherwise(F.lit(0.0)))
        total = F.sum(c)
        aggs += [total.alias(f"{c}_total"), inside.alias(f"{c}_covered"), (total - inside).alias(f"{c}_gap"), (F.try_divide(inside, total) * 100).alias(f"{c}_pct")]
    return units.groupBy(group).agg(*aggs)


def route_capacity(arcs: DataFrame, routes: DataFrame, site: str, trips: str, load: float) -> DataFrame:
    """One row: what a vehicle carries at most, over the routes whose site has an arc; 0 without any."""
    open_ = routes.join(arcs.select(site).distinct(), site, "left_semi")
    return open_.agg((F.coalesce(F.max(trips), F.lit(0)) * F.lit(load)).alias("capacity"))


def nearest_base(bases: DataFrame, refill: str, base: str, minutes: str) -> DataFrame:
    """Each refill point's nearest base; of equal minutes the first base."""
    return top_by(bases, [refill], [F.asc(minutes), F.asc(base)])
